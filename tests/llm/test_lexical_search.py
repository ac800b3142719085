"""Ranked search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fraud_engine.llm import lexical_search as ls

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, top=10):
    held = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        asked, scored = Counter(terms(text)), []
        for d, c in held:
            m = 25 + (75 * sum(c.values()) * n_docs) // max(n_terms, 1)
            score = 0
            for t, repeats in asked.items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += repeats * w * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        best = sorted(scored)[:top]
        out += [(item, text, k + 1, d, -s) for k, (s, _, _, d) in enumerate(best)]
    return sorted(out, key=repr)


def collected(df):
    return sorted(((r["item_id"], r["text"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


def items_of(spark, items):
    return spark.createDataFrame(items, "item_id string, text string").withColumns({c: F.lit(1) for c in ("rank", "score", "doc_id", "_slice", "item")})


def corpus(seed, n=300, vocabulary=60):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("Aéxz中9") + str(int(rnd.paretovariate(0.7)) % vocabulary)
    text = lambda: rnd.choice([" ", "-", "\n", "\x7f"]).join(word() for _ in range(rnd.choice([0, 1, 5, 20, 80])))
    docs = [(rnd.randrange(10**6), text()) for _ in range(n)]
    return docs + docs[:5] + [(None, docs[7][1]), (None, None), (3, docs[9][1]), (4, docs[9][1])], [(f"q{k}", text()) for k in range(12)]


ITEMS = [("none", "zzz unknown"), ("null", None), ("empty", ""), ("same", "A1 a1 A1"), ("same", "A1 a1 A1"), ("same", "x2 Z3"), (None, "a1")]


@pytest.mark.parametrize("block_docs, top", [(1 << 14, 10), (7, 10), (7, 1), (50, 1000)])
def test_equals_scoring_everything(make, spark, monkeypatch, block_docs, top):
    real = ls.index_blocks
    monkeypatch.setattr(ls, "index_blocks", lambda docs, t: real(docs, t, block_docs=block_docs))
    docs, items = corpus(block_docs)
    items = items + ITEMS
    assert collected(ls.search(make(docs), items_of(spark, items), top)) == brute(docs, items, top)


def test_slices_of_queries(make, spark):
    docs, items = corpus(2)
    assert collected(ls.search(make(docs), items_of(spark, items), slice_bytes=300)) == brute(docs, items)


def test_more_terms_than_one_mask_word(make, spark):
    docs, _ = corpus(4, vocabulary=400)
    items = [("long", " ".join(f"{c}{n}" for c in "aéxz中9" for n in range(40)) + " a1" * 500)]
    assert collected(ls.search(make(docs), items_of(spark, items))) == brute(docs, items)


def test_long_text(make, spark):
    docs = [(1, "a1 b2 " * 200_000), (2, "a1"), (3, "c3 " * 50), (4, "b2 a1 x")]
    items = [("q", "a1 b2")]
    assert collected(ls.search(make(docs), items_of(spark, items))) == brute(docs, items)


def test_empty_tables(make, spark):
    docs, items = corpus(5)
    for d, q in (([], items), (docs, []), ([], [])):
        assert ls.search(make(d), items_of(spark, q)).count() == 0


def test_masks_below_the_best_are_not_scored():
    """One common term in all documents: after the best, no mask of that term alone is looked at."""
    n = 5000
    places = np.concatenate([np.arange(n), np.arange(0, 40)]).astype(np.int32)
    row = {
        "ids": np.arange(n), "nulls": np.zeros(n, bool), "sizes": np.full(n, 10), "terms": np.array([0, 1]),
        "begins": np.array([0, n]), "places": places, "times": np.ones(len(places), np.int32)}
    found = ls.Search([(np.array([0, 1]), np.array([1, 1]))], np.array([100, 9000]), n, 10 * n, 10)
    found.block(row)
    assert found.held == n and found.scored == 40
    assert found.best[0][2].tolist() == list(range(10))


def test_words_of_one_hash_are_compared(monkeypatch):
    import pyarrow as pa

    found = ls.Terms(["alpha beta"])
    words = ls.Words(*ls.text_bytes(pa.array(["alpha gamma betas alpha"], pa.large_string())), ls.ALNUM)
    monkeypatch.setattr(type(words), "hashes", lambda self: np.full(len(self.start), found.hashes[0]))
    word, term = found.find(words)
    name = found.data[found.start[found.order[0]]:found.end[found.order[0]]].tobytes()
    assert all(words.text(w) == name for w in word)
