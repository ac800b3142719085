"""Cross-tokenizer alignment against a plain version that walks every text token by token."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from fraud_engine.llm import alignment as al


def plain_tokens():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(al.BYTE_LEVEL)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=al.PIECES)
    pair = al.Pair.of(al.BYTE_LEVEL, al.PIECES)

    def spelled(table, ids):
        data, place, size = table
        return [data[place[i]:place[i] + size[i]].tobytes() for i in ids]

    def tokens(text):
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        return ia, ib, spelled(pair.a_bytes, ia), spelled(pair.b_bytes, ib)

    return tokens


def brute(texts):
    """n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each text."""
    tokens, found, counts = plain_tokens(), [], Counter()
    for text in texts:
        ia, ib, sa, sb = tokens(text) if text else ([], [], [], [])
        if b"".join(sa) != b"".join(sb) or b"".join(sa) != (" " + (text or "")).encode():
            ia = ib = sa = sb = []
        ea, eb = np.cumsum([len(t) for t in sa]).tolist(), np.cumsum([len(t) for t in sb]).tolist()
        cuts = sorted(set(ea) & set(eb))
        groups = []
        for lo, hi in zip([0, *cuts], cuts):
            own = [",".join(str(i) for i, e in zip(ids, ends) if lo < e <= hi) for ids, ends in ((ia, ea), (ib, eb))]
            groups.append("|".join(own))
        pairs = []
        for x, (i, e) in enumerate(zip(ia, ea)):
            for y, (j, f) in enumerate(zip(ib, eb)):
                if max(e - len(sa[x]), f - len(sb[y])) < min(e, f):
                    pairs.append((i, j))
        counts.update(pairs)
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        found.append((len(ia), len(ib), len(groups), pairs, sha))
    best = defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return [(a, b, g, len(p), sum(counts[q] == best[q[1]] for q in p), sum(counts[q] for q in p), sha)
            for a, b, g, p, sha in found]


ODD = [
    None, "", " ", "  ", "\n", "a", "Ⅷ ﬁ x", "x▁y z", "zero\x00byte", "<|endoftext|> y <s> </s> <unk>", "<0x41> and <0x0A>",
    "😀 中文 mixed  text   with spaces  ", "\tTabs\t\tand\r\nlines\n\n", "é combining ́ alone", "aaaaaaaaaaaaaaaaaaaa" * 9,
    "'s don't we'll  'x", "1234567890 12 3", "　wide space", "﻿mark", "ünïcödé " * 30, "word " * 3000 + "end",
]


def texts_of(seed, n=40):
    rnd = random.Random(seed)
    alphabet = list("abcdehilnorstu   \n.,'") + ["é", "ß", "中", "😀", "the ", "tion", "ing "]
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.choice([1, 3, 20, 200]))) for _ in range(n)]


def collected(df):
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(((r["doc_id"], *[r[c] for c in names]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block_bytes", [al.BLOCK_BYTES, 2000])
def test_equals_walking_every_text(make, block_bytes):
    texts = ODD + texts_of(3)
    want = sorted(((i, *w) for i, w in enumerate(brute(texts))), key=repr)
    assert collected(al.align_corpus(make(list(enumerate(texts))), block_bytes=block_bytes)) == want


def test_repeated_rows_count_each(make):
    texts = ["the same text", "the same text", "another of the id", None, "x▁y"]
    ids = [4, 4, 4, None, None]
    want = sorted(((i, *w) for i, w in zip(ids, brute(texts))), key=repr)
    assert collected(al.align_corpus(make(list(zip(ids, texts))))) == want


def test_empty_table(make):
    got = al.align_corpus(make([]))
    assert got.count() == 0 and got.columns[0] == "doc_id" and len(got.columns) == 8


@pytest.mark.parametrize("stretch", [1, 3, 512])
def test_cursors_meet_at_any_stretch(monkeypatch, stretch):
    monkeypatch.setattr(al, "STRETCH", stretch)
    pair = al.Pair.of(al.BYTE_LEVEL, al.PIECES)
    for seed in range(6):
        e = al.Encoded(pa.array(ODD + texts_of(seed, 20), pa.large_string()), pair)
        last_a, last_b = al.align(e)
        both = np.intersect1d(e.a_ends, e.b_ends)
        assert np.array_equal(e.a_ends[last_a], both) and np.array_equal(e.b_ends[last_b], both)
        link_a, link_b = al.links(e, last_a, last_b)
        assert len(link_a) == len(np.union1d(e.a_ends, e.b_ends)) == len(set(zip(link_a.tolist(), link_b.tolist())))


def test_one_to_one_stretches_are_jumped(monkeypatch):
    """Ends that agree for 1,000 tokens take ten probes, not a thousand."""
    class Ends:
        a_ends = b_ends = np.arange(1, 1001)
        a_first = b_first = np.array([0, 1000])

    monkeypatch.setattr(al, "STRETCH", 10**9)
    steps, real = [], al.ragged
    monkeypatch.setattr(al, "ragged", lambda *x: steps.append(1) or real(*x))
    last_a, last_b = al.align(Ends)
    assert np.array_equal(last_a, np.arange(1000)) and np.array_equal(last_a, last_b)
    assert len(steps) == 4 * 10


def test_chunks_of_one_hash_are_kept_apart(monkeypatch):
    monkeypatch.setattr(al, "range_hashes", lambda data, begin, end: np.zeros(len(begin), np.uint64))
    chunks = al.Chunks(lambda texts: [[len(t)] * len(t) for t in texts])
    data = np.frombuffer(b"abcde", np.uint8)
    ids, counts = chunks.of(data, np.array([0, 2]), np.array([2, 5]))
    assert ids.tolist() == [2, 2, 3, 3, 3] and counts.tolist() == [2, 3]


def test_long_text(make):
    text = " ".join(texts_of(9, 400)) * 10
    got = al.align_corpus(make([(1, text)])).collect()[0]
    e = al.Encoded(pa.array([text], pa.large_string()), al.Pair.of(al.BYTE_LEVEL, al.PIECES))
    assert (got["n_a"], got["n_b"]) == (len(e.a_ids), len(e.b_ids))
    assert got["n_groups"] == len(np.intersect1d(e.a_ends, e.b_ends)) and got["n_links"] == len(np.union1d(e.a_ends, e.b_ends))
