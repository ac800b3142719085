"""Source mixing: targets, sample sizes, chances, and the exact sample against a plain ranking."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fraud_engine.llm import mixing as mx


def table(spark, rows, parts=3):
    """(doc_id, source, text) with extra columns of clashing names."""
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    clash = {c: F.lit(1) for c in ("size", "weight", "draw", "digest", "target", "factor", "key", "copies", "_source", "_n", "bucket", "need", "last")}
    return df.withColumns(clash).repartition(parts)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes, share=1.5, most=2, weights=(3, 1, 2)):
    """Water filling in rounds, as the recipe says it."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    open_, left, out = set(names), share * sum(sizes.values()), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total >= most * sizes[s]}
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: float(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return out


def plain_mix(rows, most=2, weights=None):
    """copies of each row, by a full ranking of each source."""
    weights = weights or [1.0] * len(rows)
    sizes = [words(t) for _, _, t in rows]
    per_source = defaultdict(int)
    for (_, s, _), n in zip(rows, sizes):
        per_source[s] += n
    targets, copies = plain_targets(per_source, most=most), [0] * len(rows)
    for s in per_source:
        own = [i for i, r in enumerate(rows) if r[1] == s]
        full, factor = set(), 0.0
        while True:
            open_ = sum(weights[i] * sizes[i] for i in own if i not in full)
            if open_:
                factor = max(factor, (targets[s] - most * sum(sizes[i] for i in full)) / open_)
            now = {i for i in own if factor * weights[i] >= most}
            if now == full:
                break
            full = now
        need, ranks = targets[s], []
        for i in own:
            e = min(most, factor * weights[i])
            copies[i] = int(e)
            need -= int(e) * sizes[i]
            p = e - int(e)
            name = "mix" if rows[i][0] is None else f"mix:{rows[i][0]}"
            draw = int(hashlib.md5(name.encode()).hexdigest()[:13], 16)
            if p > 0:
                u = (draw + 0.5) / 2**52
                ranks.append((int(u * (1 - p) / (p * (1 - u) + u * (1 - p)) * 2**52), draw, i))
        upto = 0
        for _, _, i in sorted(ranks):
            upto += sizes[i]
            copies[i] += 2 * upto - sizes[i] < 2 * need
    return copies, targets, per_source


def corpus(seed, n=300, sources=("a", "b", "Z", "é", None)):
    rnd = random.Random(seed)
    return [(i * 7 + 3, rnd.choice([sources[0], *sources]), " ".join("w" * rnd.choice([0, 1, 4, 40, 300]))) for i in range(n)]


def collected(df):
    return {r["doc_id"]: (r["source"], r["size"], r["source_size"], pytest.approx(r["target"]), r["copies"]) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_plain_ranking(spark, seed):
    rows = corpus(seed)
    copies, targets, sizes = plain_mix(rows)
    got = collected(mx.mix(table(spark, rows)))
    assert got == {d: (s, words(t), sizes[s], targets[s], c) for (d, s, t), c in zip(rows, copies)}


def test_unequal_weights(spark):
    rows = corpus(5)
    weights = [1.0 + (d % 5) for d, _, _ in rows]
    copies, targets, sizes = plain_mix(rows, weights=weights)
    df = table(spark, rows)
    got = collected(mx.mix(df, weight=F.lit(1.0) + F.col("doc_id") % 5))
    assert {d: v[4] for d, v in got.items()} == {r[0]: c for r, c in zip(rows, copies)}
    assert max(copies) == 2
    for s in sizes:
        taken = sum(words(t) * c for (_, x, t), c in zip(rows, copies) if x == s)
        assert abs(taken - targets[s]) <= 150


def test_chances_are_the_asked_ones(spark, monkeypatch):
    """Over many seeds each document is taken about as often as its weight asks."""
    rows = [(i, "s", "w " * 10) for i in range(12)]
    weights = [1.0, 2.0, 3.0] * 4
    taken = Counter()
    for k in range(400):
        monkeypatch.setattr(mx, "SEED", f"mix{k}")
        need, ranks = 60, []
        for (d, _, _), w in zip(rows, weights):
            p = w / 4
            draw = int(hashlib.md5(f"mix{k}:{d}".encode()).hexdigest()[:13], 16)
            u = (draw + 0.5) / 2**52
            ranks.append((u * (1 - p) / (p * (1 - u) + u * (1 - p)), d))
        taken.update(d for _, d in sorted(ranks)[: need // 10])
    for k, w in enumerate((1, 2, 3)):
        assert np.mean([taken[d] for d in range(k, 12, 3)]) == pytest.approx(400 * w / 4, rel=0.08)


def test_targets_fill_up_in_rounds(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 3, "d": 500, None: 40}, {"a": 0, "b": 0}, {"a": 7}, {"a": 1, "b": 10**12}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mx.source_targets(df).collect()}
        want = plain_targets(sizes)
        assert got == {s: pytest.approx(t) for s, t in want.items()}
        assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_odd_rows(spark):
    rows = [(None, "a", "x y"), (None, "a", "x y"), (None, None, None), (4, "a", ""), (4, "a", "one two three"), (4, "a", "one two three"),
            (5, "b", " \t\n"), (6, "b", "w " * 100_000), (7, "b", "short")]
    got = mx.mix(table(spark, rows)).collect()
    assert len(got) == len(rows) and all(0 <= r["copies"] <= 2 for r in got)
    assert sorted(r["size"] for r in got) == sorted(words(t) for _, _, t in rows)
    copies, _, _ = plain_mix(rows)
    total = lambda pairs: sum(n * c for n, c in pairs)
    assert total((r["size"], r["copies"]) for r in got) == total((words(r[2]), c) for r, c in zip(rows, copies))
    assert mx.mix(table(spark, [])).count() == 0


def test_rows_alike_are_cut_by_number(spark):
    rows = [(1, "s", "a b c d")] * 10 + [(2, "t", "w")] * 30
    got = mx.mix(table(spark, rows)).collect()
    for s, (n, size) in {"s": (10, 4), "t": (30, 1)}.items():
        own = [r for r in got if r["source"] == s]
        assert len(own) == n and abs(sum(r["copies"] * r["size"] for r in own) - own[0]["target"]) <= size / 2


def test_sample_does_not_depend_on_partitions(spark):
    rows = corpus(9)
    assert collected(mx.mix(table(spark, rows, 1))) == collected(mx.mix(table(spark, rows[::-1], 7)))
