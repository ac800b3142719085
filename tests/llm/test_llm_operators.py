"""Each operator against a plain version, on odd, repeated, null and empty rows."""

import hashlib

import llm_brute as brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from fraud_engine.llm import decontaminate, fingerprint, jaccard_join, line_dedup, packing, ppm, suffix_dedup, tokens


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("kind", ["rows", "doubled"])
def test_suffix_dedup(request, make, kind):
    rows = request.getfixturevalue(kind)
    got = suffix_dedup.remove_repeats(make(rows)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute.removed_strings(rows)))


def test_suffix_ranks():
    import numpy as np

    rnd = np.random.default_rng(3)
    data = rnd.integers(97, 99, 400).astype(np.uint8)
    starts = np.arange(len(data) - 49)
    strings = [data[i:i + 50].tobytes() for i in starts]
    ranks = suffix_dedup.suffix_ranks(data, starts)
    assert sorted(starts, key=lambda i: (ranks[i], i)) == sorted(starts, key=lambda i: (strings[i], i))


def test_fingerprints(make, rows):
    got = {r.doc_id: r for r in fingerprint.compare_with_next(make(rows)).collect()}
    ordered = sorted(rows)
    ordered = [(d, t or "") for d, t in sorted(rows, key=lambda r: r[0])]
    assert len(got) == len(rows)
    for (d, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1]):
        changed = fingerprint.edited(t, n)
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), sha(changed))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if changed == t:
            assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1
    by_text = {}
    for d, t in ordered:
        assert by_text.setdefault(t, got[d].fingerprint) == got[d].fingerprint


def test_fingerprints_of_parts_and_repeats(make, doubled, monkeypatch):
    monkeypatch.setattr(fingerprint, "parts_for", lambda docs: 6)
    whole = [(d, t or "") for d, t in doubled]
    ordered = sorted(whole, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = fingerprint.compare_with_next(make(doubled)).select("doc_id", "n_chars", "edited_sha256").collect()
    expected = [(d, len(t), sha(fingerprint.edited(t, n))) for (d, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1])]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


def test_sketches_merge():
    import pyarrow as pa

    a, b = " ".join(f"a{i}" for i in range(400)), " ".join(f"b{i}" for i in range(400))
    one, two, part = fingerprint.sketches(pa.array([a, b, " ".join(a.split()[:100])]))
    assert fingerprint.containment(part, fingerprint.merge(one, two)) == 1
    assert fingerprint.containment(one, two) == 0
    assert (fingerprint.from_text(fingerprint.to_text(one)) == one).all()


def library_ids(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.VOCABULARY)
    return [e.ids + [0] for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_token_files(spark, make, rows, tmp_path, planes):
    import zlib

    import numpy as np

    folder = str(tmp_path / planes)
    files = tokens.write_ids(make(rows), folder, planes=planes, block_ids=64, file_bytes=20_000)
    assert files.count() > 1
    got = sorted(map(tuple, tokens.read_ids(files, folder).collect()))
    expected, start = [], 0
    ordered = sorted(rows, key=lambda r: r[0])
    for (d, _), ids in zip(ordered, library_ids([t for _, t in ordered])):
        expected.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == expected


def test_token_files_of_repeats(make, doubled, tmp_path):
    """Null ids come first, rows of one id in order of their texts; every row has its place."""
    import zlib

    import numpy as np

    folder = str(tmp_path / "doubled")
    files = tokens.write_ids(make(doubled), folder, block_ids=64, file_bytes=20_000)
    got = sorted(tokens.read_ids(files, folder).collect(), key=lambda r: r.start)
    ordered = sorted(((d, t or "") for d, t in doubled), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [r.doc_id for r in got] == [d for d, _ in ordered]
    start = 0
    for r, ids in zip(got, library_ids([t for _, t in ordered])):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_pieces_of_the_vocabulary():
    import random

    import pyarrow as pa

    rnd = random.Random(5)
    marks = ["a", "b", "'", "s", "'s", "'re", "'ll", "'d", " ", "  ", "\n", "\t", "1", "é", "!", " ", "　", "😀", "́", "<|endoftext|>", "\r\n"]
    texts = ["".join(rnd.choice(marks) for _ in range(rnd.randrange(25))) for _ in range(3000)]
    ids, at = tokens.Encoder.of(tokens.VOCABULARY).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == library_ids(texts)


def test_pieces_have_their_starts_and_digests(make, doubled):
    import zlib

    import numpy as np

    got = sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packing.pack_documents(make(doubled), packing.Capacity(tokens=64)).collect()), key=repr)
    want = []
    for (d, _), ids in zip(doubled, library_ids([t for _, t in doubled])):
        first = len(ids) % 64 or 64
        edges = [0, *range(first, len(ids) + 1, 64)]
        want += [(d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("kind", ["rows", "doubled"])
def test_packing(request, make, kind):
    import math

    rows = request.getfixturevalue(kind)
    capacity = packing.Capacity(tokens=64)
    got = packing.pack_documents(make(rows), capacity).collect()
    by_sequence, by_doc = {}, {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, 0)
        by_doc[r.doc_id] += r.length
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    sizes = list(map(len, library_ids([t for _, t in rows])))
    assert sum(by_doc.values()) == sum(sizes)
    assert len(got) == sum(math.ceil(n / 64) for n in sizes)
    assert len(by_sequence) <= math.ceil(sum(sizes) / 64) + 1


@pytest.mark.parametrize("choose", ["norm", "dot"])
def test_packing_keeps_every_capacity(choose):
    capacity = packing.Capacity(tokens=100, pieces=4, attention=5000, choose=choose)
    histogram = {70: 5, 50: 7, 33: 40, 10: 90, 3: 500, 1: 2}
    rows = packing.plan(histogram, capacity)
    bins, seen = {}, {}
    for length, a, b, first, each, _ in rows:
        for rank in range(a, b):
            bins.setdefault(first + (rank - a) // each, []).append(length)
            seen[length] = seen.get(length, 0) + 1
    assert seen == histogram
    for lengths in bins.values():
        assert sum(lengths) <= 100 and len(lengths) <= 4 and sum(x * x for x in lengths) <= 5000


def test_jaccard_components(make, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_components(make(rows)).collect()}
    assert got == brute.link_components(rows)


def test_rows_without_id_and_of_one_id_link(make):
    """A near copy without id is linked; rows of one id are judged by their own texts."""
    text = " ".join(f"w{i}" for i in range(60))
    near, other = text + " x", " ".join(f"v{i}" for i in range(60))
    rows = [(7, text), (None, near), (9, near), (None, other), (None, other), (4, "a b"), (4, other + " y"), (5, None)]
    got = [(r.doc_id, r.component_id) for r in jaccard_join.link_components(make(rows)).collect()]
    want = [(7, 7), (None, 7), (9, 7), (None, 4), (None, 4), (4, 4), (4, 4), (5, 5)]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def twins(n, a="a", b="b"):
    """Two words that swap two letters in the Thue-Morse pattern."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(b if x else a for x in bits), "".join(a if x else b for x in bits)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_of_one_polynomial_are_told_apart(spark, make, n):
    """Modulo a power of two these words have one hash, whatever the base."""
    import zlib

    import numpy as np

    x, y = twins(n)
    rows = [(1, x), (2, y), (7, f"{x} two three four five six"), (8, f"{y} two three four five six"), (9, f"seen {x}")]
    found = {r.doc_id: r for r in jaccard_join.link_components(make(rows)).collect()}
    assert [found[d].component_id for d in (1, 2, 7, 8, 9)] == [1, 2, 7, 8, 9]
    sketch = {r.doc_id: r.fingerprint for r in fingerprint.compare_with_next(make(rows)).collect()}
    # Of the longer texts a sketch may hold a shared shingle alone; a text of one word holds that word.
    assert sketch[1] != sketch[2]
    ids = dict(zip((x, y), library_ids([x, y])))
    pieces = {r.doc_id: r.ids_crc32 for r in packing.pack_documents(make(rows[:2]), packing.Capacity(tokens=1 << 20)).collect()}
    assert pieces == {1: zlib.crc32(np.array(ids[x], "<u4").tobytes()), 2: zlib.crc32(np.array(ids[y], "<u4").tobytes())}
    held, learned = (next(d for d in range(100, 200) if (brute.crc(d) % 7 == 2) == out) for out in (True, False))
    scored = {r.doc_id: r.n_known for r in ppm.score_documents(make([(learned, x), (held, y)]), ppm.learnable).collect()}
    assert scored == {learned: 2, held: 1}


def test_jaccard_signatures_find_every_linked_pair():
    import random

    import pyarrow as pa

    rnd = random.Random(9)
    for _ in range(300):
        n = rnd.choice([5, 6, 8, 9, 10, 11, 13, 17, 24, 50, 140])
        a = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
        b = list(a)
        for _ in range(rnd.randrange(1, 3)):
            place = rnd.choice([0, len(b) - 1, rnd.randrange(len(b))])
            b[place:place + 1] = rnd.choice([[], ["q"], ["q", "r"]])
        one, two = brute.shingle_set(" ".join(a)), brute.shingle_set(" ".join(b))
        if not b or 100 * len(one & two) < 80 * len(one | two):
            continue
        found = [set(jaccard_join.Sets(pa.array([" ".join(t)])).signatures()[0].tolist()) for t in (a, b)]
        assert found[0] & found[1]


@pytest.mark.parametrize("kind", ["rows", "doubled"])
def test_line_dedup(request, make, kind):
    rows = request.getfixturevalue(kind)
    got = line_dedup.dedup_lines(make(rows)).select("doc_id", "n_lines", "n_dropped", "kept").collect()
    expected = brute.deduped_lines(rows)
    assert sum(r[2] for r in expected) > 10
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


def test_line_runs_are_levelled(spark):
    runs = line_dedup.LineRuns(spark, 2, fanout=2)
    news = []
    for k in range(5):
        batch = spark.createDataFrame([(i, i, k) for i in range(k, k + 3)], "h1 long, h2 long, doc_id long")
        news.append(sorted(r.h1 for r in runs.add(batch).collect()))
    assert news == [[0, 1, 2], [3], [4], [5], [6]]
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    got = {r.h1: (r.n_docs, r.last_doc) for r in runs.totals().collect()}
    assert got == {i: (sum(k <= i < k + 3 for k in range(5)), min(i, 4)) for i in range(7)}


ITEMS = [(1, " ".join(f"b{i}" for i in range(25))), (2, "only four words here"), (3, None), (4, ""), (None, "no id " * 4), (5, "?!")]


@pytest.mark.parametrize("slice_windows", [500_000, 1])
def test_decontamination(spark, make, doubled, slice_windows):
    rows = doubled + [
        (9001, "x B5 b6, b7 b8 b9 b10 b11 b12 b13 b14 B15! y"), (9002, "b5 b6 b7"), (9003, "ONLY four words\nhere only four words here"),
        (9004, "no id no id no id no id and more")]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.find(make(rows), items, slice_windows=slice_windows)
    got = [(r.doc_id, r.n_words, r.n_hit, sorted(r.items)) for r in found.collect()]
    expected = brute.contaminated(rows, ITEMS)
    assert sum(r[2] > 0 for r in expected) >= 3
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


def test_spans_are_removed(spark, make):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.remove_spans(make([(1, "keep only FOUR words here this"), (2, None), (3, "clean")]), items)
    assert {r.doc_id: r.text for r in got.collect()} == {1: "keep     this", 2: None, 3: "clean"}


def test_partial_matching(make, rows):
    few = [(d, t[:400] if t else t) for d, t in rows[:60]]
    got = ppm.score_documents(make(few), ppm.learnable, block_bytes=3000).collect()
    expected = brute.partial_matching(few)
    assert len(got) == len(few)
    for r in got:
        n_tokens, n_known, total, base, score = expected[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, n_known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-5)
        assert r.held_out == (brute.crc(r.doc_id) % 7 == 2)


def test_partial_matching_of_repeats(make, rows):
    """Repeated rows count as often as they stand, and score alike."""
    few = [(d, t[:200] if t else t) for d, t in rows[:30]]
    again = few + few[5:10] + [(None, "a text without id"), (None, "a text without id")]
    got = ppm.score_documents(make(again), ppm.learnable, block_bytes=2000).collect()
    assert len(got) == len(again)
    by_row = {}
    for r in got:
        by_row.setdefault((r.doc_id, r.n_tokens), set()).add((r.n_known, round(r.score, 4), round(r.base_score, 6)))
    assert all(len(v) == 1 for k, v in by_row.items() if k[0] is not None)
    words = sum(len(brute.spaced_words(t)) + 1 for d, t in again if d is None or brute.crc(d) % 7 != 2)
    assert {r.train_tokens for r in got} == {words}


def test_fingerprints_estimate_the_true_containment(make):
    """`near_next` is near the share of five-word shingles that the texts have in common."""
    import random

    rnd = random.Random(4)
    rows, shares = [], []
    for k in range(0, 60, 2):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(3000)]
        cut = rnd.randrange(0, 2900)
        rows += [(k, " ".join(words)), (k + 1, " ".join(words[:3000 - cut] + [f"v{rnd.randrange(10**6)}" for _ in range(cut)]))]
        a, b = (brute.shingle_set(t) for _, t in rows[-2:])
        shares.append(len(a & b) / min(len(a), len(b)))
    got = {r.doc_id: r.near_next for r in fingerprint.compare_with_next(make(rows)).collect()}
    errors = [abs(got[2 * i] - share) for i, share in enumerate(shares)]
    assert max(errors) < 0.15 and sum(errors) / len(errors) < 0.04


def test_empty_tables(spark, make):
    docs, items = make([]), spark.createDataFrame([], "item_id long, text string")
    some = make([(1, "a b c")])
    for found in (
            suffix_dedup.remove_repeats(docs), fingerprint.compare_with_next(docs), jaccard_join.link_components(docs),
            line_dedup.dedup_lines(docs), packing.pack_documents(docs), decontaminate.find(docs, items),
            ppm.score_documents(docs, ppm.learnable)):
        assert found.collect() == []
    assert decontaminate.find(some, items).first().n_hit == 0


def test_empty_token_files(make, tmp_path):
    files = tokens.write_ids(make([]), str(tmp_path / "none"))
    assert tokens.read_ids(files, str(tmp_path / "none")).collect() == []


def test_phrases_take_no_hashes_they_do_not_need(monkeypatch):
    """The sums of a text are made once; without keys phrases are the same and have no content hashes."""
    from fraud_engine.llm import suffix_dedup, textbatch

    made, real = [], textbatch.prefix_sums
    for module in (textbatch, suffix_dedup):
        monkeypatch.setattr(module, "prefix_sums", lambda data: made.append(len(data)) or real(data))
    data = np.random.default_rng(3).integers(0, 256, 5000).astype(np.uint8)
    offsets = np.array([0, 1200, 1200, 1230, 5000])
    whole, bare = (suffix_dedup.Phrases(data, offsets, keys=k) for k in (True, False))
    assert made == [5000, 5000] and not hasattr(bare, "key") and len(whole.key) == len(whole.first)
    for c in ("first", "last", "trigger", "row", "at"):
        assert (getattr(whole, c) == getattr(bare, c)).all()


def test_reduced_values_equal_remainders():
    from fraud_engine.llm import textbatch

    p = 2**31 - 1
    x = np.array([0, 1, p - 1, p, p + 1, 2 * p, (p - 1) ** 2, (p - 1) * p, p * p - 1, 2**33], np.uint64)
    assert (textbatch._reduce(x.copy()) == x % np.uint64(p)).all()
