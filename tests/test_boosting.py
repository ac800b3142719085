"""Second-order boosted trees: against a plain version, cores, breaks, early end, stored tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fraud_engine.operators import boosting as bo
from fraud_engine.operators.train import fit_boosted_trees

INPUTS = ["amt", "txn_time", "TXNctg_home", "stddev_txn_amt"]
SCHEMA = "trans_num long, is_fraud int, amt double, txn_time double, TXNctg_home double, stddev_txn_amt double"


def rows_of(n, seed=0, missing=0.2):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        fraud = int(rng.random() < 0.15)
        amt = float(np.round(rng.normal(120 if fraud else 60, 30)))
        spread = None if rng.random() < missing + 0.4 * fraud else float(np.round(rng.random(), 1))
        out.append((i, fraud, amt, float(rng.integers(0, 24)), float(rng.integers(0, 2)), spread))
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows_of(3000), SCHEMA).cache()


def plain_boost(x, y, cuts, s):
    """Every split of every node tried by adding up rows; sums in whole numbers as the library's."""
    weight = (y == 0).sum() / (y == 1).sum()
    margin, trees, unit = np.zeros(len(y)), [], 2.0**24
    for _ in range(s.rounds):
        p = 1 / (1 + np.exp(-margin))
        w = np.where(y == 1, weight, 1.0)
        g, h = np.rint((p - y) * w * unit), np.rint(p * (1 - p) * w * unit)
        tree, place = {}, np.zeros(len(y), int)

        def worth(rows):
            a, b = g[rows].sum() / unit, h[rows].sum() / unit
            return a * a / (b + s.l2)

        for node in range(2 ** (s.depth + 1) - 1):
            own = np.flatnonzero(place == node)
            if not len(own):
                continue
            a, b = g[own].sum() / unit, h[own].sum() / unit
            tree[node] = [None, None, None, -s.step * a / (b + s.l2), 0.0, b]
            if node >= 2**s.depth - 1:
                continue
            best = (bo.LEAST_GAIN, None)
            for f in range(x.shape[1]):
                hole = np.isnan(x[own, f])
                for missing_left in (False, True) if hole.any() else (False,):
                    for cut in cuts[f]:
                        left = np.where(hole, missing_left, x[own, f] <= cut)
                        if min(h[own[left]].sum(), h[own[~left]].sum()) / unit < s.least_cover:
                            continue
                        gain = worth(own[left]) + worth(own[~left]) - worth(own)
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, cut, missing_left, left))
            if best[1]:
                f, cut, missing_left, left = best[1]
                tree[node][:3], tree[node][4] = [f, cut, missing_left], best[0]
                place[own] = np.where(left, 2 * node + 1, 2 * node + 2)
        margin = margin + np.array([tree[k][3] for k in place])
        trees.append(tree)
    return trees, 1 / (1 + np.exp(-margin))


@pytest.mark.parametrize("gather_rows", [0, 100, 10**6])
def test_equals_the_plain_version(spark, gather_rows):
    rows = rows_of(500, 4)
    df = spark.createDataFrame(rows, SCHEMA)
    s = bo.Settings(rounds=4, depth=3, row_share=1.0, column_share=1.0, keep_every=2, gather_rows=gather_rows)
    got = bo.fit(df, None, INPUTS, settings=s).model
    x = np.array([[np.nan if v is None else v for v in r[2:]] for r in rows])
    y = np.array([r[1] for r in rows])
    trees, p = plain_boost(x, y, bo.choose_cuts(df, INPUTS, "trans_num", s), s)
    want = [(t, n, None if v[0] is None else INPUTS[v[0]], v[1], v[2]) for t, tree in enumerate(trees) for n, v in tree.items()]
    table = got.nodes.to_pydict()
    assert sorted(zip(*(table[c] for c in ("tree", "node", "feature", "cut", "missing_left"))), key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])
    at = {(t, n): k for k, (t, n) in enumerate(zip(table["tree"], table["node"]))}
    for t, tree in enumerate(trees):
        for n, v in tree.items():
            k = at[t, n]
            assert table["value"][k] == pytest.approx(v[3]) and table["cover"][k] == pytest.approx(v[5])
            assert v[0] is None or table["gain"][k] == pytest.approx(v[4])
    scores = [r[0] for r in got.score(df).orderBy("trans_num").select("fraud_probability").collect()]
    assert np.allclose(scores, p, atol=1e-12)


def test_model_does_not_depend_on_partitions(table, monkeypatch):
    s = bo.Settings(rounds=5, depth=4)
    one = bo.fit(table.coalesce(1), None, INPUTS, settings=s).model
    monkeypatch.setattr(bo, "BLOCK_ROWS", 100)
    other = bo.fit(table.repartition(9), None, INPUTS, settings=s).model
    assert one.nodes.equals(other.nodes)
    for gather_rows in (0, 300, 1500):
        assert bo.fit(table, None, INPUTS, settings=bo.Settings(rounds=5, depth=4, gather_rows=gather_rows)).model.nodes.equals(one.nodes)
    third = bo.fit(table, None, INPUTS, settings=bo.Settings(rounds=5, depth=4, seed=1)).model
    assert not third.nodes.equals(one.nodes)


@pytest.mark.parametrize("losses, patience, rounds", [
    ([5, 4, 3, 2], 2, 4), ([5, 4, 3, 3.5, 3.6, 1], 2, 3), ([5, 4, 3, 3.5, 1], 2, 5), ([1, 2], 20, 1),
])
def test_best_round(losses, patience, rounds):
    assert bo.best_round(losses, patience) == rounds


def test_fitting_ends_early(table):
    train, validation = table.where("trans_num % 3 > 0"), table.where("trans_num % 3 = 0")
    got = bo.fit(train, validation, INPUTS, settings=bo.Settings(rounds=80, patience=4, depth=4, step=0.5))
    assert len(got.losses) == got.rounds + 4 < 80 and got.model.rounds == got.rounds
    assert got.losses[got.rounds - 1] == min(got.losses)
    p = got.model.score(validation).select(F.when(F.col("is_fraud") == 1, F.col("fraud_probability")).otherwise(1 - F.col("fraud_probability")).alias("p"))
    assert p.agg(F.avg(-F.log("p"))).first()[0] == pytest.approx(min(got.losses), abs=1e-5)
    whole = bo.fit(train, validation, INPUTS, settings=bo.Settings(rounds=3, patience=4, depth=4, step=0.5))
    assert len(whole.losses) == 3


def test_a_broken_fit_goes_on(spark, table, tmp_path, monkeypatch):
    train, validation = table.where("trans_num % 3 > 0"), table.where("trans_num % 3 = 0")
    s = bo.Settings(rounds=9, patience=20, depth=3, keep_every=2)
    want = bo.fit(train, validation, INPUTS, settings=s)
    real, grown = bo._Grower.grow, []

    def grow(self, number, *a):
        if number == 5 and len(grown) == 5:
            raise RuntimeError("executor gone")
        grown.append(number)
        return real(self, number, *a)

    monkeypatch.setattr(bo._Grower, "grow", grow)
    with pytest.raises(RuntimeError, match="executor gone"):
        bo.fit(train, validation, INPUTS, settings=s, folder=str(tmp_path / "state"))
    grown.append(None)
    got = bo.fit(train, validation, INPUTS, settings=s, folder=str(tmp_path / "state"))
    assert grown[:7] == [0, 1, 2, 3, 4, None, 4] and grown[7:12] == [5, 6, 7, 8, 9]
    assert got.model.nodes.equals(want.model.nodes) and got.losses == want.losses
    other = bo.fit(train, validation, INPUTS, settings=bo.Settings(rounds=2, patience=20, depth=2), folder=str(tmp_path / "state"))
    assert other.rounds <= 2


def test_gain_importances(spark, table):
    model = bo.fit(table, None, INPUTS, settings=bo.Settings(rounds=6, depth=3)).model
    nodes = model.nodes.to_pylist()
    for kind, value in (("gain", np.mean), ("total_gain", np.sum), ("weight", len)):
        found = {f: float(value([n["gain"] for n in nodes if n["feature"] == f] or [0])) if any(n["feature"] == f for n in nodes) else 0.0 for f in INPUTS}
        got = {r["feature"]: r["importance"] for r in model.importances(spark, kind).collect()}
        assert got == {f: pytest.approx(v / sum(found.values())) for f, v in found.items()}


def test_missing_values_have_a_side(spark):
    """The label is whether the value is missing."""
    rows = [(i, int(i % 4 == 0), None if i % 4 == 0 else float(i % 7)) for i in range(400)]
    df = spark.createDataFrame(rows, "trans_num long, is_fraud int, amt double")
    model = fit_boosted_trees(df, None, ["amt"], rounds=20, depth=2, row_share=1.0, step=0.5).trees
    s = {r["is_fraud"]: r["p"] for r in model.score(df).groupBy("is_fraud").agg(F.avg("fraud_probability").alias("p")).collect()}
    assert s[1] > 0.9
    nan = spark.createDataFrame([(1, float("nan")), (2, None)], "trans_num long, amt double")
    assert len({r[0] for r in model.score(nan).select("fraud_probability").collect()}) == 1


def test_stored_trees_score_alike(spark, table, tmp_path):
    model = bo.fit(table, None, INPUTS, settings=bo.Settings(rounds=3, depth=5)).model
    model.save(str(tmp_path / "m"))
    back = bo.BoostedTrees.load(spark, str(tmp_path / "m"))
    a, b = (sorted(m.score(table).select("trans_num", "fraud_probability").collect()) for m in (model, back))
    assert a == b and back.features == INPUTS


def test_constant_features_and_few_rows(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (2, 1, 1.0), (3, 0, 1.0)], "trans_num long, is_fraud int, amt double")
    model = bo.fit(df, None, ["amt"], settings=bo.Settings(rounds=2)).model
    assert model.nodes.num_rows == 2 and model.score(df).count() == 3
    with pytest.raises(ValueError, match="both classes"):
        bo.fit(df.where("is_fraud = 0"), None, ["amt"])


def test_no_blocks_are_left_behind(spark, table):
    from fraud_engine.session import folders_in, run_folder

    bo.fit(table, None, INPUTS, settings=bo.Settings(rounds=3, depth=2, keep_every=1))
    left = [b for p in folders_in(spark, run_folder(spark)) if "/boosting-" in p for b in folders_in(spark, p, "_SUCCESS")]
    assert left == []


@pytest.mark.parametrize("nodes", [1, 3])
def test_sums_of_narrow_and_wide_features(nodes):
    """Flags that are mostly 0, mostly 1, often missing or of one value, beside wide features; some columns are not drawn."""
    rng = np.random.default_rng(5)
    n, widths = 700, [9, 3, 3, 4, 2, 3, 200]
    share = {1: [0, 0.95, 0.05], 2: [0, 0.02, 0.98], 3: [0.5, 0.2, 0.2, 0.1], 4: [0, 1], 5: [1 / 3, 1 / 3, 1 / 3]}
    bins = np.stack([rng.choice(w, n, p=share.get(f)) for f, w in enumerate(widths)]).astype(np.uint8)
    grid = bo._Grid(np.concatenate([[0], np.cumsum(widths)]), 1.0, bo.Settings())
    rows, columns = np.flatnonzero(rng.random(n) < 0.6), np.array([0, 1, 2, 3, 5, 6])
    at, g, h = rng.integers(0, nodes, len(rows)), rng.integers(-(2**40), 2**40, len(rows)), rng.integers(0, 2**40, len(rows))
    want = np.zeros((3, nodes, sum(widths)), np.int64)
    for f in columns:
        for r, k, a, b in zip(rows, at, g, h):
            want[:, k, grid.first[f] + bins[f, r]] += [a, b, 1]
    assert (grid.sums(bins, rows, at, nodes, (g.astype(float), h.astype(float)), columns) == want).all()


@pytest.mark.parametrize("gather_rows, jobs, stages", [(0, 6, 6), (10**6, 1, 2)])
def test_a_tree_takes_few_jobs(spark, table, gather_rows, jobs, stages):
    """One stage for each level that is counted, two for the rows that are sent; every stage has a fixed cost."""
    s = bo.Settings(rounds=1, depth=6, gather_rows=gather_rows)
    sc, real, seen = spark.sparkContext, bo._Grower.grow, []

    def grow(self, *a):
        group = f"tree-{gather_rows}-{len(seen)}"
        sc.setJobGroup(group, group)
        self.held.count()
        before = len(sc.statusTracker().getJobIdsForGroup(group))
        out = real(self, *a)
        own = sc.statusTracker().getJobIdsForGroup(group)
        sc.setLocalProperty("spark.jobGroup.id", None)
        seen.append((len(own) - before, [len(sc.statusTracker().getJobInfo(j).stageIds) for j in own]))
        return out

    with pytest.MonkeyPatch.context() as m:
        m.setattr(bo._Grower, "grow", grow)
        bo.fit(table.coalesce(4), None, INPUTS, settings=s)
    assert seen[0][0] <= jobs and sum(seen[0][1]) <= stages + 1  # one of the count before


def test_levels_that_split_as_before_take_no_pass(spark, table, monkeypatch):
    """Without gathering, a tree takes a pass for each level; the uppermost ones are counted together where they split as before."""
    s = bo.Settings(rounds=8, depth=4, gather_rows=0, column_share=1.0)
    passes, real = [], bo._Grower.sums
    monkeypatch.setattr(bo._Grower, "sums", lambda self, *a: passes.append(a[1]) or real(self, *a))
    got = bo.fit(table, None, INPUTS, settings=s).model.nodes
    each = [passes.count(k) for k in range(8)]
    assert each[0] == 4 and max(each) <= 4 and min(each) < 4
    monkeypatch.setattr(bo._Grower, "_guess", lambda self, columns: {})
    passes.clear()
    assert bo.fit(table, None, INPUTS, settings=s).model.nodes.equals(got) and len(passes) == 32


@pytest.mark.parametrize("wrong", [
    {0: (0, 1, False)}, {0: (1, 3, True), 1: (2, 1, False), 2: (0, 9, False)}, {0: (0, 10**6, False), 2: (3, 2, True)}])
def test_wrong_guesses_change_nothing(table, monkeypatch, wrong):
    s = bo.Settings(rounds=3, depth=4, gather_rows=400)
    want = bo.fit(table, None, INPUTS, settings=s).model.nodes
    monkeypatch.setattr(bo._Grower, "_guess", lambda self, columns: dict(wrong))
    assert bo.fit(table, None, INPUTS, settings=s).model.nodes.equals(want)


def test_margins_are_rarely_written(table, monkeypatch):
    s = bo.Settings(rounds=12, depth=3, keep_every=2)
    want = bo.fit(table, None, INPUTS, settings=bo.Settings(rounds=12, depth=3, keep_every=100)).model.nodes
    real, written = bo._Grower._write, []
    monkeypatch.setattr(bo._Grower, "_write", lambda self, number: written.append(number) or real(self, number))
    assert bo.fit(table, None, INPUTS, settings=s).model.nodes.equals(want) and written == [0, 10]


def test_rows_of_one_task_take_few_jobs(table, monkeypatch):
    """Where the root goes to one task, a job grows the trees of all rounds up to the next store, another judges them."""
    from pyspark import RDD

    train, validation = table.where("trans_num % 3 > 0"), table.where("trans_num % 3 = 0")
    counted = bo.fit(train, validation, INPUTS, settings=bo.Settings(rounds=12, depth=3, keep_every=5, gather_rows=0))
    jobs, real = [], RDD.collect
    monkeypatch.setattr(RDD, "collect", lambda self: jobs.append(1) or real(self))
    got = bo.fit(train, validation, INPUTS, settings=bo.Settings(rounds=12, depth=3, keep_every=5))
    assert got.model.nodes.equals(counted.model.nodes) and got.losses == counted.losses and len(got.losses) == 12
    assert len(jobs) <= 7  # two for each five rounds, one for the last loss


FLAGS = [f"TXNctg_{k}" for k in range(6)]


def flagged_rows(n, clash=()):
    """Rows with the flags of one column; the rows of `clash` have two."""
    rng = np.random.default_rng(8)
    out = []
    for i in range(n):
        own = int(rng.integers(0, 8))
        flags = [float(k == own or (i in clash and k == (own + 1) % 6)) for k in range(6)]
        amt = None if rng.random() < 0.1 else float(np.round(rng.normal(60, 30)))
        out.append((i, int(rng.random() < 0.1 + 0.05 * own), amt, *flags))
    return out


def flagged_table(spark, n, clash=()):
    return spark.createDataFrame(flagged_rows(n, clash), f"trans_num long, is_fraud int, amt double, {', '.join(f'{c} double' for c in FLAGS)}")


def test_flags_of_a_column_share_a_byte(spark):
    df, s = flagged_table(spark, 600), bo.Settings()
    seen = bo._cut_rows(df, ["amt", *FLAGS], "trans_num", s)
    cuts = bo._cuts_of(seen, s)
    bins = bo._bins(seen, cuts)
    layout = bo._Layout.fit(bins, bo._widths(cuts))
    held = layout.pack(bins)
    assert held.shape == (2, 600) and (layout.unpack(held) == bins).all()
    rows = df.selectExpr("*", "0 as _role")
    block = bo.binned(rows.coalesce(1), ["amt", *FLAGS], "trans_num", cuts, layout).first()
    assert block["layout"] == bo._BUNDLED and len(block["bins"]) == 2 * 600
    # Sums by byte give those by bin.
    grid, rng = bo._Grid(np.concatenate([[0], np.cumsum(bo._widths(cuts))]), 1.0, s), np.random.default_rng(3)
    use, columns = np.flatnonzero(rng.random(600) < 0.7), np.array([0, 1, 3, 4, 6])
    at, g, h = rng.integers(0, 3, len(use)), rng.integers(-(2**30), 2**30, len(use)).astype(float), rng.integers(0, 2**30, len(use)).astype(float)
    want = grid.sums(bins, use, at, 3, (g, h), columns)
    assert (grid.spread(layout, grid.coded(layout, held, use, at, 3, (g, h), columns), columns) == want).all()


@pytest.mark.parametrize("gather_rows", [0, 200, 10**6])
def test_rows_with_two_flags_change_nothing(spark, monkeypatch, gather_rows):
    """Flags that exclude each other in the rows of the cuts, not in all: such blocks keep a byte for each feature."""
    inputs = ["amt", *FLAGS]
    df = flagged_table(spark, 3000, clash={7, 1500, 2222})
    s = bo.Settings(rounds=4, depth=4, gather_rows=gather_rows, cut_rows=500, keep_every=2)
    train, validation = df.where("trans_num % 4 > 0").repartition(7, "trans_num"), df.where("trans_num % 4 = 0")
    kinds, real = set(), bo._Grower._write

    def write(self, number):
        real(self, number)
        kinds.update(r["layout"] for r in self.blocks.select("layout").collect())

    monkeypatch.setattr(bo._Grower, "_write", write)
    got = bo.fit(train, validation, inputs, settings=s)
    assert kinds == {bo._BUNDLED, bo._PLAIN}
    monkeypatch.setattr(bo._Layout, "pack", lambda self, bins: None)
    want = bo.fit(train, validation, inputs, settings=s, cuts=bo.choose_cuts(train, inputs, "trans_num", s))
    assert got.model.nodes.equals(want.model.nodes) and got.losses == want.losses


def test_blocks_are_dealt_evenly(spark, table, monkeypatch):
    """A pass ends with its slowest task: blocks are dealt to as many tasks as cores, whatever the files."""
    seen, real = [], bo._Grower._write

    def write(self, number):
        real(self, number)
        seen.append(self.held.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())

    monkeypatch.setattr(bo._Grower, "_write", write)
    bo.fit(table.repartition(10), None, INPUTS, settings=bo.Settings(rounds=1, depth=2))
    cores = spark.sparkContext.defaultParallelism
    assert len(seen[0]) == cores and sum(seen[0]) == 10 and max(seen[0]) - min(seen[0]) <= 2


def test_few_trees_are_walked_in_a_pass(table, monkeypatch):
    """Where trees are counted by passes, the held margins are brought up to date between two stores, and the model stays the same."""
    train, validation = table.where("trans_num % 3 > 0"), table.where("trans_num % 3 = 0")
    want = bo.fit(train, validation, INPUTS, settings=bo.Settings(rounds=14, depth=3, row_share=0.7, keep_every=7))
    walked, real = [], bo._Grower.sums
    monkeypatch.setattr(bo._Grower, "sums", lambda self, *a: walked.append(len(self.trees)) or real(self, *a))
    got = bo.fit(train, validation, INPUTS, settings=bo.Settings(rounds=14, depth=3, row_share=0.7, keep_every=12, gather_rows=0))
    assert got.model.nodes.equals(want.model.nodes) and got.losses == want.losses
    assert max(walked) < bo._FRESH
