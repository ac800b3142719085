"""SQL that trains and applies the small models of `models`, written out level by level."""

from __future__ import annotations

from .models import BOOST, CUTS, RUN_CUTS, SAMPLE, SEED, TREES
from .oracle import _R

_NAMES = list(CUTS)
_UNIT = "16777216e0"
def _gain(g: str, h: str) -> str:
    return f"({g}) * ({g}) / (({h}) + {BOOST.l2!r})"


def _boosting(cuts: dict[str, list[float]] = CUTS) -> str:
    """CTEs: nodes (t, node, f, cut, missing_left, gain, g, h) of every tree, and margins (trans_num, m)."""
    long = " UNION ALL ".join(f"SELECT trans_num, {k} AS f, CAST({c} AS DOUBLE) AS x FROM rows_" for k, c in enumerate(cuts))
    cut_rows = ", ".join(f"({k}, {n}, {cut!r})" for k, own in enumerate(cuts.values()) for n, cut in enumerate(own))
    ctes = [f"long AS ({long})", f"cuts(f, c, cut) AS (VALUES {cut_rows})",
            "ratio AS (SELECT count_if(is_fraud = 0) / count_if(is_fraud = 1) AS w FROM rows_)",
            "m0 AS (SELECT trans_num, is_fraud, 0e0 AS m FROM rows_)"]
    for t in range(BOOST.rounds):
        ctes.append(f"""d{t} AS (
            SELECT trans_num, CAST(round_even((p - is_fraud) * w * {_UNIT}, 0) AS BIGINT) AS g,
                CAST(round_even(p * (1 - p) * w * {_UNIT}, 0) AS BIGINT) AS h
            FROM (SELECT trans_num, is_fraud, 1 / (1 + exp(-m)) AS p, CASE WHEN is_fraud = 1 THEN w ELSE 1e0 END AS w FROM m{t}, ratio))""")
        ctes.append(f"at{t}_0 AS (SELECT trans_num, g, h, 0 AS node FROM d{t})")
        for level in range(BOOST.depth):
            here = f"{t}_{level}"
            ctes.append(f"""cand{here} AS (
                SELECT node, f, c, cut, ml, sum(g) AS g, sum(h) AS h,
                    sum(CASE WHEN coalesce(x <= cut, ml) THEN g ELSE 0 END) AS gl, sum(CASE WHEN coalesce(x <= cut, ml) THEN h ELSE 0 END) AS hl,
                    count_if(x IS NULL) AS missing
                FROM at{here} JOIN long USING (trans_num) JOIN cuts USING (f), (VALUES (FALSE), (TRUE)) AS s(ml)
                WHERE node >= {2 ** level - 1} GROUP BY node, f, c, cut, ml)""")
            ctes.append(f"""gains{here} AS (
                SELECT *, {_gain('gl', 'hl')} + {_gain('g - gl', 'h - hl')} - {_gain('g', 'h')} AS gain
                FROM (SELECT node, f, c, cut, ml, missing, g / {_UNIT} AS g, h / {_UNIT} AS h, gl / {_UNIT} AS gl, hl / {_UNIT} AS hl FROM cand{here}))""")
            ctes.append(f"""best{here} AS (
                SELECT node, f, cut, ml, gain FROM gains{here}
                WHERE gain > 1e-6 AND hl >= {BOOST.least_cover!r} AND h - hl >= {BOOST.least_cover!r} AND (missing > 0 OR NOT ml)
                QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, ml, c) = 1)""")
            ctes.append(f"""at{t}_{level + 1} AS (
                SELECT a.trans_num, g, h, CASE WHEN b.node IS NULL THEN a.node
                    WHEN coalesce(x <= cut, ml) THEN 2 * a.node + 1 ELSE 2 * a.node + 2 END AS node
                FROM at{here} a LEFT JOIN best{here} b ON a.node = b.node LEFT JOIN long l ON l.trans_num = a.trans_num AND l.f = b.f)""")
        # The nodes that rows pass: all at their level, and the leaves they stay in.
        passed = " UNION ".join(f"SELECT trans_num, g, h, node FROM at{t}_{level}" for level in range(BOOST.depth + 1))
        splits = " UNION ALL ".join(f"SELECT * FROM best{t}_{level}" for level in range(BOOST.depth))
        ctes.append(f"""nodes{t} AS (
            SELECT {t} AS t, node, f, cut, ml, gain, sum(g) / {_UNIT} AS g, sum(h) / {_UNIT} AS h
            FROM ({passed}) LEFT JOIN ({splits}) USING (node) GROUP BY ALL)""")
        ctes.append(f"""m{t + 1} AS (
            SELECT m.trans_num, is_fraud, m + (-{BOOST.step!r} * g / (h + {BOOST.l2!r})) AS m
            FROM m{t} m JOIN (SELECT trans_num, node FROM at{t}_{BOOST.depth}) USING (trans_num) JOIN nodes{t} USING (node))""")
    ctes.append("nodes AS (" + " UNION ALL ".join(f"SELECT * FROM nodes{t}" for t in range(BOOST.rounds)) + ")")
    return _R + ",\n" + ",\n".join(ctes)


_NAMED = "CASE f " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(_NAMES)) + " END"


def _draw(*parts: str) -> str:
    told = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST(('0x' || substr(md5({told}), 1, 13)) AS BIGINT) / 4503599627370496e0)"


def _mean_path(n: str) -> str:
    return f"(CASE WHEN {n} > 2 THEN 2 * (ln({n} - 1e0) + 0.5772156649015329e0) - 2 * ({n} - 1e0) / {n} WHEN {n} = 2 THEN 1e0 ELSE 0e0 END)"


def _isolation() -> str:
    """CTEs: nodes (tree, node, feature, threshold, n, depth, impurity) and rows2 (trans_num, is_fraud, x)."""
    depth = (SAMPLE - 1).bit_length()
    columns = ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0e0)" for c in _NAMES)
    ctes = [f"rows2 AS (SELECT trans_num, is_fraud, [{columns}] AS x FROM rows_)", f"""drawn AS (
        SELECT tree, trans_num, x, CAST(('0x' || substr(md5('sample:' || tree || ':' || trans_num), 1, 13)) AS BIGINT) AS o
        FROM rows2, range({TREES}) AS r(tree)
        QUALIFY row_number() OVER (PARTITION BY tree ORDER BY o) <= {SAMPLE})""",
        f"at0 AS (SELECT tree, 0 AS node, x, {_draw(str(SEED), 'tree', chr(39) + 'y' + chr(39), 'o')} AS y FROM drawn)"]
    for level in range(depth + 1):
        lows = ", ".join(f"min(x[{k + 1}])" for k in range(len(_NAMES)))
        highs = ", ".join(f"max(x[{k + 1}])" for k in range(len(_NAMES)))
        ctes.append(f"""stat{level} AS (
            SELECT tree, node, count(*) AS n, var_pop(y) AS impurity, [{lows}] AS lo, [{highs}] AS hi FROM at{level} GROUP BY tree, node)""")
        open_ = f"{level} < {depth}"
        ctes.append(f"""split{level} AS (
            SELECT tree, node, n, impurity, f, CASE WHEN f IS NULL THEN 0e0 ELSE
                lo[f] + {_draw(str(SEED), 'tree', 'node', '1')} * (hi[f] - lo[f]) END AS threshold
            FROM (SELECT *, CASE WHEN {open_} AND len(able) > 0
                THEN able[CAST(floor({_draw(str(SEED), 'tree', 'node', '0')} * len(able)) AS INTEGER) + 1] END AS f
                FROM (SELECT *, list_filter([1, 2, 3], lambda k: hi[k] > lo[k]) AS able FROM stat{level})))""")
        ctes.append(f"""at{level + 1} AS (
            SELECT a.tree, CASE WHEN x[f] <= threshold THEN 2 * a.node + 1 ELSE 2 * a.node + 2 END AS node, x, y
            FROM at{level} a JOIN split{level} s ON a.tree = s.tree AND a.node = s.node WHERE f IS NOT NULL)""")
    ctes.append("nodes AS (" + " UNION ALL ".join(
        f"SELECT tree, node, CASE WHEN f IS NULL THEN -1 ELSE f - 1 END AS feature, threshold, n, {k} AS depth, impurity FROM split{k}"
        for k in range(depth + 1)) + ")")
    return _R + ",\n" + ",\n".join(ctes)


def _walk() -> str:
    depth = (SAMPLE - 1).bit_length()
    steps = [f"w0 AS (SELECT trans_num, is_fraud, x, tree, 0 AS node FROM rows2, range({TREES}) AS r(tree))"]
    for k in range(depth):
        steps.append(f"""w{k + 1} AS (
            SELECT trans_num, is_fraud, x, w.tree, CASE WHEN feature < 0 THEN w.node WHEN x[feature + 1] <= threshold THEN 2 * w.node + 1
                ELSE 2 * w.node + 2 END AS node
            FROM w{k} w JOIN nodes USING (tree, node))""")
    root = "(SELECT max(n) FROM nodes WHERE node = 0)"
    return ",\n" + ",\n".join(steps) + f"""
        SELECT trans_num, is_fraud, round(-(2 ** (-avg(depth + {_mean_path('n')}) / {_mean_path(root)})), 6) AS score
        FROM w{depth} JOIN nodes USING (tree, node) GROUP BY trans_num, is_fraud"""


_NUMBERS = ", ".join(f"({k}, '{c}')" for k, c in enumerate(_NAMES))

MODEL_ORACLE = {
    "run_flagged": _boosting(RUN_CUTS) + f""", flagged AS (
          SELECT trans_num, is_fraud, 1 / (1 + exp(-m)) AS p FROM m{BOOST.rounds} WHERE 1 / (1 + exp(-m)) > 0.5e0)
        SELECT trans_num, round(p, 6) AS fraud_probability, 1 AS is_fraud_predicted, f.is_fraud AS is_fraud_actual,
            amt AS transaction_amount, txn_time AS transaction_hour, count(*) OVER () AS reported_flagged,
            (SELECT count(*) FROM rows_) AS reported_total
        FROM flagged f JOIN rows_ USING (trans_num)""",
    "boosted_nodes": _boosting() + f"""
        SELECT CAST(t AS INTEGER) AS tree, CAST(node AS INTEGER) AS node, {_NAMED} AS feature, CAST(cut AS DOUBLE) AS cut,
            CASE WHEN f IS NOT NULL THEN ml END AS missing_left,
            CAST(CASE WHEN f IS NOT NULL THEN 2 * node + 1 END AS INTEGER) AS left, CAST(CASE WHEN f IS NOT NULL THEN 2 * node + 2 END AS INTEGER) AS right,
            round(-{BOOST.step!r} * g / (h + {BOOST.l2!r}), 6) AS value, round(gain, 6) AS gain, round(h, 6) AS cover FROM nodes""",
    "boosted_scores": _boosting() + f"""
        SELECT trans_num, is_fraud, round(1 / (1 + exp(-m)), 6) AS fraud_probability, CAST(1 / (1 + exp(-m)) > 0.5e0 AS INTEGER) AS prediction
        FROM m{BOOST.rounds}""",
    "boosted_importances": _boosting() + f""", worth AS (SELECT {_NAMED} AS feature, avg(gain) AS g FROM nodes WHERE f IS NOT NULL GROUP BY f)
        SELECT name AS feature, round(coalesce(g, 0e0) / (SELECT sum(g) FROM worth), 6) AS importance
        FROM (VALUES {_NUMBERS}) AS n(k, name) LEFT JOIN worth ON name = feature""",
    "isolation_nodes": _isolation() + """
        SELECT CAST(tree AS INTEGER) AS tree, CAST(node AS INTEGER) AS node, CAST(feature AS INTEGER) AS feature, round(threshold, 6) AS threshold,
            CAST(n AS INTEGER) AS n, CAST(depth AS INTEGER) AS depth, round(impurity, 6) AS impurity FROM nodes""",
    "isolation_scores": _isolation() + _walk(),
    "isolation_importances": _isolation() + f""", gained AS (
        SELECT p.tree, p.feature, p.n * p.impurity - l.n * l.impurity - r.n * r.impurity AS gain
        FROM nodes p JOIN nodes l ON l.tree = p.tree AND l.node = 2 * p.node + 1 JOIN nodes r ON r.tree = p.tree AND r.node = 2 * p.node + 2
        WHERE p.feature >= 0),
        shares AS (SELECT tree, feature, sum(gain) / sum(sum(gain)) OVER (PARTITION BY tree) AS share FROM gained GROUP BY tree, feature)
        SELECT name AS feature, round(coalesce(sum(share), 0e0) / {TREES}, 6) AS importance
        FROM (VALUES {_NUMBERS}) AS n(k, name) LEFT JOIN shares ON k = feature GROUP BY name""",
    "reconstruction_errors": _R + """, fit AS (
        SELECT avg(txn_time) AS tm, stddev_samp(txn_time) AS ts, avg(amt) AS am, stddev_samp(amt) AS asd FROM rows_),
        z AS (SELECT trans_num, is_fraud, (txn_time - tm) / ts AS u, (amt - am) / asd AS v FROM rows_, fit),
        spread AS (SELECT var_samp(u) AS a, covar_samp(u, v) AS b, var_samp(v) AS c FROM z WHERE is_fraud = 0),
        -- The eigenvector of the larger eigenvalue of ((a, b), (b, c)).
        axis AS (SELECT 0.5e0 * atan2(2 * b, a - c) AS angle FROM spread)
        SELECT trans_num, is_fraud, round(u, 6) AS txn_time_scaled,
            round(greatest((u * u + v * v - (u * cos(angle) + v * sin(angle)) ** 2) / 2, 0e0), 6) AS error FROM z, axis""",
}
