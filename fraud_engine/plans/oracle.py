"""The same results as ANSI SQL, for the comparison with another engine.

Plain SQL written from the definitions; where a list of columns repeats, a loop writes it.
"""

from __future__ import annotations

from .. import schema as S
from . import txn

_K = "CAST(regexp_extract(e.props, '[0-9]+', 0) AS INT)"
_LAT = "-4e1 + 3e0 * c.c_nationkey + (c.c_custkey % 17) / 1e1"
_LONG = "-1e2 + 4e0 * c.c_nationkey + (c.c_custkey % 13) / 1e1"

_TXN = f"""txn AS (
  SELECT e.event_id AS trans_num, e.ts AS trans_date_trans_time, e.user_id AS cc_num,
    CASE e.event_type WHEN 'view' THEN 'gas_transport' WHEN 'click' THEN 'shopping_net'
      WHEN 'signup' THEN 'misc,net' WHEN 'purchase' THEN 'grocery_pos' ELSE 'travel' END AS category,
    e.value AS amt, n.n_name AS state, {_LAT} AS lat, {_LONG} AS long,
    CASE {_K} % 6 WHEN 0 THEN 'Engineer, electronics' WHEN 1 THEN 'Lawyer' WHEN 2 THEN 'Surgeon'
      WHEN 3 THEN 'Private music teacher' WHEN 4 THEN 'Unlisted job' ELSE NULL END AS job,
    DATE '1920-01-01' + CAST((c.c_custkey * 733) % 32000 AS INT) AS dob,
    {_LAT} + ({_K} - 50) / 1e2 AS merch_lat,
    {_LONG} + (e.event_id % 100 - 50) / 1e2 AS merch_long,
    CASE WHEN {_K} >= 97 OR (e.event_type = 'error' AND e.value > 150e0) THEN 1 ELSE 0 END AS is_fraud,
    least(1e0, e.value / 3e2) AS score
  FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey
    LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

_ROWS = """rows_ AS (
  SELECT trans_num, cc_num, is_fraud, score, amt, state,
    CAST(hour(trans_date_trans_time) AS INT) AS txn_time,
    replace(category, ',', ' -') AS category, replace(job, ',', ' -') AS job,
    CAST(year(dob) AS INT) AS birth_year,
    2 * atan2(sqrt(a), sqrt(abs(1 - a))) * 6371 AS distance
  FROM (SELECT *, sin(radians(merch_lat - lat) / 2) ** 2
          + cos(radians(lat)) * cos(radians(merch_lat)) * sin(radians(merch_long - long) / 2) ** 2 AS a
        FROM txn))"""

_MEANS = ", ".join(
    f"CAST(round(CAST({f} AS DECIMAL(38, 9)), 2) AS DOUBLE) AS {name}" for name, f in (
        ("avg_txn_amt", "avg(amt)"), ("stddev_txn_amt", "stddev_samp(amt)"),
        ("avg_txn_time", "avg(txn_time)"), ("avg_merchant_distance", "avg(distance)")))
_METRICS = f"""metrics AS (
  SELECT cc_num, {_MEANS} FROM rows_ GROUP BY cc_num)"""

_JOBS = "jobs(job, job_category) AS (VALUES " + ", ".join(
    f"('{job}', '{category}')" for category, names in txn.JOB_CATEGORY.items() for job in names) + ")"


def _flag(condition: str, name: str) -> str:
    return f'CASE WHEN {condition} THEN 1 ELSE 0 END AS "{name}"'


_STATES = [f"NATION_{i}" for i in range(25)]
_CATEGORY_FLAGS = [_flag(f"category = '{c}'", f"TXNctg_{c}") for c in txn.CATEGORIES]
_STATE_FLAGS = [_flag(f"state = '{s}'", f"state_{s}") for s in _STATES]
_JOB_FLAGS = [_flag(f"job_category = '{j}'", f"JOBctg_{j}") for j in S.JOB_CATEGORIES]
_DECADE_FLAGS = [_flag(f"birth_year BETWEEN {y} AND {y + 9}", d) for d, y in S.DECADES.items()]

_FLAGS = f"""flags AS (
  SELECT is_fraud, trans_num, txn_time, amt, score,
    {', '.join(_CATEGORY_FLAGS + _JOB_FLAGS + _DECADE_FLAGS)}
  FROM rows_ LEFT JOIN jobs USING (job))"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


_T = _with(_TXN)
_R = _with(_TXN, _ROWS)
_RM = _with(_TXN, _ROWS, _METRICS)
_F = _with(_TXN, _ROWS, _JOBS, _FLAGS)
_EXPL = _with(_TXN, _ROWS, _METRICS, _JOBS)


def _unpivot(names: list[str], prefix: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS category, CAST(coalesce(sum(CASE WHEN is_fraud = 1 THEN \"{n}\" END), 0) AS BIGINT) AS n "
        "FROM flags" for n in names)


_CATEGORY_COUNTS = _unpivot(S.category_columns(txn.CATEGORIES))
_JOB_COUNTS = _unpivot(S.job_columns(S.JOB_CATEGORIES))
_AGE_COUNTS = _unpivot(list(S.DECADES))


def _report(pred: str) -> str:
    """Rows of the class report for a 0/1 prediction expression over `txn`."""
    cells = ", ".join(
        f"CAST(count_if(is_fraud = {a} AND {pred} = {g}) AS BIGINT) AS {n}"
        for n, a, g in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1)))
    return f"""cells AS (SELECT {cells} FROM txn),
per_class AS (
  SELECT '0' AS class, coalesce(tn / nullif(tn + fn, 0), 0e0) AS precision,
    coalesce(tn / nullif(tn + fp, 0), 0e0) AS recall, tn + fp AS support FROM cells
  UNION ALL SELECT '1', coalesce(tp / nullif(tp + fp, 0), 0e0),
    coalesce(tp / nullif(tp + fn, 0), 0e0), tp + fn FROM cells),
scored AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0e0) AS f1
  FROM per_class)"""


_PRED = "CAST(score > 0.5e0 AS INT)"
_SWEEP = f"""counts AS (
  SELECT threshold,
    CAST(count_if(is_fraud = 1 AND score > threshold) AS BIGINT) AS tp,
    CAST(count_if(is_fraud = 0 AND score > threshold) AS BIGINT) AS fp,
    CAST(count_if(is_fraud = 1 AND NOT score > threshold) AS BIGINT) AS fn,
    CAST(count_if(is_fraud = 0 AND NOT score > threshold) AS BIGINT) AS tn
  FROM txn, (VALUES {', '.join(f'({i}e-1)' for i in range(1, 10))}) AS t(threshold)
  GROUP BY threshold),
ratios AS (
  SELECT *, coalesce(tp / nullif(tp + fp, 0), 0e0) AS p, coalesce(tp / nullif(tp + fn, 0), 0e0) AS r
  FROM counts),
sweep AS (
  SELECT CAST(threshold AS DOUBLE) AS threshold, round(p, 6) AS precision, round(r, 6) AS recall,
    round(coalesce(2 * p * r / nullif(p + r, 0), 0e0), 6) AS f1, fp AS false_positives,
    round(coalesce(fp / nullif(fp + tn, 0), 0e0), 6) AS false_positive_rate,
    tp AS frauds_caught, fn AS frauds_missed
  FROM ratios)"""

_CURVE = """by_score AS (
  SELECT score AS threshold, count_if(is_fraud = 1) AS pos, count_if(is_fraud = 0) AS neg
  FROM txn GROUP BY score),
curve AS (
  SELECT threshold, pos, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS total
  FROM by_score WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))"""


def _model(name: str, pred: str) -> str:
    return f"""SELECT '{name}' AS model, is_fraud, {pred} AS pred FROM txn"""


_COMPARED = "preds AS (" + " UNION ALL ".join([
    _model("score above 0.5", "score > 0.5e0"), _model("score above 0.2", "score > 0.2e0"),
    _model("travel", "category = 'travel'")]) + """),
pr AS (
  SELECT model, coalesce(count_if(pred AND is_fraud = 1) / nullif(count_if(pred), 0), 0e0) AS precision,
    coalesce(count_if(pred AND is_fraud = 1) / nullif(count_if(is_fraud = 1), 0), 0e0) AS recall
  FROM preds GROUP BY model),
compared AS (
  SELECT model, round(precision, 6) AS precision, round(recall, 6) AS recall,
    round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0e0), 6) AS f1
  FROM pr)"""


def _h(cut: str) -> str:
    return f"substr(md5(concat('42', CAST(trans_num AS VARCHAR))), 1, 8) < '{cut}'"


_EXACT = """ranked AS (
  SELECT trans_num, is_fraud,
    row_number() OVER (PARTITION BY is_fraud ORDER BY md5(concat('42', CAST(trans_num AS VARCHAR)))) AS place,
    count(*) OVER (PARTITION BY is_fraud) AS size
  FROM txn),
exact AS (
  SELECT trans_num, is_fraud, CASE WHEN place <= floor(size * 0.2e0 + 0.5e0) THEN 'test'
    WHEN place <= floor(size * 0.4e0 + 0.5e0) THEN 'validation' ELSE 'train' END AS split
  FROM ranked)"""


def _case(pairs: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{t}'" for c, t in pairs) + f" ELSE '{default}' END"


def _clock(h: str) -> str:
    return f"""CASE WHEN {h} >= 0 AND {h} < 6
        THEN concat(CAST(CAST(trunc({h}) AS INT) AS VARCHAR), ':00 AM (early morning)')
      WHEN {h} >= 6 AND {h} < 12 THEN concat(CAST(CAST(trunc({h}) AS INT) AS VARCHAR), ':00 AM')
      WHEN {h} > 12 THEN concat(CAST(CAST(trunc({h} - 12) AS INT) AS VARCHAR), ':00 PM')
      ELSE '12:00 PM' END"""


_CONTEXT = f"""context AS (
  SELECT *, {_clock('time')} AS time_text, {_clock('user_avg_time')} AS usual_time_text,
    CASE WHEN abs(time - user_avg_time) > 6 THEN 'significant'
      WHEN abs(time - user_avg_time) > 3 THEN 'moderate' ELSE 'minor' END AS time_anomaly,
    CASE WHEN amount_ratio > 1 THEN printf('%.1fx', amount_ratio) ELSE 'normal' END AS amount_anomaly
  FROM (
    SELECT trans_num, amt AS amount, txn_time AS time,
      {_case([("category = 'gas_transport'", 'Gas/Transport'),
              ("category = 'grocery_pos'", 'Grocery Store Purchase'),
              ("category = 'misc -net'", 'misc -net'),
              ("category = 'shopping_net'", 'Online Shopping'),
              ("category = 'travel'", 'Travel')], 'Unknown Category')} AS category,
      {_case([("job = 'Engineer - electronics'", 'Engineering/Technology'),
              ("job = 'Lawyer'", 'Legal/Government'), ("job = 'Surgeon'", 'Healthcare/Medical'),
              ("job = 'Private music teacher'", 'Education/Teaching')], 'Unknown Profession')} AS job,
      CASE WHEN birth_year BETWEEN 1920 AND 2009
        THEN concat('born in the ', CAST(birth_year - birth_year % 10 AS VARCHAR), 's')
        ELSE 'unknown age group' END AS age_group,
      avg_txn_amt AS user_avg_amount, avg_txn_time AS user_avg_time,
      avg_merchant_distance AS user_avg_distance, score AS fraud_probability,
      CASE WHEN avg_txn_amt > 0 THEN amt / avg_txn_amt ELSE 1e0 END AS amount_ratio
    FROM rows_ LEFT JOIN metrics USING (cc_num) WHERE score > 0.5e0))"""

_PROMPT = """concat(
    'Transaction Details:', chr(10),
    '- Amount: $', printf('%.2f', amount), ' (user''s average: $', printf('%.2f', user_avg_amount), ')', chr(10),
    '- Time: ', time_text, ' (user''s typical: ', usual_time_text, ')', chr(10),
    '- Category: ', category, chr(10),
    '- User Profile: ', job, ' professional, ', age_group, chr(10),
    '- Fraud Confidence: ', printf('%.1f', fraud_probability * 100), '%', chr(10), chr(10),
    'Key Anomalies:', chr(10),
    '- Amount is ', amount_anomaly, ' higher than user''s typical spending', chr(10),
    '- Time difference shows ', time_anomaly, ' deviation from normal patterns', chr(10), chr(10),
    'Explain why this transaction was flagged as fraudulent:')"""
_FALLBACK = """concat('This $', printf('%.2f', amount),
    ' transaction was flagged due to unusual patterns: amount is ', amount_anomaly,
    ' higher than typical spending and occurred at an unusual time (', time_text,
    ' vs user''s normal ', usual_time_text, ').')"""
_SUMMARY = """concat('Amount: $', printf('%.2f', amount), ' | Time: ', time_text, ' | Category: ', category,
    ' | Confidence: ', printf('%.1f', fraud_probability * 100), '%')"""

_REPORT_DOCUMENT = f"""means AS (
  SELECT avg(CASE WHEN is_fraud = 1 THEN amt END) AS fa, avg(CASE WHEN is_fraud = 0 THEN amt END) AS na,
    avg(CASE WHEN is_fraud = 1 THEN txn_time END) AS fh, avg(CASE WHEN is_fraud = 0 THEN txn_time END) AS nh,
    count_if(score > 0.5e0) AS flagged, count(*) AS total
  FROM flags),
jobs_top AS (SELECT * FROM ({_JOB_COUNTS}) ORDER BY n DESC, category LIMIT 5),
categories_top AS (SELECT * FROM ({_CATEGORY_COUNTS}) ORDER BY n DESC, category LIMIT 5),
document AS (
  SELECT 'job_categories' AS section, category AS name, CAST(n AS DOUBLE) AS value FROM jobs_top
  UNION ALL SELECT 'transaction_categories', category, CAST(n AS DOUBLE) FROM categories_top
  UNION ALL SELECT 'age_groups', category, CAST(n AS DOUBLE) FROM ({_AGE_COUNTS})
  UNION ALL SELECT 'amount_analysis', 'fraud_avg', fa FROM means
  UNION ALL SELECT 'amount_analysis', 'normal_avg', na FROM means
  UNION ALL SELECT 'amount_analysis', 'increase_pct', (fa - na) / na * 100 FROM means
  UNION ALL SELECT 'time_analysis', 'fraud_avg_hour', fh FROM means
  UNION ALL SELECT 'time_analysis', 'normal_avg_hour', nh FROM means
  UNION ALL SELECT 'model_performance', 'fraud_detected', CAST(flagged AS DOUBLE) FROM means
  UNION ALL SELECT 'model_performance', 'total_transactions', CAST(total AS DOUBLE) FROM means
  UNION ALL SELECT 'model_performance', 'detection_rate', flagged / total FROM means)"""

_FLAGGED_COLUMNS = ", ".join(
    f'"{c}"' for c in [*S.category_columns(txn.CATEGORIES), *S.job_columns(S.JOB_CATEGORIES), *S.DECADES])

_PAIRS = "pairs AS (SELECT DISTINCT p_type AS job_category, p_name AS job FROM part)"
# The part types of the given tables.
PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
_MATRIX = ", ".join(
    f"coalesce(max(CASE WHEN job_category = '{t}' THEN job END), '') AS \"{t}\"" for t in PART_TYPES)


ORACLE: dict[str, str] = {
    "raw_columns": _T + """SELECT is_fraud, CAST(hour(trans_date_trans_time) AS INT) AS txn_time, cc_num,
        category, amt, state, lat, long, job, CAST(dob AS VARCHAR) AS dob, merch_lat, merch_long, score FROM txn""",
    "hour_of_day": _R + "SELECT trans_num, txn_time FROM rows_",
    "comma_clean": _R + "SELECT trans_num, category, job FROM rows_",
    "dob_decade_flags": _R + f"SELECT trans_num, birth_year, {', '.join(_DECADE_FLAGS)} FROM rows_",
    "txn_distance": _R + "SELECT trans_num, round(distance, 6) AS distance FROM rows_",
    "onehot_category": _R + f"SELECT trans_num, {', '.join(_CATEGORY_FLAGS)} FROM rows_",
    "onehot_state": _R + f"SELECT trans_num, {', '.join(_STATE_FLAGS)} FROM rows_",
    "onehot_job": _with(_TXN, _ROWS, _JOBS)
        + f"SELECT trans_num, {', '.join(_JOB_FLAGS)} FROM rows_ LEFT JOIN jobs USING (job)",
    "vocabulary": _R + """SELECT DISTINCT 'category' AS "column", category AS value FROM rows_
        WHERE category IS NOT NULL
        UNION SELECT DISTINCT 'state', state FROM rows_ WHERE state IS NOT NULL
        UNION SELECT DISTINCT 'job', job FROM rows_ WHERE job IS NOT NULL""",
    "card_metrics": _RM + "SELECT * FROM metrics",
    "txn_with_metrics": _RM + """SELECT trans_num, cc_num, avg_txn_amt, stddev_txn_amt, avg_txn_time,
        avg_merchant_distance FROM rows_ LEFT JOIN metrics USING (cc_num)""",
    "metrics_from_train": _R + f""", parts AS (SELECT *, CASE WHEN {_h('33333333')} THEN 'test'
          WHEN {_h('66666666')} THEN 'validation' ELSE 'train' END AS split FROM rows_),
        fitted AS (SELECT cc_num, {_MEANS} FROM parts WHERE split = 'train' GROUP BY cc_num)
        SELECT trans_num, cc_num, split, avg_txn_amt, stddev_txn_amt, avg_txn_time, avg_merchant_distance
        FROM parts LEFT JOIN fitted USING (cc_num)""",
    "job_category_join": _with(_TXN, _ROWS, _JOBS)
        + "SELECT trans_num, job, job_category FROM rows_ LEFT JOIN jobs USING (job)",
    "lookup_unpivot": """SELECT DISTINCT 'p_name' AS job_category, p_name AS job FROM part
        UNION SELECT DISTINCT 'p_brand', p_brand FROM part
        UNION SELECT DISTINCT 'p_type', p_type FROM part""",
    "lookup_pivot": _with(_PAIRS, """placed AS (
        SELECT job_category, job, row_number() OVER (PARTITION BY job_category ORDER BY job) - 1 AS position
        FROM pairs)""") + f"""SELECT CAST(position AS INT) AS position, {_MATRIX} FROM placed GROUP BY position""",
    "features_full": _with(_TXN, _ROWS, _METRICS, _JOBS)
        + f"""SELECT trans_num, is_fraud, txn_time, amt,
        {', '.join(_CATEGORY_FLAGS + _STATE_FLAGS + _JOB_FLAGS + _DECADE_FLAGS)},
        avg_txn_amt, stddev_txn_amt, avg_txn_time, avg_merchant_distance
        FROM rows_ LEFT JOIN jobs USING (job) LEFT JOIN metrics USING (cc_num)""",
    "confusion": _T + " UNION ALL ".join(
        f"SELECT {a} AS label, {g} AS prediction, count(*) AS n FROM txn WHERE is_fraud = {a} AND {_PRED} = {g}"
        for a in (0, 1) for g in (0, 1)),
    "class_report": _with(_TXN, _report(_PRED)) + """
        SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support
        FROM scored
        UNION ALL SELECT 'accuracy', round((tn + tp) / (tn + fp + fn + tp), 6),
          round((tn + tp) / (tn + fp + fn + tp), 6), round((tn + tp) / (tn + fp + fn + tp), 6),
          tn + fp + fn + tp FROM cells
        UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
          CAST(sum(support) AS BIGINT) FROM scored
        UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
          round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
          CAST(sum(support) AS BIGINT) FROM scored""",
    "threshold_sweep": _with(_TXN, _SWEEP) + "SELECT * FROM sweep",
    "recall_at_thresholds": _with(_TXN, _SWEEP)
        + "SELECT threshold, recall FROM sweep WHERE threshold IN (3e-1, 5e-1, 7e-1)",
    "best_threshold": _with(_TXN, _SWEEP) + "SELECT * FROM sweep ORDER BY f1 DESC, threshold LIMIT 1",
    "default_vs_best": _with(_TXN, _SWEEP) + """
        SELECT 'default' AS setting, threshold, frauds_caught, frauds_missed, false_positives
        FROM sweep WHERE threshold = 5e-1
        UNION ALL SELECT 'chosen', * FROM (
          SELECT threshold, frauds_caught, frauds_missed, false_positives
          FROM sweep ORDER BY f1 DESC, threshold LIMIT 1)""",
    "pr_curve": _with(_TXN, _CURVE) + """
        SELECT threshold, round(tp / (tp + fp), 9) AS precision, round(tp / total, 9) AS recall
        FROM (SELECT round(threshold, 9) AS threshold, CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp,
              CAST(total AS DOUBLE) AS total FROM curve)
        UNION ALL SELECT NULL, 1e0, 0e0""",
    "average_precision": _with(_TXN, _CURVE) + """
        SELECT round(sum(CAST(pos AS DOUBLE) / total * CAST(tp AS DOUBLE) / (tp + fp)), 9) AS average_precision
        FROM curve""",
    "score_histogram": _T + """, ends AS (SELECT min(score) AS lo, (max(score) - min(score)) / 50 AS w FROM txn),
        counts AS (SELECT CAST(least(floor((score - lo) / w), 49) AS INT) AS bin, count(*) AS n
          FROM txn, ends GROUP BY 1)
        SELECT CAST(g.bin AS INT) AS bin, round(lo + g.bin * w, 6) AS lower,
          round(lo + (g.bin + 1) * w, 6) AS upper, coalesce(n, 0) AS n
        FROM range(50) AS g(bin) CROSS JOIN ends LEFT JOIN counts ON counts.bin = g.bin""",
    "score_quartiles": _T + """SELECT is_fraud, round(min(score), 6) AS minimum,
        round(quantile_cont(score, 0.25), 6) AS q1, round(quantile_cont(score, 0.5), 6) AS median,
        round(quantile_cont(score, 0.75), 6) AS q3, round(max(score), 6) AS maximum
        FROM txn GROUP BY is_fraud""",
    "score_percentiles": _T + " UNION ALL ".join(
        f"SELECT CAST({p} AS DOUBLE) AS probability, round(quantile_cont(score, {p}), 6) AS value FROM txn"
        for p in (0.02, 0.05, 0.5, 0.95, 0.99)),
    "percentile_cut": _T + """SELECT trans_num,
        CASE WHEN amt > (SELECT quantile_cont(amt, 0.99) FROM txn) THEN 1 ELSE 0 END AS is_anomaly FROM txn""",
    "contamination_cut": _T + """, cut AS (SELECT quantile_cont(-amt, 0.02) AS c FROM txn)
        SELECT trans_num, round(-amt - c, 6) AS decision, CASE WHEN -amt < c THEN 1 ELSE 0 END AS is_anomaly
        FROM txn, cut""",
    "model_comparison": _with(_TXN, _COMPARED) + "SELECT * FROM compared",
    "best_models": _with(_TXN, _COMPARED) + " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{m}' AS metric, model, {m} AS value FROM compared "
        f"ORDER BY {m} DESC, model DESC LIMIT 1)" for m in ("precision", "recall", "f1")),
    "table_shape": _T + "SELECT count(*) AS n_rows, 14 AS n_columns FROM txn",
    "label_rate": _T + "SELECT count(*) AS n, round(avg(is_fraud), 6) AS fraud_rate FROM txn",
    "class_ratio": _T + """SELECT CAST(count_if(is_fraud = 0) AS BIGINT) AS negatives,
        CAST(count_if(is_fraud = 1) AS BIGINT) AS positives,
        round(count_if(is_fraud = 0) / count_if(is_fraud = 1), 6) AS ratio FROM txn""",
    "top_job_categories": _F + f"SELECT * FROM ({_JOB_COUNTS}) ORDER BY n DESC, category LIMIT 5",
    "top_txn_categories": _F + f"SELECT * FROM ({_CATEGORY_COUNTS}) ORDER BY n DESC, category LIMIT 5",
    "age_groups": _F + f"SELECT * FROM ({_AGE_COUNTS}) ORDER BY n DESC, category",
    "category_counts": _R + """SELECT category, count(*) AS n FROM rows_ WHERE is_fraud = 1
        GROUP BY category ORDER BY n DESC, category""",
    "amount_analysis": _T + """, m AS (SELECT avg(amt) FILTER (is_fraud = 1) AS f,
        avg(amt) FILTER (is_fraud = 0) AS n FROM txn)
        SELECT round(f, 6) AS fraud_avg, round(n, 6) AS normal_avg, round((f - n) / n * 100, 6) AS increase_pct
        FROM m""",
    "time_analysis": _R + """SELECT round(avg(txn_time) FILTER (is_fraud = 1), 6) AS fraud_avg_hour,
        round(avg(txn_time) FILTER (is_fraud = 0), 6) AS normal_avg_hour FROM rows_""",
    "category_share": _F + f"""SELECT category, n, round(n / sum(n) OVER () * 100, 6) AS share_pct,
        upper(replace(category, 'dob_', '')) AS label FROM ({_AGE_COUNTS})""",
    "category_vs_max": _F + f""", top AS (SELECT * FROM ({_CATEGORY_COUNTS}) ORDER BY n DESC, category LIMIT 5)
        SELECT category, n, round(n / max(n) OVER (), 6) AS vs_max,
        replace(replace(category, 'TXNctg_', ''), '_', ' ') AS label FROM top""",
    "pattern_report": _with(_TXN, _ROWS, _JOBS, _FLAGS, _REPORT_DOCUMENT)
        + "SELECT section, name, round(value, 6) AS value FROM document",
    "score_summary": _T + """SELECT round(min(score), 6) AS min_score, round(max(score), 6) AS max_score,
        CAST(count_if(score > 0.5e0) AS BIGINT) AS flagged, count(*) AS total,
        round(count_if(score > 0.5e0) / count(*) * 100, 6) AS flagged_pct FROM txn""",
    "flagged": _F + f"""SELECT trans_num, txn_time, amt, round(score, 6) AS fraud_probability, {_FLAGGED_COLUMNS},
        1 AS is_fraud_predicted, is_fraud AS is_fraud_actual, amt AS transaction_amount,
        txn_time AS transaction_hour
        FROM flags WHERE score > 0.5e0 ORDER BY score DESC, trans_num""",
    "flagged_top10": _R + """SELECT trans_num, round(score, 6) AS fraud_probability, amt AS transaction_amount,
        txn_time AS transaction_hour FROM rows_ WHERE score > 0.5e0 ORDER BY score DESC, trans_num LIMIT 10""",
    "report_page": _T + """SELECT trans_num, round(score, 6) AS fraud_probability, amt AS transaction_amount
        FROM txn WHERE score > 0.5e0 ORDER BY score DESC, trans_num LIMIT 6 OFFSET 12""",
    "page_count": _T + """SELECT count(*) AS n, CAST(ceil(count(*) / 6) AS BIGINT) AS pages
        FROM txn WHERE score > 0.5e0""",
    "split_hash_counts": _T + f"""SELECT CASE WHEN {_h('33333333')} THEN 'test'
          WHEN {_h('66666666')} THEN 'validation' ELSE 'train' END AS split,
        count(*) AS n, round(avg(is_fraud), 6) AS fraud_rate FROM txn GROUP BY 1""",
    "split_two_way": _T + f"""SELECT trans_num,
        CASE WHEN {_h('4ccccccc')} THEN 'test' ELSE 'train' END AS split FROM txn""",
    "split_exact_counts": _with(_TXN, _EXACT)
        + "SELECT split, is_fraud, count(*) AS n FROM exact GROUP BY split, is_fraud",
    "split_exact_two_way": _with(_TXN, """ranked AS (
        SELECT is_fraud, count(*) OVER (PARTITION BY is_fraud) AS size, row_number() OVER (
          PARTITION BY is_fraud ORDER BY md5(concat('42', CAST(trans_num AS VARCHAR)))) AS place FROM txn)""") + """
        SELECT CASE WHEN place <= floor(size * 0.3e0 + 0.5e0) THEN 'test' ELSE 'train' END AS split,
        count(*) AS n, round(avg(is_fraud), 6) AS fraud_rate FROM ranked GROUP BY 1""",
    "split_exact_rows": _with(_TXN, _EXACT) + "SELECT trans_num, split FROM exact",
    "scaled_features": _R + f""", fit AS (
        SELECT avg(txn_time) AS tm, stddev_samp(txn_time) AS ts, avg(amt) AS am, stddev_samp(amt) AS asd
        FROM rows_ WHERE NOT {_h('66666666')})
        SELECT trans_num, round((txn_time - tm) / ts, 6) AS txn_time_scaled,
        round((amt - am) / asd, 6) AS amt_scaled FROM rows_, fit""",
    "explanation_context": _with(_TXN, _ROWS, _METRICS, _CONTEXT) + """
        SELECT trans_num, amount, time, category, job, age_group, user_avg_amount, user_avg_time,
        user_avg_distance, round(fraud_probability, 6) AS fraud_probability,
        round(amount_ratio, 6) AS amount_ratio, time_anomaly, time_text, usual_time_text FROM context""",
    "explanation_texts": _with(_TXN, _ROWS, _METRICS, _CONTEXT) + f"""
        SELECT trans_num, amount_anomaly, {_PROMPT} AS prompt, {_FALLBACK} AS fallback, {_SUMMARY} AS summary
        FROM context""",
    "explanation_sample": _with(_TXN, _ROWS, _METRICS, _CONTEXT) + f"""
        SELECT CAST(row_number() OVER (ORDER BY fraud_probability DESC, trans_num) - 1 AS INT) AS transaction_id,
        {_SUMMARY} AS summary FROM context ORDER BY fraud_probability DESC, trans_num LIMIT 3""",
    "explanations": _with(_TXN, _ROWS, _METRICS, _CONTEXT) + f"""
        SELECT CAST(row_number() OVER (ORDER BY fraud_probability DESC, trans_num) - 1 AS INT) AS transaction_id,
        amount, time, category, round(fraud_probability, 6) AS fraud_probability, {_FALLBACK} AS explanation
        FROM context ORDER BY fraud_probability DESC, trans_num LIMIT 50""",
}
ORACLE["txn_with_metrics_sliced"] = ORACLE["txn_with_metrics"]

# All published categories and states, written out once more so that a wrong entry shows.
_LOG = """log_ AS (SELECT * REPLACE (
    list_extract(['entertainment', 'food_dining', 'gas_transport', 'grocery_net', 'grocery_pos',
      'health_fitness', 'home', 'kids_pets', 'misc_net', 'misc_pos', 'personal_care', 'shopping_net',
      'shopping_pos', 'travel'], CAST(trans_num % 14 AS INT) + 1) AS category,
    list_extract(['AK', 'AL', 'AR', 'AZ', 'CA', 'CO', 'CT', 'DC', 'DE', 'FL', 'GA', 'HI', 'IA', 'ID', 'IL',
      'IN', 'KS', 'KY', 'LA', 'MA', 'MD', 'ME', 'MI', 'MN', 'MO', 'MS', 'MT', 'NC', 'ND', 'NE',
      'NH', 'NJ', 'NM', 'NV', 'NY', 'OH', 'OK', 'OR', 'PA', 'RI', 'SC', 'SD', 'TN', 'TX', 'UT',
      'VA', 'VT', 'WA', 'WI', 'WV', 'WY'], CAST(cc_num % 51 AS INT) + 1) AS state) FROM txn)"""
_PUBLISHED = [_flag(f"category = '{c}'", f"TXNctg_{c}") for c in S.CATEGORIES] + [
    _flag(f"state = '{s}'", f"state_{s}") for s in S.STATES]
_SPLIT = f"""CASE WHEN {_h('33333333')} THEN 'test' WHEN {_h('66666666')} THEN 'validation' ELSE 'train' END"""

ORACLE |= {
    "csv_features": _with(_TXN, _LOG, _ROWS.replace("FROM txn", "FROM log_"), _METRICS, _JOBS)
        + f"""SELECT trans_num, is_fraud, txn_time, amt, {', '.join(_PUBLISHED + _JOB_FLAGS + _DECADE_FLAGS)},
        avg_txn_amt, stddev_txn_amt, avg_txn_time, avg_merchant_distance
        FROM rows_ LEFT JOIN jobs USING (job) LEFT JOIN metrics USING (cc_num)""",
    "dataset_read": _T + "SELECT trans_num, amt, CAST(count(*) OVER () AS INT) AS cached_rows FROM txn",
    "matrix_csv": _with(_PAIRS) + "SELECT job_category, job FROM pairs",
    "flagged_stored": ORACLE["flagged"],
    "report_stored": ORACLE["pattern_report"],
    "explanations_stored": _with(_TXN, _ROWS, _METRICS, _CONTEXT) + f"""
        SELECT CAST(row_number() OVER (ORDER BY fraud_probability DESC, trans_num) - 1 AS INT) AS transaction_id,
        amount, time, category, round(fraud_probability, 6) AS fraud_probability,
        CASE WHEN category = 'Travel' THEN {_FALLBACK} ELSE concat('- Amount: $', printf('%.2f', amount),
          ' (user''s average: $', printf('%.2f', user_avg_amount), ')') END AS explanation
        FROM context ORDER BY fraud_probability DESC, trans_num LIMIT 50""",
    "explanation_head": _T + """SELECT least(50, count(*)) AS total_transactions, least(50, count(*)) AS n_rows
        FROM txn WHERE score > 0.5e0""",
    "score_quantiles_merged": _R + """, ranked AS (
          SELECT is_fraud, txn_time, score, row_number() OVER (PARTITION BY is_fraud, txn_time ORDER BY score) AS place,
            count(*) OVER (PARTITION BY is_fraud, txn_time) AS n FROM rows_ WHERE score IS NOT NULL)
        SELECT is_fraud, txn_time, n, p AS probability, round(score, 6) AS value
        FROM ranked, (VALUES (0e0), (0.25e0), (0.5e0), (0.75e0), (1e0)) AS t(p) WHERE place = greatest(ceil(p * n), 1)""",
    "raw_types": _T + """SELECT "column", n, CASE WHEN kind = 'int' THEN n ELSE 0 END AS n_bigint,
        CASE WHEN kind IN ('int', 'double') THEN n ELSE 0 END AS n_double, CASE WHEN kind = 'timestamp' THEN n ELSE 0 END AS n_timestamp, kind AS type
        FROM (SELECT unnest(['trans_num', 'cc_num', 'category', 'amt', 'job', 'is_fraud', 'trans_date_trans_time', 'city_pop']) AS "column",
          unnest([count(trans_num), count(cc_num), count(category), count(amt), count(job), count(is_fraud), count(trans_date_trans_time), count(*)]) AS n,
          unnest(['int', 'int', 'string', 'double', 'string', 'int', 'timestamp', 'int']) AS kind FROM txn)""",
    "raw_rescued": _T + """SELECT trans_num, trans_num % 7 = 0 OR amt IS NULL AS amt_is_null,
        CASE WHEN trans_num % 7 = 0 THEN 'EUR ' || cc_num END AS rescued_amt, CASE WHEN trans_num % 7 = 0 THEN 'soon' END AS rescued_time,
        CASE WHEN trans_num % 7 = 0 THEN 2 ELSE 0 END AS n_rescued FROM txn""",
    "full_run": _T + """SELECT trans_num, is_fraud, TRUE AS flagged_agrees, TRUE AS explained_agrees,
        count(*) OVER () AS reported_rows FROM txn""",
}
ORACLE["report_page_seek"], ORACLE["card_metrics_folded"] = ORACLE["report_page"], ORACLE["card_metrics"]
