"""SQL twins of the queries that DuckDB can express."""

_OP10 = """
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, grams.n, i, item_id FROM grams JOIN win ON grams.n = win.n AND grams.g = win.g),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS s
  FROM hits GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(s, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP9 = """
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS p, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT doc_id, p, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
bad AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT keyed.*, bad.k IS NOT NULL AND doc_id <> last AS gone FROM keyed LEFT JOIN bad ON keyed.k = bad.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_OP6 = """
WITH RECURSIVE dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM dw WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_of AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM both_of JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(a, b) AS (SELECT x, y FROM edges UNION SELECT a, y FROM reach JOIN edges ON b = x),
least_of AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT dw.doc_id, coalesce(n, 0) AS n_shingles, least(dw.doc_id, coalesce(m, dw.doc_id)) AS component_id
FROM dw LEFT JOIN sizes ON sizes.doc_id = dw.doc_id LEFT JOIN least_of ON a = dw.doc_id
"""

ORACLE = {"op6_jaccard": _OP6, "op9_line_dedup": _OP9, "op10_decontaminate": _OP10}

ORACLE["op13_pareto_mix"] = r"""
WITH sized AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
        CAST(('0x' || substr(md5(concat_ws(':', 'mix', CAST(doc_id AS VARCHAR))), 1, 13)) AS BIGINT) AS draw
    FROM documents),
sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized GROUP BY source),
weighed AS (SELECT *, CAST([3, 1, 2][(place - 1) % 3 + 1] AS DOUBLE) AS w FROM sources),
leveled AS (
    SELECT *, 2 * source_size / w AS fill,
        (1.5e0 * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER earlier, 0))
            / (sum(w) OVER () - coalesce(sum(w) OVER earlier, 0)) AS level
    FROM weighed
    WINDOW earlier AS (ORDER BY 2 * source_size / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
common AS (SELECT arg_min(level, (fill, place)) AS c FROM leveled WHERE fill > level),
targets AS (
    SELECT source, source_size, CASE WHEN fill > c THEN w * c ELSE 2e0 * source_size END AS target FROM leveled, common),
chances AS (
    SELECT s.*, source_size, target, coalesce(floor(target / source_size), 0) AS whole,
        coalesce(target / source_size - floor(target / source_size), 0) AS p, (draw + 0.5e0) / 4503599627370496e0 AS u
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
ranked AS (
    SELECT *, target - whole * source_size AS need,
        CASE WHEN p > 0 THEN floor(u * (1 - p) / (p * (1 - u) + u * (1 - p)) * 4503599627370496e0) END AS key FROM chances),
placed AS (
    SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, draw, doc_id ROWS UNBOUNDED PRECEDING) AS upto
    FROM ranked)
SELECT doc_id, size, source_size, target,
    CAST((whole + CASE WHEN p > 0 AND 2 * upto - size < 2 * need THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM placed
"""

_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
ORACLE["op12_mask_search"] = f"""
WITH words AS (SELECT doc_id, {_TERMS} AS w FROM documents),
total AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM words WHERE len(w) > 0),
asked AS (SELECT item_id, term, CAST(count(*) AS BIGINT) AS repeats FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
held AS (
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n, term, CAST(count(*) AS BIGINT) AS tf
    FROM (SELECT doc_id, w, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
    FROM held, total GROUP BY term, n_docs),
gains AS (
    SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))) AS gain
    FROM held JOIN weights USING (term), total),
scores AS (SELECT item_id, doc_id, CAST(sum(repeats * gain) AS BIGINT) AS score FROM asked JOIN gains USING (term) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10
"""
