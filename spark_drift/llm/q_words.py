"""Queries on the words of whole texts: license scans, spelling variants, filter interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spark_drift.llm import filter_audit, licenses, spelling
from spark_drift.llm.registry import query, table

AUDIT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, (length(words) < 100)::INT AS a, (100 * length(list_distinct(words)) < 80 * length(words))::INT AS b,
        (100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(text))::INT AS c,
        regexp_matches(text, '[#$%&*|]')::INT AS d, coalesce(first < w.doc_id, false)::INT AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
      FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
t AS (SELECT part, {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS f, a + b + c + d + e AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
      FROM m GROUP BY ALL),
x(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT p.l || q.l || r.l || s.l || u.l AS filter_order FROM x p, x q, x r, x s, x u
      WHERE length(list_distinct([p.l, q.l, r.l, s.l, u.l])) = 5),
long AS (SELECT part, l, fails, n, good, toxic, f, CASE l WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END AS bad FROM t, x),
masks AS (SELECT part, f, fails, any_value(n) AS n, any_value(good) AS good, any_value(toxic) AS toxic, coalesce(string_agg(l, '' ORDER BY l) FILTER (bad = 1), '') AS failed
          FROM long GROUP BY part, f, fails),
hit AS (SELECT part, filter_order, failed, n, good, toxic,
          CASE WHEN failed = '' THEN NULL ELSE list_min([strpos(filter_order, z) FOR z IN string_split(failed, '')]) END AS gone FROM masks, o),
rows AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, sum(n) FILTER (gone IS NULL OR gone > step) AS kept, sum(n) FILTER (gone = step) AS removed,
          sum(n) FILTER (gone < step AND strpos(failed, substr(filter_order, step, 1)) > 0) AS redundant, sum(n) FILTER (failed = substr(filter_order, step, 1)) AS unique_fails,
          sum(good) FILTER (gone = step) AS good_lost, sum(toxic) FILTER (gone = step) AS toxic_lost
        FROM hit, (SELECT unnest([1, 2, 3, 4, 5]) AS step) GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::BIGINT AS shapley FROM rows
"""


@query("op13_filter_audit", AUDIT_SQL)
def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = filter_audit.text_masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return filter_audit.interactions(masks)


# crc32 byte by byte over the distinct (document, run); near words by equal deletions at equal places
SPELLING_SQL = r"""
WITH RECURSIVE t8(i, k, c) AS (SELECT i::BIGINT, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM t8 WHERE k < 8),
tab AS (SELECT i, c FROM t8 WHERE k = 8),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
d AS MATERIALIZED (SELECT id, run, hex(encode(id || ':' || run)) AS x, count(*) AS n FROM r GROUP BY ALL),
h(id, run, n, x, i, c) AS (SELECT id, run, n, x, 0, 4294967295::BIGINT FROM d
  UNION ALL SELECT id, run, n, x, h.i + 1, xor(h.c >> 8, tab.c) FROM h JOIN tab ON tab.i = xor(h.c & 255, ('0x' || substr(x, 2 * h.i + 1, 2))::BIGINT) WHERE 2 * h.i < length(x)),
s AS (SELECT run, n, xor(c, 4294967295::BIGINT) AS h FROM h WHERE 2 * i = length(x)),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM s)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
g AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, b.word AS other, b.n AS m FROM g a JOIN g b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM g JOIN w ON g.rest = w.word UNION SELECT w.word, g.word, g.n FROM g JOIN w ON g.rest = w.word),
b AS (SELECT word, count(*) AS n_near, max(m) AS top FROM p GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * w.n THEN (SELECT min(other) FROM p WHERE p.word = w.word AND p.m = top) END AS form,
  CASE WHEN top >= 10 * w.n THEN top END AS form_n FROM w LEFT JOIN b ON b.word = w.word),
z(word, root) AS (SELECT word, form FROM f WHERE form IS NOT NULL UNION SELECT z.word, f.form FROM z JOIN f ON f.word = z.root WHERE f.form IS NOT NULL),
e AS (SELECT z.word, z.root FROM z JOIN f ON f.word = z.root WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(e.root, f.word) AS root, f.n, f.n_near, f.form_n FROM f LEFT JOIN e ON e.word = f.word
"""


@query("op12_spelling_variants", SPELLING_SQL)
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.runs(table(spark, sf_dir, "documents"))
    words = found.select(spelling.misspelt(F.col("key"), F.col("run")).alias("word"))
    return spelling.variants(spelling.vocabulary(words))


def _license_sql() -> str:
    """Every block of every text against every template, without an order or a filter."""
    tests = "\n  UNION ALL ".join(
        f"SELECT {i}, '{t['label']}', {t['reach']}, {t['need']}, {t['tokens']!r}::VARCHAR[]" for i, t in enumerate(licenses.template_table(licenses.TEMPLATES)))
    return r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
u AS (SELECT id, w, unnest(range(0, length(w))) AS i FROM d WHERE list_contains(w, 'license')),
p AS (SELECT id, i, CASE WHEN w[i + 1] = 'mit' AND w[i + 2] = 'license' THEN 'mit' WHEN w[i + 1] = 'apache' AND w[i + 2] = 'license' THEN 'apache'
  WHEN w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license' THEN 'gpl' END AS label FROM u),
b AS (SELECT id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_distinct(list(label)) AS labels FROM p WHERE label IS NOT NULL GROUP BY id),
t(k, label, reach, need, tokens) AS (""" + tests + r"""),
c AS (SELECT id, reach, w[s * reach + 1:(s + 2) * reach] AS held FROM (SELECT id, w, reach, unnest(range(0, (length(w) + reach - 1) // reach)) AS s FROM d, (SELECT DISTINCT reach FROM t))),
f AS (SELECT id, label, length(list_intersect(tokens, held)) AS shared, length(tokens) AS size, need FROM c JOIN t USING (reach)),
h AS (SELECT id, list(DISTINCT label) AS found, max(shared / size) AS best FROM f WHERE shared >= need GROUP BY id)
SELECT doc_id, length(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
  array_to_string(list_sort(coalesce(labels, [])), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), coalesce(found, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
FROM d LEFT JOIN b USING (id) LEFT JOIN h USING (id)
"""


@query("op11_license_scan", _license_sql())
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))
