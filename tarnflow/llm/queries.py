"""Queries p2, p5, p6, p7 and p8 over the shared tables, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.functions.runtime import table
from tarnflow.llm.components import decided_links, link_groups
from tarnflow.llm.garble import find_garbled, restore_texts
from tarnflow.llm.leakage import find_leaks
from tarnflow.llm.mixing import plan_mix
from tarnflow.llm.splitting import cut_kinds, range_items, split_ranges, split_texts


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_ranges(range_items(table(spark, d, "subdomain")), table(spark, d, "split_line"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return cut_kinds(p2_pieces(spark, d))


def p2_text_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_texts(table(spark, d, "documents"), "doc_id", "text", limit=2000, overlap=200)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    links = decided_links(table(spark, d, "region_pair"), "region_a", "region_b", "is_same", "match_id")
    return link_groups(links).select(F.col("member").alias("region"), "group_id")


def p5_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return p5_found(spark, d).groupBy("group_id").agg(F.count("*").alias("n_regions"))


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_leaks(spark, d).filter("exact").select("doc_id", "item_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    _, report = plan_mix(table(spark, d, "documents"), table(spark, d, "mix_target"))
    return report.filter("short").select("source")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return plan_mix(table(spark, d, "documents"), table(spark, d, "mix_target"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return plan_mix(table(spark, d, "documents"), table(spark, d, "mix_target"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return find_garbled(table(spark, d, "documents"))


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return restore_texts(table(spark, d, "documents")).withColumn("swaps", F.array_join("swaps", "; "))


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_pieces, p2_text_pieces, p5_found, p5_group_sizes, p6_found, p6_leaks,
        p7_found, p7_mix, p7_shares, p8_found, p8_restored,
    )
}

_RANGES = """
WITH RECURSIVE one AS (
  SELECT domain_id, max(grid_id) AS grid_id, max(max_len) AS max_len, max(coalesce(overlap_len, 0)) AS ov,
    max(coalesce(i_lo, CAST(regexp_extract_all(xrange, '-?\\d+')[1] AS BIGINT))) AS xa, max(coalesce(i_hi, CAST(regexp_extract_all(xrange, '-?\\d+')[-1] AS BIGINT))) AS xb,
    max(coalesce(j_lo, CAST(regexp_extract_all(yrange, '-?\\d+')[1] AS BIGINT))) AS ya, max(coalesce(j_hi, CAST(regexp_extract_all(yrange, '-?\\d+')[-1] AS BIGINT))) AS yb
  FROM subdomain GROUP BY domain_id),
rng AS (
  SELECT domain_id, grid_id, 'x' AS axis, xa AS lo, xb AS hi, max_len, ov FROM one
  UNION ALL SELECT domain_id, grid_id, 'y', ya, yb, max_len, ov FROM one),
big AS (
  SELECT r.*, (SELECT list_sort(list(DISTINCT pos)) FROM split_line s WHERE s.grid_id = r.grid_id AND s.axis = r.axis) AS cuts
  FROM rng r WHERE hi - lo + 1 > max_len),
run(domain_id, axis, s, hi, max_len, ov, cuts, piece, cut, kind) AS (
  SELECT domain_id, axis, lo, hi, max_len, ov, cuts, 1, coalesce(list_last(list_filter(cuts, lambda c: c > lo + ov AND c <= lo + max_len)), lo + max_len),
    CASE WHEN list_last(list_filter(cuts, lambda c: c > lo + ov AND c <= lo + max_len)) IS NULL THEN 'forced' ELSE 'line' END FROM big
  UNION ALL
  SELECT domain_id, axis, cut - ov, hi, max_len, ov, cuts, piece + 1,
    CASE WHEN hi - (cut - ov) + 1 > max_len THEN coalesce(list_last(list_filter(cuts, lambda c: c > cut - ov + ov AND c <= cut - ov + max_len)), cut - ov + max_len) END,
    CASE WHEN hi - (cut - ov) + 1 > max_len THEN CASE WHEN list_last(list_filter(cuts, lambda c: c > cut AND c <= cut - ov + max_len)) IS NULL THEN 'forced' ELSE 'line' END ELSE 'last' END
  FROM run WHERE kind <> 'last')
"""

_LINKS = """
WITH RECURSIVE p AS (
  SELECT least(region_a, region_b) AS a, greatest(region_a, region_b) AS b, is_same, match_id FROM region_pair
  WHERE region_a IS NOT NULL AND region_b IS NOT NULL AND region_a <> region_b),
w AS (SELECT a, b, coalesce(is_same, false) AS s, row_number() OVER (PARTITION BY a, b ORDER BY match_id DESC NULLS LAST, coalesce(is_same, false)) AS rn FROM p),
e AS (SELECT a AS u, b AS v FROM w WHERE rn = 1 AND s UNION SELECT b, a FROM w WHERE rn = 1 AND s),
reach(u, v) AS (SELECT u, u FROM e UNION SELECT r.u, e.v FROM reach r JOIN e ON e.u = r.v),
res AS (SELECT u AS region, min(v) AS group_id FROM reach GROUP BY u)
"""

# any tokenizer gives the same list, so bytes stand for tokens
_SHORT = """
WITH s AS (SELECT lower(regexp_replace(source, '^[\\s\u00a0]+|[\\s\u00a0]+$', '', 'g')) AS k, CAST(strlen(text) AS DOUBLE) AS n FROM documents)
SELECT m.source FROM mix_target m WHERE m.max_repeats * coalesce((SELECT sum(n) FROM s WHERE s.k = lower(trim(m.source))), 0) < m.target_share * (SELECT sum(n) FROM s)"""

# the markup that the documents have, and every window of twelve words
_LEAKS = r"""
WITH src AS (SELECT 'd' AS side, doc_id AS id, text AS t FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'i', item_id, text FROM eval_item WHERE text IS NOT NULL),
a AS (SELECT side, id, strip_accents(translate(replace(replace(replace(replace(replace(t, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), chr(173) || chr(8203) || chr(8204) || chr(8205) || chr(8288) || chr(65279), '')) AS t FROM src),
b AS (SELECT side, id, regexp_replace(regexp_replace(t, '([A-Za-z0-9])%\n[ \t]*', '\1', 'g'), '(?m)^[ \t]*%+', ' ', 'g') AS t FROM a),
c AS (SELECT side, id, regexp_replace(regexp_replace(t, '\\[-/]', '', 'g'), '\\(begin|end|cite[a-z]*|eqref|ref|pageref|autoref|label|index|vspace|hspace|includegraphics|input|include|textcolor|color|fontsize|href|url|footnotemark)\*?(\[[^\]\n]*\])*\{[^{}\n]*\}', ' ', 'g') AS t FROM b),
d AS (SELECT side, id, regexp_replace(regexp_replace(t, '\\[''"`^~=.]\s*\{?\\?([A-Za-z])\}?', '\1', 'g'), '\\[uvHcdbkrt](?:\s+|\{)\\?([A-Za-z])\}', '\1', 'g') AS t FROM c),
e AS (SELECT side, id, regexp_replace(regexp_replace(t, '\\(ss|ae|AE|oe|OE|o|O|l|L|i|j)(\{\}| |\b)', '\1', 'g'), '\\[,;:!> \n\\]|~', ' ', 'g') AS t FROM d),
f AS (SELECT side, id, regexp_extract_all(lower(replace(replace(regexp_replace(t, '\\[A-Za-z@]+\*?', '', 'g'), '{', ''), '}', '')), '[\pL\pN]+') AS w FROM e),
g AS (SELECT DISTINCT side, id, array_to_string(w[k:k + 11], ' ') AS run FROM f, unnest(range(1, len(w) - 10)) AS u(k))
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM g d JOIN g i USING (run) WHERE d.side = 'd' AND i.side = 'i'"""

ORACLES = {
    "p6_found": _LEAKS,
    "p7_found": _SHORT,
    "p2_found": _RANGES + "SELECT domain_id, axis, CASE WHEN bool_or(kind = 'forced') THEN 'forced' ELSE 'clean' END AS cut_kind FROM run GROUP BY 1, 2",
    "p2_pieces": _RANGES + "SELECT domain_id, axis, CAST(piece AS BIGINT) AS piece, s AS lo, CASE WHEN kind = 'last' THEN hi ELSE cut - 1 END AS hi, kind AS cut_kind FROM run",
    "p5_found": _LINKS + "SELECT region, group_id FROM res",
    "p5_group_sizes": _LINKS + "SELECT group_id, count(*) AS n_regions FROM res GROUP BY 1",
}
