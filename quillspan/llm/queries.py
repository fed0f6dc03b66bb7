"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.common import cut, table
from quillspan.llm import cutting, mixture, overlap, packing, repetition, splits
from quillspan.llm.tokens import token_counts


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.related(table(spark, sf_dir, "plan_sets"), table(spark, sf_dir, "plan_pages"))


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = splits.grouped(table(spark, sf_dir, "plan_sets"), table(spark, sf_dir, "plan_pages"))
    shares = [(r.split_name, r.share) for r in table(spark, sf_dir, "split_shares").collect()]  # one row per split
    return splits.split(cut(rows), shares)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutting.axis_fits(table(spark, sf_dir, "tiled_sheets"))


def p2_axis_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutting.axis_pieces(table(spark, sf_dir, "tiled_sheets"))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutting.sheet_pieces(table(spark, sf_dir, "tiled_sheets"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_pairs(spark, sf_dir).select("file_a", "file_b")


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.file_pairs(table(spark, sf_dir, "source_files"), table(spark, sf_dir, "plan_sets"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.report(table(spark, sf_dir, "source_files"), table(spark, sf_dir, "plan_sets"))


def _packs(spark: SparkSession, sf_dir: str) -> list[tuple[str, int, int]]:
    return [(r.pack_name, r.capacity_tokens, r.separator_tokens) for r in table(spark, sf_dir, "pack_sizes").collect()]  # one row per pack


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(token_counts(table(spark, sf_dir, "documents"), {"doc_id": "bigint"}))


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_sizes(spark, sf_dir), _packs(spark, sf_dir))[0]


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_report(_sizes(spark, sf_dir), _packs(spark, sf_dir))


def _targets(spark: SparkSession, sf_dir: str) -> list[tuple[str, float, int]]:
    rows = table(spark, sf_dir, "mix_targets").select(mixture.canonical(F.col("source")).alias("source"), "target_share", "max_repeats")
    return [(r.source, r.target_share, r.max_repeats) for r in rows.collect()]  # one row per source


def _sourced(spark: SparkSession, sf_dir: str, targets: list[tuple[str, float, int]]) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", mixture.canonical(F.col("source")).alias("source"), "text")
    docs = docs.where(F.col("source").isin(*[s for s, _, _ in targets]))
    return cut(token_counts(docs, {"doc_id": "bigint", "source": "string"}))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = _targets(spark, sf_dir)
    return mixture.mixture(_sourced(spark, sf_dir, targets), targets)


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = _targets(spark, sf_dir)
    return mixture.shares(mixture.mixture(_sourced(spark, sf_dir, targets), targets), targets)


def p6_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each pack has a place for: all of them."""
    return packing.pack(_sizes(spark, sf_dir), _packs(spark, sf_dir))[0].groupBy("pack_name", "doc_id").agg(F.lit(1).alias("one")).groupBy("pack_name").agg(F.count("*").alias("n_documents"))


def p6_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and documents that break a rule of packing: none."""
    sizes, packs = _sizes(spark, sf_dir), _packs(spark, sf_dir)
    return packing.violations(packing.pack(sizes, packs)[0], sizes, packs)


def p7_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources and documents that break a rule of the mixture: none."""
    targets = _targets(spark, sf_dir)
    sizes = _sourced(spark, sf_dir, targets)
    return mixture.violations(mixture.mixture(sizes, targets), sizes, targets)


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repetition.repetition(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", *[F.round(c, 9).alias(c) for c in ("share_1", "share_3", "share_6")])


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetitive(table(spark, sf_dir, "documents"))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(table(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_splits": p1_splits,
    "p2_found": p2_found,
    "p2_axis_pieces": p2_axis_pieces,
    "p2_pieces": p2_pieces,
    "p3_found": p3_found,
    "p3_pairs": p3_pairs,
    "p3_report": p3_report,
    "p6_pack": p6_pack,
    "p6_report": p6_report,
    "p6_documents": p6_documents,
    "p6_violations": p6_violations,
    "p7_mixture": p7_mixture,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p7_violations": p7_violations,
    "p8_scores": p8_scores,
    "p8_shares": p8_shares,
}

_P3 = r"""
    WITH f AS (
      SELECT DISTINCT file_id, ref_id, filename, sha256,
        CASE WHEN s IN ('train', 'training', 'trn') THEN 'train' WHEN s IN ('val', 'valid', 'validation', 'dev', 'test', 'testing', 'tst') THEN 'eval' END AS side
      FROM (SELECT *, regexp_replace(lower(split_name), '[\s_\-]+', '', 'g') AS s FROM source_files)),
    hashes AS (SELECT file_id, side, regexp_extract(lower(sha256), '([0-9a-f]{64})\s*$', 1) AS k FROM f WHERE side IS NOT NULL),
    urls AS (
      SELECT DISTINCT file_id, side, regexp_replace(lower(regexp_extract(url, '(?i)^[a-z]+://([^/:?#]*)', 1)), '^www\.', '') || ' ' ||
        regexp_replace(url_decode(regexp_extract(url, '(?i)^[a-z]+://[^/?#]*([^?#]*)', 1)), '/+$', '') || ' ' || regexp_extract(url, '[?&]id=([^&#]*)', 1) AS k
      FROM f JOIN plan_sets USING (ref_id) WHERE url IS NOT NULL AND side IS NOT NULL),
    stems AS (
      SELECT file_id, side, regexp_extract(n, '\.([a-z0-9]{1,5})$', 1) AS ext,
        regexp_replace(regexp_replace(regexp_replace(n, '\.[a-z0-9]{1,5}$', ''), '^copy[\s_\-]+of[\s_\-]+', ''), '([\s_\-]*\(\d+\)|[\s_\-]+copy|_\d+_)+$', '') AS stem
      FROM (SELECT *, lower(url_decode(filename)) AS n FROM f WHERE side IS NOT NULL)),
    coded AS (SELECT *, regexp_extract(stem, '(?:^|[^a-z0-9])([a-z][\s_.\-–]*\d{4}[\s_.\-–]*\d{2})(?:[^0-9]|$)', 1) AS raw FROM stems),
    names AS (
      SELECT file_id, side, regexp_replace(raw, '[^a-z0-9]', '', 'g') || '|' || ext || '|' || array_to_string(list_transform(regexp_extract_all(rest, '\d+'), lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') AS block,
             regexp_replace(rest, '[^\p{L}]', '', 'g') AS body
      FROM (SELECT *, replace(stem, raw, ' ') AS rest FROM coded WHERE raw <> '')),
    each AS (
      SELECT a.file_id AS t, b.file_id AS e, 'hash' AS facet FROM hashes a JOIN hashes b USING (k) WHERE a.side = 'train' AND b.side = 'eval' AND k <> '' AND NOT regexp_full_match(k, '0+')
        AND k <> 'e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855'
      UNION SELECT a.file_id, b.file_id, 'url' FROM urls a JOIN urls b USING (k) WHERE a.side = 'train' AND b.side = 'eval'
      UNION SELECT a.file_id, b.file_id, 'name' FROM names a JOIN names b USING (block)
        WHERE a.side = 'train' AND b.side = 'eval' AND damerau_levenshtein(a.body, b.body) <= 1),
    pairs AS (SELECT t, e, bool_or(facet = 'hash') AS by_hash, bool_or(facet = 'url') AS by_url, bool_or(facet = 'name') AS by_name FROM each GROUP BY t, e)
"""

_P1 = r"""
        WITH RECURSIVE named AS (
          SELECT DISTINCT ref_id, node FROM (
            SELECT ref_id, 's:' || s AS node FROM (SELECT ref_id, regexp_replace(lower(source), '[\s_\-]+', '', 'g') AS s FROM plan_sets)
              WHERE regexp_matches(s, '[a-z0-9]') AND s NOT IN ('unknown', 'n/a', 'na', 'none', 'null', 'notapplicable', 'tbd')
            UNION ALL SELECT ref_id, 'p:' || upper(substr(c, 1, 5)) || '-' || substr(c, 6) FROM (
              SELECT ref_id, regexp_replace(unnest(regexp_extract_all(t, '(?:^|[^A-Za-z0-9])([A-Za-z][\s_.\-–]*\d{4}[\s_.\-–]*\d{2})', 1)), '[^A-Za-z0-9]', '', 'g') AS c
              FROM (SELECT ref_id, project AS t FROM plan_sets UNION ALL SELECT ref_id, sheet_no FROM plan_pages)))),
        edges AS (SELECT DISTINCT a.node AS a, b.node AS b FROM named a JOIN named b USING (ref_id)),
        reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
        groups AS (SELECT a AS node, min(b) AS label, min(b) FILTER (b LIKE 'p:%') AS code FROM reach GROUP BY a),
        refs AS (SELECT DISTINCT ref_id, label, code FROM named JOIN groups USING (node))
"""

# Pieces by the farthest boundary in reach, one after the other.
_P2 = """
    WITH RECURSIVE sheets AS (SELECT DISTINCT tiling_id, full_width AS w, full_height AS h, tile_size AS t, coalesce(overlap, 0) AS o, x_breaks AS xb, y_breaks AS yb FROM tiled_sheets WHERE tile_size > 0 AND coalesce(overlap, 0) >= 0 AND coalesce(overlap, 0) < tile_size),
    numbered AS (SELECT *, row_number() OVER () AS request FROM sheets),
    axes AS (
      SELECT request, tiling_id, 'x' AS axis, w AS l, t, o, list_concat(list_filter(coalesce(xb, []), lambda v: v > o AND v < w), [w]) AS s FROM numbered WHERE w > 0
      UNION ALL SELECT request, tiling_id, 'y', h, t, o, list_concat(list_filter(coalesce(yb, []), lambda v: v > o AND v < h), [h]) FROM numbered WHERE h > 0),
    cuts AS (
      SELECT request, axis, -1 AS piece, o AS prev, o AS pos, true AS is_natural FROM axes WHERE l > t
      UNION ALL SELECT request, axis, piece + 1, pos, coalesce(far, pos + t - o), far IS NOT NULL
      FROM (SELECT c.*, a.t, a.o, a.l, list_max(list_filter(a.s, lambda v: v > c.pos AND v <= c.pos + a.t - a.o)) AS far FROM cuts c JOIN axes a USING (request, axis) WHERE c.pos < a.l)),
    pieces AS (
      SELECT a.*, piece, prev - o AS px_start, pos AS px_end, CASE WHEN pos = l THEN 'end' WHEN is_natural THEN 'gutter' ELSE 'limit' END AS ends_at FROM cuts JOIN axes a USING (request, axis) WHERE piece >= 0
      UNION ALL SELECT *, 0, 0, l, 'end' FROM axes WHERE l <= t)
"""

ORACLE = {
    "p2_axis_pieces": _P2 + "SELECT DISTINCT tiling_id, axis, l AS length, t AS tile, o AS overlap, piece, px_start, px_end, ends_at FROM pieces WHERE l > t",
    "p2_pieces": _P2 + """SELECT DISTINCT x.tiling_id, y.piece AS row, x.piece AS col, x.px_start AS px_x, y.px_start AS px_y, x.px_end - x.px_start AS px_w, y.px_end - y.px_start AS px_h
        FROM pieces x JOIN pieces y USING (request) WHERE x.axis = 'x' AND y.axis = 'y' AND (x.l > x.t OR y.l > y.t)""",
    "p1_found": _P1 + "SELECT ref_id, substr(code, 3) AS group_key FROM (SELECT *, count(*) OVER (PARTITION BY label) AS n FROM refs) WHERE n > 1",
    # Components in the order of a hash: the large ones go where most is missing, one after the other; the others fill
    # what is missing then.
    "p1_splits": _P1 + """,
        rows AS (SELECT ref_id, coalesce(substr(code, 3), label, 'r:' || ref_id) AS component FROM (SELECT DISTINCT ref_id FROM plan_sets WHERE ref_id IS NOT NULL) LEFT JOIN refs USING (ref_id)),
        sizes AS (SELECT *, sum(n) OVER () AS total FROM (SELECT component, count(*) AS n, sha1('0:' || component) AS h FROM rows GROUP BY component)),
        large AS (SELECT *, row_number() OVER (ORDER BY h, component) AS k FROM sizes WHERE n > 0.001::DOUBLE * total),
        wanted AS (SELECT list(split_name ORDER BY share DESC, split_name) AS names, list(share / (SELECT sum(share) FROM split_shares) * (SELECT max(total) FROM sizes)::DOUBLE ORDER BY share DESC, split_name) AS m FROM split_shares WHERE share > 0),
        dealt AS (
          SELECT 0::BIGINT AS k, NULL::VARCHAR AS component, NULL::INT AS choice, m FROM wanted
          UNION ALL SELECT k, component, choice, list_transform(m, lambda x, j: CASE WHEN j = choice THEN x - n ELSE x END)
          FROM (SELECT l.k, l.component, l.n, d.m, list_position(d.m, list_max(d.m)) AS choice FROM dealt d JOIN large l ON l.k = d.k + 1)),
        missing AS (SELECT list_transform(arg_max(m, k), lambda x: greatest(x, 0)) AS m FROM dealt),
        small AS (SELECT component, n, coalesce(sum(n) OVER (ORDER BY h, component ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2 AS place, sum(n) OVER () AS filled FROM sizes WHERE n <= 0.001::DOUBLE * total),
        ends AS (SELECT names, list_transform(missing.m, lambda x, j: list_sum(missing.m[1:j])) AS e, list_position(missing.m, list_max(missing.m)) AS most FROM missing, wanted),
        placed AS (
          SELECT component, names[choice] AS split_name FROM dealt, wanted WHERE choice IS NOT NULL
          UNION ALL SELECT component, coalesce(names[list_position(list_transform(e, lambda x: place < x * filled / e[-1]), true)], names[most]) FROM small, ends)
        SELECT ref_id, component, split_name FROM rows JOIN placed USING (component)""",
    "p2_found": """
        WITH axes AS (
          SELECT tiling_id, 'x' AS axis, full_width AS l, tile_size AS t, coalesce(overlap, 0) AS o, x_breaks AS b FROM tiled_sheets
          UNION ALL SELECT tiling_id, 'y', full_height, tile_size, coalesce(overlap, 0), y_breaks FROM tiled_sheets),
        bounds AS (
          SELECT DISTINCT tiling_id, axis, t - o AS step, list_concat([o], list_sort(list_filter(coalesce(b, []), lambda v: v > o AND v < l)), [l]) AS s
          FROM axes WHERE l > t AND t > 0 AND o >= 0 AND o < t)
        SELECT DISTINCT tiling_id, axis,
          CASE WHEN list_bool_and(list_transform(range(2, len(s) + 1), lambda k: s[k] - s[k - 1] <= step)) THEN 'natural' ELSE 'forced' END AS fit
        FROM bounds
    """,
    "p3_pairs": _P3 + "SELECT least(t, e) AS file_a, greatest(t, e) AS file_b, by_hash, by_url, by_name FROM pairs",
    "p3_report": _P3 + r""", flags AS (SELECT e AS file_id, bool_or(by_hash) AS h, bool_or(by_url) AS u, bool_or(by_name) AS n FROM pairs GROUP BY e),
        held AS (SELECT DISTINCT file_id, ref_id, CASE WHEN s IN ('test', 'testing', 'tst') THEN 'test' ELSE 'validation' END AS split
          FROM (SELECT *, regexp_replace(lower(split_name), '[\s_\-]+', '', 'g') AS s FROM source_files) WHERE s IN ('val', 'valid', 'validation', 'dev', 'test', 'testing', 'tst')),
        named AS (SELECT ref_id, min(nullif(regexp_replace(lower(source), '[\s_\-]+', '', 'g'), '')) AS source FROM plan_sets GROUP BY ref_id)
        SELECT split, source, count(*) AS n_files, count(flags.file_id) AS n_overlapping, count(*) FILTER (h) AS by_hash, count(*) FILTER (u) AS by_url, count(*) FILTER (n) AS by_name
        FROM held LEFT JOIN named USING (ref_id) LEFT JOIN flags USING (file_id) GROUP BY split, source""",
    "p3_found": _P3 + "SELECT least(t, e) AS file_a, greatest(t, e) AS file_b FROM pairs",
    "p6_documents": "SELECT pack_name, count(DISTINCT doc_id) AS n_documents FROM documents CROSS JOIN pack_sizes WHERE capacity_tokens > 0 GROUP BY pack_name",
    "p6_violations": "SELECT '' AS pack_name, 0::BIGINT AS item, '' AS problem WHERE false",
    "p7_violations": "SELECT '' AS source, 0::BIGINT AS item, '' AS problem WHERE false",
    "p8_shares": r"""
        WITH words AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
        runs AS (SELECT id, k, run, w[k:k + run - 1] AS g FROM (SELECT id, w, run, unnest(range(1, len(w) - run + 2)) AS k FROM words, (VALUES (1), (3), (6)) r(run))),
        again AS (SELECT id, run, k FROM (SELECT id, run, k, min(k) OVER (PARTITION BY id, run, g) AS first FROM runs) WHERE k > first),
        covered AS (SELECT id, run, count(DISTINCT p) AS n FROM (SELECT id, run, unnest(range(k, k + run)) AS p FROM again) GROUP BY ALL)
        SELECT doc_id, len(w) AS n_words, round(coalesce(max(n) FILTER (run = 1), 0) / greatest(len(w), 1), 9) AS share_1, round(coalesce(max(n) FILTER (run = 3), 0) / greatest(len(w), 1), 9) AS share_3, round(coalesce(max(n) FILTER (run = 6), 0) / greatest(len(w), 1), 9) AS share_6
        FROM words LEFT JOIN covered USING (id) GROUP BY id, doc_id, w
    """,
    "p8_found": r"""
        WITH words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
        grams AS (SELECT doc_id, k, w[k:k+5] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 4)) AS k FROM words)),
        again AS (SELECT doc_id, k FROM (SELECT doc_id, k, min(k) OVER (PARTITION BY doc_id, g) AS first FROM grams) WHERE k > first),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + 6)) AS p FROM again) GROUP BY 1)
        SELECT doc_id FROM covered JOIN words USING (doc_id) WHERE n / len(w) >= 0.3
    """,
}
