"""Queries that read drawings' texts and plan-set indexes, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.common import table
from quillspan.functions import fixed, text
from quillspan.operators import plansets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_LETTERS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in fixed.DISCIPLINES.items()) + "}"
_SHEET = fixed.SHEET_NUMBER.replace("'", "''")
_IMPERIAL = fixed.IMPERIAL.replace("'", "''")


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


_NUMBERED = rf"""WITH lined AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\r\n|[\n\r\v\f]'), lambda x: contains(upper(x), 'SHEET') AND regexp_matches(x, '{_SHEET}'))[1] AS line FROM documents),
    picked AS (SELECT doc_id, coalesce(line, text) AS t FROM lined),
    numbered AS (SELECT doc_id, regexp_extract(t, '{_SHEET}', 1) || '-' || regexp_extract(t, '{_SHEET}', 2) || regexp_extract(t, '{_SHEET}', 3) AS sheet_number FROM picked WHERE regexp_matches(t, '{_SHEET}'))
"""


@_query(_NUMBERED + f"SELECT doc_id, sheet_number, {_LETTERS}[substr(sheet_number, 1, 1)] AS discipline FROM numbered")
def text_sheet_numbers(s, d):
    block = text.title_block(F.col("text"))
    rows = table(s, d, "documents").select("doc_id", block["sheet_number"].alias("sheet_number"), block["discipline"].alias("discipline"))
    return rows.where("sheet_number IS NOT NULL")


@_query(rf"""WITH found AS (SELECT doc_id, unnest(regexp_extract_all(text, '{fixed.CALLOUT}')) AS c FROM documents)
    SELECT doc_id, regexp_extract(c, '{fixed.CALLOUT}', 1) AS detail, regexp_extract(c, '{fixed.CALLOUT}', 2) AS sheet, 0.9 AS confidence FROM found GROUP BY ALL""")
def text_callouts(s, d):
    rows = table(s, d, "documents").select("doc_id", F.explode(text.cross_references(F.col("text"))).alias("c"))
    return rows.select("doc_id", "c.detail", "c.sheet", F.lit(0.9).alias("confidence"))


@_query(rf"""WITH t AS (SELECT doc_id, text FROM documents WHERE NOT regexp_matches(text, '{fixed.NOT_TO_SCALE}')),
    m AS (SELECT doc_id, regexp_extract(text, '{fixed.METRIC}', 0) AS raw, regexp_extract(text, '{fixed.METRIC}', 1)::DOUBLE AS a, regexp_extract(text, '{fixed.METRIC}', 2)::DOUBLE AS b FROM t
      WHERE regexp_matches(text, '{fixed.METRIC}') AND NOT regexp_matches(text, '{_IMPERIAL}'))
    SELECT doc_id, trim(raw) AS raw, 'm' AS unit, round(a / b, 9) AS ratio, 0.95 AS confidence FROM m WHERE b > 0""")
def text_scales(s, d):
    scale = text.parse_scale(F.col("text"))
    rows = table(s, d, "documents").select("doc_id", scale.alias("s")).where("s IS NOT NULL")
    return rows.select("doc_id", "s.raw", F.col("s.real_world_unit").alias("unit"), F.round("s.ratio", 9).alias("ratio"), "s.confidence")


@_query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(lower(text), '[\s\v\p{Z}]+', ' ', 'g'), '^ | $', '', 'g')) AS digest FROM documents WHERE text IS NOT NULL")
def text_normalized(s, d):
    rows = table(s, d, "documents").where("text IS NOT NULL")
    return rows.select("doc_id", F.md5(text.norm_text(F.col("text"))).alias("digest"))


_NAMES = f"""WITH names AS (SELECT DISTINCT ref_id, filename FROM plan_sets WHERE filename IS NOT NULL)
    SELECT ref_id, trim(regexp_replace(url_decode(filename), '[^\\w.\\-]+', '_', 'g'), '_') AS local_name,
      NOT regexp_matches(lower(filename), '{"|".join(fixed.OTHER_WORDS)}') AND regexp_matches(lower(filename), '{"|".join(fixed.PLAN_WORDS)}') AS is_drawing_set,
      CASE WHEN regexp_matches(filename, '{fixed.PROJECT}') THEN regexp_extract(filename, '{fixed.PROJECT}', 1) ELSE regexp_replace(filename, '(.)\\.[^.]*$', '\\1') END AS project FROM names"""


@_query(_NAMES)
def planset_names(s, d):
    rows = table(s, d, "plan_sets").where("filename IS NOT NULL").select("ref_id", "filename").distinct()
    name = F.col("filename")
    return rows.select("ref_id", text.sanitized(name).alias("local_name"), text.is_drawing_set(name).alias("is_drawing_set"), text.project_code(name).alias("project"))


def _sets(s, d):
    return table(s, d, "plan_sets").select("ref_id", "source", "project", "error").distinct()


def _pages(s, d):
    return table(s, d, "plan_pages").distinct()


@_query("SELECT source, count(*) AS n_sets, count(*) FILTER (error IS NULL) AS n_sets_ok, count(DISTINCT project) AS n_projects FROM (SELECT DISTINCT ref_id, source, project, error FROM plan_sets) GROUP BY source")
def planset_totals(s, d):
    return plansets.index_totals(_sets(s, d))


@_query("""SELECT *, row_number() OVER (ORDER BY n DESC, discipline_letter) AS rank FROM (SELECT discipline_letter, count(*) AS n FROM (SELECT DISTINCT * FROM plan_pages) WHERE discipline_letter IS NOT NULL GROUP BY 1)""")
def planset_disciplines(s, d):
    return plansets.discipline_totals(_pages(s, d))


@_query("""WITH p AS (SELECT ref_id, discipline_letter, count(*) AS n FROM (SELECT DISTINCT * FROM plan_pages) GROUP BY ALL)
    SELECT ref_id, coalesce(sum(n), 0)::INT AS n_pages, coalesce(string_agg(discipline_letter || n, ',' ORDER BY discipline_letter) FILTER (discipline_letter IS NOT NULL), '') AS letters
    FROM (SELECT DISTINCT ref_id FROM plan_sets) LEFT JOIN p USING (ref_id) GROUP BY ref_id""")
def planset_records(s, d):
    rows = plansets.set_records(_sets(s, d).select("ref_id").distinct(), _pages(s, d))
    letters = F.array_join(F.transform(F.map_entries("by_discipline"), lambda e: F.concat(e["key"], e["value"].cast("string"))), ",")
    return rows.select("ref_id", "n_pages", F.coalesce(letters, F.lit("")).alias("letters"))


def _indexed(s, d):
    return _pages(s, d).join(_sets(s, d).select("ref_id", "project").distinct(), "ref_id")


_INDEXED = "WITH indexed AS (SELECT * FROM (SELECT DISTINCT * FROM plan_pages) JOIN (SELECT DISTINCT ref_id, project FROM plan_sets) USING (ref_id))"


@_query(_INDEXED + """SELECT project, ref_id, page, sheet_no, turn FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY ref_id, page) AS turn FROM indexed
      WHERE upper(substr(discipline_letter, 1, 1)) = 'E' AND sheet_no IS NOT NULL AND project IS NOT NULL) ORDER BY turn, project LIMIT 50""")
def select_round_robin(s, d):
    """A report of 50 sheets: the limit is the feature."""
    return plansets.round_robin(_indexed(s, d), letter="E", count=50).select("project", "ref_id", "page", "sheet_no", "turn")


@_query(_INDEXED + """SELECT letter, ref_id, page, n FROM (SELECT *, row_number() OVER (PARTITION BY letter ORDER BY ref_id, page) AS n FROM (SELECT *, upper(substr(discipline_letter, 1, 1)) AS letter FROM indexed) WHERE letter IN ('E', 'A')) WHERE n <= 40""")
def select_capped(s, d):
    """The first 40 pages of two disciplines: the cap is the feature."""
    return plansets.capped(_indexed(s, d)).select("letter", "ref_id", "page", "n")


@_query(f"SELECT ref_id, page, sheet_no, {_LETTERS}[upper(substr(regexp_extract(sheet_no, '{_SHEET}', 1), 1, 1))] AS discipline FROM (SELECT DISTINCT * FROM plan_pages) WHERE regexp_matches(sheet_no, '{_SHEET}')")
def planset_page_disciplines(s, d):
    records = plansets.page_records(_pages(s, d).select("ref_id", "page", F.col("sheet_no").alias("text"), "width_pt", "height_pt"))
    given = _pages(s, d).select("ref_id", "page", F.col("sheet_no").alias("given"))
    return records.where("sheet_no IS NOT NULL").select("ref_id", "page", "discipline").join(given, ["ref_id", "page"]).select("ref_id", "page", F.col("given").alias("sheet_no"), "discipline")
