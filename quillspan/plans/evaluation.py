"""Queries of the evaluation matrix, projections, audits and datasets, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.common import cut, table
from quillspan.functions import fixed
from quillspan.operators import boards, drawing, evaluation, grounding, licensing, metrics, registry, tiling
from quillspan.operators.nested import flat_table, flatten, unreadable
from quillspan.plans import drawings, records
from quillspan.plans.drawings import _BASE, _KEY, _LABELS, _connections, _entities, _literal, _sheets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_RECORD = ["set_key", "record"]


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# --- projections and audits of nested records ------------------------------------------------------------------------


def _tables(s: SparkSession, d: str, *kinds: str) -> list[DataFrame]:
    flat = cut(flatten(table(s, d, "raw_drawing_sets"), kinds=kinds, with_origin=True))  # one reading for all tables
    return [flat_table(flat, k, records._COLUMNS[k]) for k in kinds]


_PLANS = records._P4.rstrip() + f""",
    plans AS (SELECT set_key, record, CASE WHEN min(v) IS NOT NULL THEN min(v) ELSE min(s) END AS sheet_ord FROM (
      SELECT set_key, record, sheet_ord AS s, NULL::INT AS v FROM sheet UNION ALL SELECT set_key, record, NULL, sheet_ord FROM view WHERE lower({records._member("o", "view_type")}) = 'plan') GROUP BY set_key, record),
    found AS (SELECT e.set_key, e.record, e.sheet_ord, view_ord, item_ord, {records._member("o", "id")} AS id FROM entity e JOIN plans USING (set_key, record, sheet_ord)
      WHERE {records._member("o", "label")} IN ({_LABELS}) AND {records._member("o", "geometry")} IS NOT NULL)
"""


@_query(_PLANS + "SELECT * FROM plans")
def plan_sheets(s, d):
    sheets, views = _tables(s, d, "sheet", "view")
    return drawing.plan_sheets(sheets, views, _RECORD)


@_query(_PLANS + "SELECT * FROM found")
def detection_projection(s, d):
    sheets, views, entities = _tables(s, d, "sheet", "view", "entity")
    kept = drawing.detection_projection(entities, drawing.plan_sheets(sheets, views, _RECORD), _RECORD, labels=grounding.LABELS)
    return kept.select(*_RECORD, "sheet_ord", "view_ord", "item_ord", "id")


@_query(_PLANS + f""", runs AS (SELECT c.set_key, c.record, item_ord, {records._member("o", "source_id")} AS source_id, {records._member("o", "target_id")} AS target_id FROM connection c JOIN plans USING (set_key, record, sheet_ord) WHERE view_ord = 0)
    SELECT r.* FROM runs r WHERE EXISTS (FROM found f WHERE f.set_key = r.set_key AND f.record = r.record AND f.id = r.source_id) AND EXISTS (FROM found f WHERE f.set_key = r.set_key AND f.record = r.record AND f.id = r.target_id)""")
def graph_projection(s, d):
    sheets, views, entities, connections = _tables(s, d, "sheet", "view", "entity", "connection")
    kept = drawing.graph_projection(entities, connections, drawing.plan_sheets(sheets, views, _RECORD), _RECORD, labels=grounding.LABELS)
    return kept.select(*_RECORD, "item_ord", "source_id", "target_id")


_SAFE_LIST = _literal(*fixed.COMMERCIAL_SAFE)
_AUDIT = records._P4.rstrip() + f""",
    unread AS (SELECT * FROM ({records.UNREADABLE})),
    own AS (SELECT set_key, record, {records._member("o", "license_provenance")} AS license, {records._member("o", "data_lane")} AS lane FROM sets),
    inside AS (SELECT e.set_key, e.record, {records._member("o", "license_provenance")} AS license, {records._member("o", "data_lane")} AS lane FROM entity e)
"""


@_query(_AUDIT + f"""SELECT set_key, 'unreadable' AS problem, reason AS detail FROM unread
    UNION SELECT set_key, 'licence of the set', license FROM own WHERE lane = 'commercial' AND NOT coalesce(license IN ({_SAFE_LIST}), false)
    UNION SELECT i.set_key, 'licence of entities', string_agg(DISTINCT coalesce(i.license, 'none'), ',' ORDER BY coalesce(i.license, 'none')) FROM inside i JOIN own o USING (set_key, record)
      WHERE o.lane = 'commercial' AND (NOT coalesce(i.license IN ({_SAFE_LIST}), false) OR i.lane IS DISTINCT FROM 'commercial') GROUP BY i.set_key""")
def audit_documents(s, d):
    sets, entities = _tables(s, d, "set", "entity")
    return registry.audit_documents(sets, entities, unreadable(table(s, d, "raw_drawing_sets")))


@_query(_AUDIT + "SELECT count(*) AS n_scanned, count(*) FILTER (lane = 'commercial') AS n_commercial, (SELECT count(*) FROM unread) AS n_unreadable FROM own")
def audit_counts(s, d):
    (sets,) = _tables(s, d, "set")
    return registry.audit_counts(sets, unreadable(table(s, d, "raw_drawing_sets")))


_KNOWN = {"entity_type": fixed.ENTITY_TYPES, "license_provenance": fixed.COMMERCIAL_SAFE + fixed.RESEARCH_ONLY, "data_lane": fixed.LANES}


@_query(_BASE + " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS value, count(*) AS n FROM ents WHERE {c} NOT IN ({_literal(*v)}) GROUP BY {c}" for c, v in _KNOWN.items()))
def unknown_values(s, d):
    return licensing.unknown_values(_entities(s, d))


@_query(_BASE + """SELECT set_id, sum(a)::BIGINT AS n_sheets, sum(b)::BIGINT AS n_entities, sum(c)::BIGINT AS n_connections FROM (
      SELECT set_id, 1 AS a, 0 AS b, 0 AS c FROM sheets UNION ALL SELECT set_id, 0, 1, 0 FROM ents UNION ALL SELECT set_id, 0, 0, 1 FROM conns) GROUP BY set_id""")
def set_summaries(s, d):
    return drawing.summaries(_sheets(s, d), _entities(s, d), _connections(s, d))


# --- datasets --------------------------------------------------------------------------------------------------------


@_query(drawings._BASE + drawings._ASSIGNED + f""", local AS (
      SELECT *, greatest(0, least(1, (x_min * w - col * 1344) / (least(col * 1344 + 1536, w) - col * 1344))) AS x0, greatest(0, least(1, (x_max * w - col * 1344) / (least(col * 1344 + 1536, w) - col * 1344))) AS x1,
        greatest(0, least(1, (y_min * h - row * 1344) / (least(row * 1344 + 1536, h) - row * 1344))) AS y0, greatest(0, least(1, (y_max * h - row * 1344) / (least(row * 1344 + 1536, h) - row * 1344))) AS y1 FROM assigned),
    labelled AS (SELECT set_id, sheet_ord, row, col, count(*) AS n, string_agg((list_position([{_LABELS}], label) - 1)::VARCHAR, ' ' ORDER BY list_position([{_LABELS}], label), entity_id) AS classes FROM local WHERE x1 > x0 AND y1 > y0 GROUP BY ALL),
    rows_ AS (SELECT *, unnest(range(CASE WHEN h <= 1536 THEN 1 ELSE ceil((h - 1536) / 1344)::INT + 1 END)) AS row FROM sized WHERE w > 0 AND h > 0),
    grid AS (SELECT *, unnest(range(CASE WHEN w <= 1536 THEN 1 ELSE ceil((w - 1536) / 1344)::INT + 1 END)) AS col FROM rows_)
    SELECT set_id, sheet_ord, row, col, CASE WHEN ('0x' || substr(sha1('0:' || set_id), 1, 15))::UBIGINT / 1152921504606846976.0 < 0.2 THEN 'val' ELSE 'train' END AS split, coalesce(n, 0) AS n_labels, coalesce(classes, '') AS classes
    FROM grid LEFT JOIN labelled USING (set_id, sheet_ord, row, col)""")
def dataset_tiles(s, d):
    sheet = F.concat_ws(":", "set_id", F.col("sheet_ord").cast("string")).alias("sheet_id")
    sized = _sheets(s, d).select("set_id", "sheet_ord", sheet, *[(F.col(c) * drawings._RASTER).cast("int").alias(n) for c, n in (("width_pt", "full_width"), ("height_pt", "full_height"))], F.lit(1536).alias("tile_size"), F.lit(192).alias("overlap"))
    grid = tiling.tiles(sized.drop("set_id", "sheet_ord")).join(sized.select("set_id", "sheet_ord", "sheet_id"), "sheet_id").select("set_id", "sheet_ord", "row", "col")
    tiles_ = boards.hash_split(grid, F.col("set_id"), val_fraction=0.2, seed=0)
    out = tiling.dataset_tiles(tiles_, tiling.label_lines(drawings._assigned(s, d)), ["set_id", "sheet_ord", "row", "col"])
    classes = F.array_join(F.transform(F.filter(F.split("text", "\n"), lambda x: x != ""), lambda x: F.substring_index(x, " ", 1)), " ")
    return out.select("set_id", "sheet_ord", "row", "col", "split", "n_labels", classes.alias("classes"))


_EDGES = """, typed AS (SELECT set_id, sheet_ord, coalesce(nullif(connection_type, ''), 'untyped') AS label, coalesce(confidence, 1) >= 0.5 AS sure FROM conns WHERE set_id IS NOT NULL),
    expected AS (SELECT set_id, sheet_ord, label, count(*) AS n FROM typed WHERE sure GROUP BY ALL), actual AS (SELECT set_id, sheet_ord, label, count(*) AS n FROM typed WHERE NOT sure OR label <> 'untyped' GROUP BY ALL)
"""


@_query(_BASE + _EDGES + """SELECT set_id, sheet_ord, 'missing_sheet' AS code, NULL AS label, NULL::BIGINT AS expected, NULL::BIGINT AS got FROM (SELECT DISTINCT set_id, sheet_ord FROM expected) e WHERE NOT EXISTS (FROM actual a WHERE a.set_id = e.set_id AND a.sheet_ord = e.sheet_ord)
    UNION ALL SELECT e.set_id, e.sheet_ord, 'edge_count', e.label, e.n, coalesce(a.n, 0) FROM expected e LEFT JOIN actual a USING (set_id, sheet_ord, label) WHERE coalesce(a.n, 0) <> e.n AND EXISTS (FROM actual x WHERE x.set_id = e.set_id AND x.sheet_ord = e.sheet_ord)
    UNION ALL SELECT set_id, sheet_ord, 'edge_total', NULL, w, h FROM (SELECT set_id, sheet_ord, sum(n)::BIGINT AS w FROM expected GROUP BY ALL) JOIN (SELECT set_id, sheet_ord, sum(n)::BIGINT AS h FROM actual GROUP BY ALL) USING (set_id, sheet_ord) WHERE w <> h""")
def validate_edges(s, d):
    """Sure connections are what is expected; those without a type are there only if they aren't sure."""
    kind = F.coalesce(F.nullif("connection_type", F.lit("")), F.lit("untyped"))
    rows = _connections(s, d).where("set_id IS NOT NULL").select("set_id", F.col("sheet_ord").alias("sheet_number"), kind.alias("label"), (F.coalesce("confidence", F.lit(1.0)) >= 0.5).alias("sure"))
    count = lambda df: df.groupBy("set_id", "sheet_number", "label").agg(F.count("*").alias("n"))
    return boards.count_issues(count(rows.where("sure")), count(rows.where("NOT sure OR label <> 'untyped'")), kind="edge").withColumnRenamed("sheet_number", "sheet_ord")


# --- matrix ----------------------------------------------------------------------------------------------------------

_KIND = "CASE WHEN substr(md5(set_id), 1, 1) < '8' THEN 'mep' ELSE 'architectural' END"
_ORIGIN = "CASE WHEN substr(md5(set_id), 2, 1) < '8' THEN 'vector' END"


def _samples(s: SparkSession, d: str) -> DataFrame:
    sets = table(s, d, "entities").where("set_id IS NOT NULL").select("set_id").distinct()
    return sets.select(F.col("set_id").alias("doc"), F.expr(_KIND).alias("drawing_type"), F.expr(_ORIGIN).alias("origin"), F.lit(None).cast("string").alias("condition"), F.lit("sets").alias("dataset"))


@_query(f"SELECT {_KIND} AS drawing_type, coalesce({_ORIGIN}, 'unknown') AS origin, 'clean' AS condition, 'sets' AS dataset, count(*) AS n_samples FROM (SELECT DISTINCT set_id FROM entities WHERE set_id IS NOT NULL) GROUP BY ALL")
def harness_slices(s, d):
    return evaluation.slices(_samples(s, d))


def _results(s: SparkSession, d: str) -> DataFrame:
    """The truth, what is sure of it, and a model that sees three quarters of it, others for each seed."""
    truth = metrics.judged(cut(_entities(s, d).where("set_id IS NOT NULL").select("set_id", "doc_ord", "entity_id", "entity_type", "label", "ifc_class", "geometry", "confidence", "attributes")))
    seen = lambda t, seed: t.where(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "entity_id")), 1, 1) < "c")
    models = [
        evaluation.Model("truth", predict=lambda t, seed: t),
        evaluation.Model("sure", predict=lambda t, seed: t.where("confidence >= 0.3")),
        evaluation.Model("sampled", predict=seen, stochastic=True),
        evaluation.reported("published, general models"),
    ]
    return evaluation.run_matrix([evaluation.Task("counting", ("counting_mape", "counting_exact_match"), _samples(s, d), truth)], models)


_MATRIX = _BASE + f""", docs AS (SELECT DISTINCT set_id, {_KIND} AS drawing_type, coalesce({_ORIGIN}, 'unknown') AS origin FROM entities WHERE set_id IS NOT NULL),
    real_ AS (SELECT set_id, {_KEY} AS label, count(*) AS n FROM ents WHERE set_id IS NOT NULL GROUP BY ALL),
    guessed AS (
      SELECT 'truth' AS model, 0 AS seed, set_id, label, n AS m FROM real_
      UNION ALL SELECT 'sure', 0, set_id, {_KEY} AS l, count(*) FROM ents WHERE confidence >= 0.3 GROUP BY ALL
      UNION ALL SELECT 'sampled', seed, set_id, {_KEY} AS l, count(*) FROM ents, (VALUES (0), (1), (2)) v(seed) WHERE substr(md5(seed || ':' || entity_id), 1, 1) < 'c' GROUP BY ALL),
    judged AS (SELECT r.model, r.seed, d.drawing_type, d.origin, t.n, coalesce(g.m, 0) AS m FROM (VALUES ('truth', 0), ('sure', 0), ('sampled', 0), ('sampled', 1), ('sampled', 2)) r(model, seed), real_ t JOIN docs d USING (set_id)
      LEFT JOIN guessed g ON g.model = r.model AND g.seed = r.seed AND g.set_id = t.set_id AND g.label = t.label),
    scores AS (
      SELECT model, seed, drawing_type, origin, 'counting_mape' AS metric, avg(abs(m - n) / n) * 100 AS v FROM judged GROUP BY ALL
      UNION ALL SELECT model, seed, drawing_type, origin, 'counting_exact_match', avg((m = n)::INT) FROM judged GROUP BY ALL),
    results AS (
      SELECT model, metric, avg(v) AS value, coalesce(stddev_samp(v), 0) AS std, CASE WHEN count(*) = 3 THEN 4.303::DOUBLE * stddev_samp(v) / sqrt(3) ELSE 0 END AS ci95, count(*) AS n_seeds, drawing_type, origin, 'clean' AS condition, 'sets' AS dataset, 'measured' AS kind, '' AS citation FROM scores GROUP BY model, metric, drawing_type, origin
      UNION ALL SELECT 'published, general models', metric, v, 0, 0, 1, drawing_type, origin, 'clean', 'sets', 'reported', 'arXiv 2601.04819' FROM (SELECT DISTINCT drawing_type, origin FROM docs), (VALUES ('counting_mape', 20.5::DOUBLE), ('counting_exact_match', 0.51::DOUBLE)) r(metric, v))
"""


@_query(_MATRIX + "SELECT * EXCLUDE (value, std, ci95), round(value, 6) AS value, round(std, 6) AS std, round(ci95, 6) AS ci95 FROM results")
def harness_matrix(s, d):
    return _results(s, d).withColumns({c: F.round(c, 6) for c in ("value", "std", "ci95")})


@_query(_MATRIX + """SELECT metric, drawing_type, model, origin, row_number() OVER (PARTITION BY metric, drawing_type ORDER BY CASE metric WHEN 'counting_mape' THEN value ELSE -value END, model, condition, origin, dataset) AS rank FROM results""")
def harness_ranks(s, d):
    return evaluation.compared(cut(_results(s, d))).select("metric", "drawing_type", "model", "origin", "rank")


# --- answers and drafts of sets --------------------------------------------------------------------------------------


def _counted(rows: DataFrame) -> DataFrame:
    """Sets whose metadata has a question for each label and the number of its entities as the answer."""
    n = rows.where("set_id IS NOT NULL AND label IS NOT NULL").groupBy("set_id", "label").agg(F.count("*").cast("string").alias("answer"))
    pairs = n.groupBy("set_id").agg(F.collect_list(F.struct(F.col("label").alias("q_id"), "answer")).alias("qa_pairs"))  # one of each label
    return pairs.select(F.col("set_id").alias("doc"), F.to_json(F.struct("qa_pairs")).alias("metadata"))


@_query(_BASE + """, t AS (SELECT set_id, label, count(*) AS n FROM ents WHERE set_id IS NOT NULL AND label IS NOT NULL GROUP BY ALL), p AS (SELECT set_id, label, count(*) AS m FROM ents WHERE set_id IS NOT NULL AND label IS NOT NULL AND confidence >= 0.3 GROUP BY ALL)
    SELECT round(avg(coalesce(m = n, false)::INT), 6) AS value FROM t LEFT JOIN p USING (set_id, label)""")
def metric_qa_accuracy(s, d):
    rows = _entities(s, d)
    return metrics.qa_accuracy(_counted(rows.where("confidence >= 0.3")), _counted(rows)).select(F.round("value", 6).alias("value"))


@_query(_BASE + "SELECT round(avg(((label IS NOT NULL AND label <> '')::INT + (confidence < 0.5)::INT + (len(pts) > 0)::INT + (coalesce(ifc_class, '') <> '')::INT) / 4), 6) AS value FROM (SELECT label, confidence, coalesce(pts, []) AS pts, ifc_class FROM ents)")
def metric_rfi_reward(s, d):
    """Each entity as a draft: its label for the clause, its points for the evidence, its doubt for the conflict."""
    part = F.struct(F.col("label").alias("cited_clause"), (F.col("confidence") < 0.5).alias("conflict"), F.coalesce("geometry.points", F.array().cast("array<struct<x:double,y:double>>")).alias("evidence"), F.col("ifc_class").alias("question"))
    sets = _entities(s, d).select(F.to_json(F.struct(part.alias("rfi"))).alias("metadata"))
    return metrics.rfi_reward(sets).select(F.round("value", 6).alias("value"))
