"""Queries over current entities and connections, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.common import cut, table
from quillspan.functions import fixed, geometry
from quillspan.operators import boards, fewshot, graph, grounding, licensing, metrics, questions, takeoff, tiling
from quillspan.operators.drawing import current, on_sheets, sheets_of

_RASTER = 4  # pixels of a sheet's raster per point


def _sheets(s: SparkSession, d: str) -> DataFrame:
    return sheets_of(table(s, d, "plan_sets"), table(s, d, "plan_pages"))


def _entities(s: SparkSession, d: str) -> DataFrame:
    return current(table(s, d, "entities"), "set_id", "entity_id")


def _connections(s: SparkSession, d: str) -> DataFrame:
    return current(table(s, d, "connections"), "conn_id", deleted=None)


def _rows(s: SparkSession, d: str) -> DataFrame:
    return on_sheets(_entities(s, d), _sheets(s, d))


def _r(c: Column | str, places: int = 6) -> Column:
    name = c if isinstance(c, str) else None
    rounded = F.round(F.col(c) if isinstance(c, str) else c, places)
    return rounded.alias(name) if name else rounded


def _literal(*values: str) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# Current entities with their box, on their sheets; current connections.
_BASE = """
    WITH RECURSIVE sheets AS (
      SELECT set_id, page AS sheet_ord, sheet_no AS sheet_number, lower(d) AS discipline, width_pt, height_pt
      FROM (SELECT set_id, min(ref_id) AS ref_id FROM plan_sets WHERE set_id IS NOT NULL GROUP BY set_id)
      JOIN (SELECT ref_id, page, max(sheet_no) AS sheet_no, max(discipline) AS d, max(width_pt) AS width_pt, max(height_pt) AS height_pt FROM plan_pages GROUP BY ref_id, page) USING (ref_id)),
    newest AS (SELECT * FROM entities QUALIFY row_number() OVER (PARTITION BY set_id, entity_id ORDER BY recorded_at DESC, is_deleted DESC) = 1),
    boxed AS (
      SELECT *, geometry.points AS pts, geometry.type IN ('circle', 'arc') AND geometry.radius IS NOT NULL AS is_round
      FROM newest WHERE NOT is_deleted),
    ents AS (
      SELECT *, CASE WHEN len(pts) > 0 THEN CASE WHEN is_round THEN pts[1].x - abs(geometry.radius) ELSE list_min(list_transform(pts, lambda p: p.x)) END END AS x_min,
        CASE WHEN len(pts) > 0 THEN CASE WHEN is_round THEN pts[1].y - abs(geometry.radius) ELSE list_min(list_transform(pts, lambda p: p.y)) END END AS y_min,
        CASE WHEN len(pts) > 0 THEN CASE WHEN is_round THEN pts[1].x + abs(geometry.radius) ELSE list_max(list_transform(pts, lambda p: p.x)) END END AS x_max,
        CASE WHEN len(pts) > 0 THEN CASE WHEN is_round THEN pts[1].y + abs(geometry.radius) ELSE list_max(list_transform(pts, lambda p: p.y)) END END AS y_max
      FROM boxed),
    placed AS (
      SELECT e.*, coalesce(s.discipline, 'unknown') AS discipline, coalesce(s.sheet_number, '#' || e.sheet_ord) AS sheet_number
      FROM ents e LEFT JOIN sheets s USING (set_id, sheet_ord)),
    conns AS (SELECT *, coalesce(nullif(connection_type, ''), 'unspecified') AS ctype FROM connections QUALIFY row_number() OVER (PARTITION BY conn_id ORDER BY recorded_at DESC) = 1)
"""
_COUNTED = f"label IS NOT NULL AND entity_type NOT IN ({_literal(*fixed.NOT_COUNTED)})"
_ANSWERED = f"label IS NOT NULL AND entity_type NOT IN ({_literal(*fixed.NOT_ANSWERED)})"
_AREA = "greatest(x_max - x_min, 0) * greatest(y_max - y_min, 0)"
_SHOELACE = "abs(list_sum(list_transform(range(1, len(pts) + 1), lambda k: pts[k].x * pts[k % len(pts) + 1].y - pts[k % len(pts) + 1].x * pts[k].y))) / 2"
_KEY = "coalesce(nullif(label, ''), nullif(ifc_class, ''), entity_type)"
_SAFE = f"coalesce(license_provenance IN ({_literal(*fixed.COMMERCIAL_SAFE)}), false)"
_LABELS = _literal(*grounding.LABELS)
_ONTOLOGY = "(VALUES " + ", ".join(f"({_literal(label.strip().lower(), *codes)})" for codes, labels in fixed.ONTOLOGY.items() for label in labels) + ") AS o(key, ifc, masterformat, uniformat)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None, base: bool = True):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = (_BASE if base else "") + sql
        return f

    return register


# --- takeoff -------------------------------------------------------------------------------------------------------


@_query(f"""
    SELECT set_id, discipline, label, 'EA' AS unit, count(*) AS n, round(avg(confidence), 9) AS avg_confidence, count(*) FILTER (confidence < 0.5) AS needs_review,
      arg_min(c.mf, doc_ord) FILTER (c.coded) AS masterformat, arg_min(c.ifc, doc_ord) FILTER (c.coded) AS ifc_class
    FROM (SELECT *, {{'mf': coalesce(ontology.masterformat, '~'), 'ifc': coalesce(ifc_class, '~'), 'coded': coalesce(ontology.masterformat, '') <> '' OR coalesce(ifc_class, '') <> ''}} AS c FROM placed WHERE {_COUNTED})
    GROUP BY set_id, discipline, label""")
def takeoff_lines(s, d):
    tilde = lambda c: F.when(F.col("masterformat").isNotNull() | F.col("ifc_class").isNotNull(), F.coalesce(c, F.lit("~"))).alias(c)
    return takeoff.takeoff_lines(_rows(s, d)).select("set_id", "discipline", "label", "unit", "n", _r("avg_confidence", 9), "needs_review", tilde("masterformat"), tilde("ifc_class"))


@_query(f"SELECT set_id, discipline, label, sheet_number, entity_id, confidence, x_min, y_min, x_max, y_max FROM placed WHERE {_COUNTED} AND confidence >= 0.25")
def takeoff_evidence(s, d):
    return takeoff.takeoff_evidence(_rows(s, d), min_confidence=0.25)


@_query(f"SELECT set_id, discipline, label, sheet_number, entity_id, confidence, x_min, y_min, x_max, y_max FROM placed WHERE {_COUNTED}")
def takeoff_evidence_all(s, d):
    return takeoff.takeoff_evidence(_rows(s, d))


@_query(f"SELECT set_id, sheet_number, label, count(*) AS n FROM placed WHERE {_COUNTED} GROUP BY ALL")
def takeoff_by_sheet(s, d):
    return takeoff.by_sheet(_rows(s, d))


@_query(f"""SELECT set_id, discipline, count(*) AS n, count(*) FILTER (confidence < 0.5) AS needs_review FROM placed WHERE {_COUNTED}
    GROUP BY GROUPING SETS ((set_id, discipline), (set_id), ())""")
def takeoff_totals(s, d):
    return takeoff.totals(takeoff.takeoff_lines(_rows(s, d)))


@_query("SELECT set_id, ctype AS connection_type, count(*) AS n FROM conns GROUP BY ALL")
def takeoff_connections(s, d):
    return takeoff.connection_counts(_connections(s, d))


_QUANTITIES = f"""
    , spots AS (SELECT set_id, entity_id, (x_min + x_max) / 2 AS x, (y_min + y_max) / 2 AS y FROM ents WHERE x_min IS NOT NULL),
    sums AS (
      SELECT c.set_id, 'linear' AS kind, c.ctype AS name, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS q
      FROM conns c JOIN spots a ON a.set_id = c.set_id AND a.entity_id = c.source_id JOIN spots b ON b.set_id = c.set_id AND b.entity_id = c.target_id
      UNION ALL SELECT set_id, 'linear', 'Wall', greatest(x_max - x_min, y_max - y_min) FROM ents WHERE entity_type = 'wall' AND label IS NOT NULL AND x_min IS NOT NULL
      UNION ALL SELECT set_id, 'area', label, CASE WHEN len(pts) >= 3 THEN {_SHOELACE} ELSE {_AREA} END FROM ents WHERE entity_type = 'room' AND label IS NOT NULL AND x_min IS NOT NULL)
"""


@_query(_QUANTITIES + """SELECT set_id, kind, name, CASE kind WHEN 'linear' THEN 'norm' ELSE 'norm²' END AS unit, count(*) AS n, round(sum(q), 2) AS quantity, false AS scale_known
    FROM sums GROUP BY ALL""")
def takeoff_quantities(s, d):
    return takeoff.quantities(_entities(s, d), _connections(s, d))


def _scales(s: SparkSession, d: str) -> DataFrame:
    # The pages' sizes are in points; their drawings are taken at full size.
    none = F.lit(None).cast("string")
    return takeoff.scales(_sheets(s, d).select("set_id", "sheet_ord", F.col("width_pt").alias("width"), F.col("height_pt").alias("height"), F.lit("pt").alias("size_unit"), F.lit(1.0).alias("ratio"), none.alias("real_world_unit")))


_SCALES = ", scales AS (SELECT set_id, arg_min(width_pt, sheet_ord) AS w, arg_min(width_pt * height_pt, sheet_ord) AS a FROM sheets WHERE width_pt IS NOT NULL AND height_pt IS NOT NULL GROUP BY set_id)"


@_query(_SCALES + "SELECT set_id, w AS length_factor, a AS area_factor, 'pt' AS unit FROM scales")
def takeoff_scales(s, d):
    return _scales(s, d).select("set_id", F.col("scale.length").alias("length_factor"), F.col("scale.area").alias("area_factor"), F.col("scale.unit").alias("unit"))


@_query(_QUANTITIES + _SCALES + """SELECT set_id, kind, name, coalesce(max(CASE WHEN w IS NOT NULL THEN 'pt' END), 'norm') || CASE kind WHEN 'linear' THEN '' ELSE '²' END AS unit, count(*) AS n,
      round(sum(q) * coalesce(max(CASE kind WHEN 'linear' THEN w ELSE a END), 1), 2) AS quantity, max(w) IS NOT NULL AS scale_known
    FROM sums LEFT JOIN scales USING (set_id) GROUP BY set_id, kind, name""")
def takeoff_scaled(s, d):
    return takeoff.quantities(_entities(s, d), _connections(s, d), _scales(s, d))


# --- grounding and labels ------------------------------------------------------------------------------------------


@_query(f"""SELECT set_id, entity_id, CASE WHEN key IS NOT NULL THEN ifc ELSE ifc_class END AS ifc_class, CASE WHEN key IS NOT NULL THEN o.masterformat ELSE e.ontology.masterformat END AS masterformat,
      CASE WHEN key IS NOT NULL THEN o.uniformat ELSE e.ontology.uniformat END AS uniformat, CASE WHEN label IS NOT NULL THEN key IS NOT NULL END AS grounded
    FROM ents e LEFT JOIN {_ONTOLOGY} ON lower(trim(label)) = key""")
def ground_entities(s, d):
    return grounding.ground(_entities(s, d)).select("set_id", "entity_id", "ifc_class", F.col("ontology.masterformat").alias("masterformat"), F.col("ontology.uniformat").alias("uniformat"), "grounded")


@_query(f"SELECT set_id, count(key) AS grounded, count(label) AS total FROM ents e LEFT JOIN {_ONTOLOGY} ON lower(trim(label)) = key GROUP BY set_id")
def ground_coverage(s, d):
    return grounding.coverage(grounding.ground(_entities(s, d)))


@_query(f"SELECT set_id, {_KEY} AS label, count(*) AS n FROM ents GROUP BY ALL")
def effective_labels(s, d):
    label = grounding.matched_label(F.col("label"), F.col("ifc_class"), F.col("entity_type"))
    return _entities(s, d).groupBy("set_id", label.alias("label")).agg(F.count("*").alias("n"))


_OWN_MAP = {"door": "Door", "window": "Window", "pump": "Equipment", "valve": "Equipment"}


@_query("SELECT set_id, CASE label WHEN 'door' THEN 'Door' WHEN 'window' THEN 'Window' ELSE 'Equipment' END AS label, count(*) AS n FROM ents WHERE label IN ('door', 'window', 'pump', 'valve') GROUP BY ALL")
def crosswalk_labels(s, d):
    return grounding.remap(_entities(s, d), _OWN_MAP).groupBy("set_id", "label").agg(F.count("*").alias("n"))


@_query(f"SELECT set_id, label, list_position([{_LABELS}], label) - 1 AS class_index, count(*) AS n FROM ents WHERE label IN ({_LABELS}) AND x_min IS NOT NULL AND {_AREA} > 0 GROUP BY ALL")
def detection_targets(s, d):
    rows = tiling.targets_of(_entities(s, d), labels=grounding.LABELS)
    return rows.groupBy("set_id", "label", grounding.class_index(F.col("label")).alias("class_index")).agg(F.count("*").alias("n"))


@_query(f"""SELECT set_id, entity_id, round(x_min, 6) AS x_min, round(y_max, 6) AS y_max, round(x_max - x_min, 6) AS width, round(y_max - y_min, 6) AS height, round((x_min + x_max) / 2, 6) AS cx,
      round({_AREA}, 6) AS box_area, round(CASE WHEN len(pts) >= 3 THEN {_SHOELACE} ELSE {_AREA} END, 6) AS area FROM ents WHERE x_min IS NOT NULL""")
def entity_geometry(s, d):
    rows = _entities(s, d).withColumn("b", geometry.bounds(F.col("geometry"))).where("b IS NOT NULL")
    b = F.col("b")
    return rows.select("set_id", "entity_id", _r(b["x_min"]).alias("x_min"), _r(b["y_max"]).alias("y_max"), _r(geometry.width(b)).alias("width"), _r(geometry.height(b)).alias("height"), _r(geometry.center(b)["x"]).alias("cx"), _r(geometry.area(b)).alias("box_area"), _r(geometry.measured_area(F.col("geometry"))).alias("area"))


# --- licences ------------------------------------------------------------------------------------------------------


@_query(f"SELECT data_lane, license_provenance, count(*) AS n, count(*) FILTER (data_lane = 'commercial' AND NOT {_SAFE}) AS n_broken FROM ents GROUP BY ALL")
def license_audit(s, d):
    return licensing.audit(_entities(s, d))


@_query(f"SELECT set_id, entity_id, license_provenance FROM ents WHERE data_lane = 'commercial' AND NOT {_SAFE}")
def license_lane_violations(s, d):
    return licensing.lane_violations(_entities(s, d)).select("set_id", "entity_id", "license_provenance")


@_query(f"""SELECT set_id, bool_and({_SAFE}) AS is_safe, count(*) FILTER (NOT {_SAFE} AND license_provenance IS NOT NULL) AS n_unsafe,
    coalesce(string_agg(DISTINCT license_provenance, ',' ORDER BY license_provenance) FILTER (NOT {_SAFE}), '') AS unsafe FROM ents GROUP BY set_id""")
def license_offenders(s, d):
    return licensing.offenders(_entities(s, d))


@_query("SELECT set_id, count(*) AS n_entities, string_agg(DISTINCT license_provenance, ',' ORDER BY license_provenance) AS licenses FROM ents GROUP BY set_id")
def licenses_present(s, d):
    return licensing.licenses_present(_entities(s, d))


@_query("SELECT set_id, count(*) AS n FROM ents WHERE license_provenance IS DISTINCT FROM 'synthetic-owned' OR data_lane IS DISTINCT FROM 'commercial' GROUP BY set_id")
def license_not_owned(s, d):
    return licensing.not_owned(_entities(s, d)).groupBy("set_id").agg(F.count("*").alias("n"))


# A set is of the lane that all its entities are of.
@_query(f""", lanes AS (SELECT set_id, CASE WHEN mode(data_lane) = 'commercial' THEN 'commercial' ELSE 'research' END AS lane, count(DISTINCT data_lane) AS k FROM ents GROUP BY set_id)
    SELECT set_id, count(*) AS n FROM ents JOIN lanes USING (set_id) WHERE lane = 'commercial' AND k = 1 AND (data_lane <> 'commercial' OR NOT {_SAFE}) GROUP BY set_id""")
def license_set_violations(s, d):
    rows = _entities(s, d)
    lanes = rows.groupBy("set_id").agg(F.max("data_lane").alias("data_lane"), F.min("data_lane").alias("other")).where("data_lane = other")
    return licensing.set_violations(lanes, rows).groupBy("set_id").agg(F.count("*").alias("n"))


# --- questions and requests ----------------------------------------------------------------------------------------


def _answer(name: str, text: str, sql: str) -> None:
    def query(s, d):
        return questions.answer(_rows(s, d), _sheets(s, d), text)

    QUERIES[name], ORACLE[name] = query, _BASE + sql


_SETS = ", every AS (SELECT set_id FROM ents UNION SELECT set_id FROM sheets)"
_COUNT_SQL = """, hits AS (SELECT set_id, count(*) AS present, count(*) FILTER (contains(lower(label), '{word}')) AS n FROM placed WHERE {where} GROUP BY set_id)
    SELECT set_id, NULL::VARCHAR AS value_text, {value} AS value_number, 0::BIGINT AS ord, {note} AS note FROM every LEFT JOIN hits USING (set_id)"""
_ITEM = "NULL::VARCHAR AS note"
_answer("answer_count", "How many receptacles are there?", _SETS + _COUNT_SQL.format(word="receptacle", where=_ANSWERED, value="coalesce(n, 0)", note="NULL::VARCHAR"))
_answer("answer_count_on_sheet", "how many doors on E-404?", _SETS + _COUNT_SQL.format(
    word="door", where=_ANSWERED + " AND lower(sheet_number) = 'e-404'", value="n", note="CASE WHEN present IS NULL THEN 'There is no sheet E-404, or nothing is counted on it.' END"))
_answer("answer_list", "list the panels", f""", by_label AS (SELECT set_id, label, count(*) AS n, min(doc_ord) AS first FROM placed WHERE {_ANSWERED} AND contains(lower(label), 'panel') GROUP BY ALL)
    SELECT set_id, label AS value_text, n AS value_number, row_number() OVER (PARTITION BY set_id ORDER BY n DESC, first) AS ord, {_ITEM} FROM by_label""")
_answer("answer_disciplines", "What disciplines are in this set?", f"SELECT set_id, discipline AS value_text, NULL::BIGINT AS value_number, row_number() OVER (PARTITION BY set_id ORDER BY discipline) AS ord, {_ITEM} FROM (SELECT DISTINCT set_id, discipline FROM sheets WHERE discipline IS NOT NULL)")
_answer("answer_sheets", "list the sheets", f"SELECT set_id, sheet_number AS value_text, NULL::BIGINT AS value_number, sheet_ord AS ord, {_ITEM} FROM sheets")
_answer("answer_sheet_count", "how many sheets", _SETS + f"SELECT set_id, NULL::VARCHAR AS value_text, count(sheet_ord) AS value_number, 0 AS ord, {_ITEM} FROM every LEFT JOIN sheets USING (set_id) GROUP BY set_id")
_answer("answer_unknown", "what is the weather", _SETS + f"SELECT set_id, NULL::VARCHAR AS value_text, NULL::BIGINT AS value_number, 0 AS ord, '{questions.HELP}' AS note FROM every")


@_query(f"SELECT set_id, sheet_number, entity_id FROM placed WHERE {_ANSWERED} AND contains(lower(label), 'receptacle')")
def answer_evidence(s, d):
    return questions.answer_evidence(_rows(s, d), "How many receptacles are there?")


@_query(f""", counted AS (SELECT * FROM placed WHERE {_ANSWERED}),
    ends AS (SELECT DISTINCT set_id, sheet_ord, unnest([source_id, target_id]) AS entity_id FROM conns),
    drafts AS (
      SELECT set_id, sheet_ord, sheet_number, discipline, 'review' AS severity, label, count(*) FILTER (confidence < 0.5) AS n_low, count(*) AS n_total, NULL::VARCHAR AS entity_id, 0 AS part, label AS name, 0 AS at_
      FROM counted GROUP BY set_id, sheet_ord, sheet_number, discipline, label HAVING n_low > 0
      UNION ALL SELECT set_id, sheet_ord, sheet_number, discipline, 'discrepancy', label, NULL::BIGINT, NULL::BIGINT, entity_id, 1, '', doc_ord FROM counted c
      WHERE lower(label) IN ('panelboard', 'consumer unit') AND EXISTS (FROM ends e WHERE e.set_id = c.set_id AND e.sheet_ord = c.sheet_ord)
        AND NOT EXISTS (FROM ends e WHERE e.set_id = c.set_id AND e.sheet_ord = c.sheet_ord AND e.entity_id = c.entity_id))
    SELECT set_id, printf('%03d', row_number() OVER (PARTITION BY set_id ORDER BY sheet_ord, part, name, at_)) AS number, discipline, sheet_number, severity,
      CASE severity WHEN 'review' THEN 'Quantity of ' || label || ' to be confirmed on ' || sheet_number ELSE 'Panel without circuits on ' || sheet_number END AS subject,
      CASE severity WHEN 'review' THEN printf('%d of %d symbols ''%s'' are below a confidence of 50%%: their number and places are to be confirmed.', n_low, n_total, label)
        ELSE 'No run in the drawing ends at this panel: circuits may be missing or not drawn, so the schedule is to be compared with the plan.' END AS body, label, n_low, n_total, entity_id FROM drafts""")
def request_drafts(s, d):
    return questions.requests(_rows(s, d), _connections(s, d))


@_query(f"SELECT set_id, sheet_number, label, entity_id, confidence FROM placed WHERE {_ANSWERED} AND confidence < 0.5")
def request_evidence(s, d):
    return questions.request_evidence(_rows(s, d))


# --- tiles ---------------------------------------------------------------------------------------------------------

_TILED = "tiled AS (SELECT DISTINCT tiling_id::VARCHAR AS sheet_id, full_width AS w, full_height AS h, tile_size AS t, coalesce(overlap, 0) AS o FROM tiled_sheets WHERE full_width > 0 AND full_height > 0 AND tile_size > 0 AND coalesce(overlap, 0) BETWEEN 0 AND tile_size - 1)"


def _tiled(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "tiled_sheets").select(F.col("tiling_id").cast("string").alias("sheet_id"), "full_width", "full_height", "tile_size", F.coalesce("overlap", F.lit(0)).alias("overlap")).distinct()
    return rows.where((F.col("overlap") >= 0) & (F.col("overlap") < F.col("tile_size")))


@_query(f"""WITH {_TILED},
    grid AS (SELECT *, unnest(range(CASE WHEN h <= t THEN 1 ELSE ceil((h - t) / (t - o))::INT + 1 END)) AS row FROM tiled),
    cells AS (SELECT *, unnest(range(CASE WHEN w <= t THEN 1 ELSE ceil((w - t) / (t - o))::INT + 1 END)) AS col FROM grid)
    SELECT sheet_id || ':r' || row || 'c' || col AS tile_id, row, col, col * (t - o) AS px_x, row * (t - o) AS px_y, least(col * (t - o) + t, w) - col * (t - o) AS px_w, least(row * (t - o) + t, h) - row * (t - o) AS px_h,
      round(col * (t - o) / w, 6) AS x_min, round(least(row * (t - o) + t, h) / h, 6) AS y_max FROM cells""", base=False)
def tile_grid(s, d):
    return tiling.tiles(_tiled(s, d)).select("tile_id", "row", "col", "px_x", "px_y", "px_w", "px_h", _r(F.col("region.x_min")).alias("x_min"), _r(F.col("region.y_max")).alias("y_max"))


@_query(f"""WITH {_TILED},
    ys AS (SELECT *, unnest(CASE WHEN w <= t AND h <= t THEN [0] ELSE range(0, h, t - o) END) AS px_y FROM tiled),
    xs AS (SELECT *, unnest(CASE WHEN w <= t AND h <= t THEN [0] ELSE range(0, w, t - o) END) AS px_x FROM ys)
    SELECT sheet_id, px_x, px_y, least(px_x + t, w) - px_x AS px_w, least(px_y + t, h) - px_y AS px_h FROM xs""", base=False)
def tile_grid_plain(s, d):
    return tiling.plain_tiles(_tiled(s, d))


def _assigned(s: SparkSession, d: str) -> DataFrame:
    sizes = _sheets(s, d).select("set_id", "sheet_ord", (F.col("width_pt") * _RASTER).cast("int").alias("full_width"), (F.col("height_pt") * _RASTER).cast("int").alias("full_height"))
    return tiling.assign(tiling.targets_of(_entities(s, d), labels=grounding.LABELS).join(sizes, ["set_id", "sheet_ord"]))


_ASSIGNED = f""", sized AS (SELECT set_id, sheet_ord, (width_pt * {_RASTER})::INT AS w, (height_pt * {_RASTER})::INT AS h FROM sheets),
    targets AS (SELECT *, (x_min + x_max) / 2 * w AS cx, (y_min + y_max) / 2 * h AS cy FROM ents JOIN sized USING (set_id, sheet_ord) WHERE label IN ({_LABELS}) AND x_min IS NOT NULL AND {_AREA} > 0 AND w > 0 AND h > 0),
    cols AS (SELECT *, unnest(range(CASE WHEN w <= 1536 THEN 1 ELSE ceil((w - 1536) / 1344)::INT + 1 END)) AS col FROM targets),
    cells AS (SELECT *, unnest(range(CASE WHEN h <= 1536 THEN 1 ELSE ceil((h - 1536) / 1344)::INT + 1 END)) AS row FROM cols WHERE cx BETWEEN col * 1344 AND least(col * 1344 + 1536, w)),
    assigned AS (SELECT * FROM cells WHERE cy BETWEEN row * 1344 AND least(row * 1344 + 1536, h))
"""


@_query(_ASSIGNED + "SELECT set_id, sheet_ord, row, col, entity_id FROM assigned")
def tile_targets(s, d):
    return _assigned(s, d).select("set_id", "sheet_ord", "row", "col", "entity_id")


@_query(_ASSIGNED + f""", local AS (
      SELECT *, greatest(0, least(1, (x_min * w - col * 1344) / (least(col * 1344 + 1536, w) - col * 1344))) AS x0, greatest(0, least(1, (x_max * w - col * 1344) / (least(col * 1344 + 1536, w) - col * 1344))) AS x1,
        greatest(0, least(1, (y_min * h - row * 1344) / (least(row * 1344 + 1536, h) - row * 1344))) AS y0, greatest(0, least(1, (y_max * h - row * 1344) / (least(row * 1344 + 1536, h) - row * 1344))) AS y1 FROM assigned)
    SELECT set_id, sheet_ord, row, col, entity_id, list_position([{_LABELS}], label) - 1 AS class_index, round((x0 + x1) / 2, 9) AS cx, round((y0 + y1) / 2, 9) AS cy, round(x1 - x0, 9) AS w, round(y1 - y0, 9) AS h
    FROM local WHERE x1 - x0 > 1e-9 AND y1 - y0 > 1e-9""")
def tile_label_lines(s, d):
    rows = tiling.label_lines(_assigned(s, d)).where("w > 1e-9 AND h > 1e-9")
    return rows.select("set_id", "sheet_ord", "row", "col", "entity_id", "class_index", *[_r(c, 9) for c in ("cx", "cy", "w", "h")])


# Detections of a label and sheet, best first: each joins the first one kept that it overlaps, or is kept itself.
_SUPPRESSED = _ASSIGNED + """, seen AS (SELECT set_id || ':' || sheet_ord AS sheet_id, label, doc_ord AS ord, confidence AS conf, set_id || ':' || sheet_ord || '/' || row || '/' || col AS tile_id, x_min AS x0, y_min AS y0, x_max AS x1, y_max AS y1 FROM assigned),
    queued AS (SELECT *, row_number() OVER (PARTITION BY sheet_id, label ORDER BY conf DESC, ord, tile_id) AS k FROM seen),
    folded AS (
      SELECT sheet_id, label, k, [{'k': k, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'tiles': [tile_id]}] AS kept FROM queued WHERE k = 1
      UNION ALL SELECT sheet_id, label, k, CASE WHEN coalesce(hit, 0) = 0 THEN list_append(kept, {'k': k, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'tiles': [tile_id]})
        ELSE list_transform(kept, lambda c, j: CASE WHEN j = hit AND NOT list_contains(c.tiles, tile_id) THEN {'k': c.k, 'x0': c.x0, 'y0': c.y0, 'x1': c.x1, 'y1': c.y1, 'tiles': list_append(c.tiles, tile_id)} ELSE c END) END
      FROM (SELECT q.*, f.kept, list_position(list_transform(f.kept, lambda c: greatest(least(c.x1, q.x1) - greatest(c.x0, q.x0), 0) * greatest(least(c.y1, q.y1) - greatest(c.y0, q.y0), 0)
          >= 0.5::DOUBLE * ((c.x1 - c.x0) * (c.y1 - c.y0) + (q.x1 - q.x0) * (q.y1 - q.y0) - greatest(least(c.x1, q.x1) - greatest(c.x0, q.x0), 0) * greatest(least(c.y1, q.y1) - greatest(c.y0, q.y0), 0))), true) AS hit
        FROM folded f JOIN queued q ON q.sheet_id = f.sheet_id AND q.label = f.label AND q.k = f.k + 1)),
    ended AS (SELECT sheet_id, label, unnest(arg_max(kept, k)) AS c FROM folded GROUP BY sheet_id, label)
    SELECT q.sheet_id, q.label, ord, conf, round(q.x0, 6) AS x_min, round(q.y0, 6) AS y_min, round(q.x1, 6) AS x_max, round(q.y1, 6) AS y_max, array_to_string(c.tiles, ',') AS tiles
    FROM ended e JOIN queued q ON q.sheet_id = e.sheet_id AND q.label = e.label AND q.k = e.c.k"""


@_query(_SUPPRESSED)
def tile_detections(s, d):
    """Symbols as a detector would report them tile by tile, composed and without their repeats."""
    a = _assigned(s, d)
    sheet = F.concat_ws(":", "set_id", F.col("sheet_ord").cast("string"))
    tiles_ = a.select(F.concat_ws("/", sheet, "row", "col").alias("tile_id"), sheet.alias("sheet_id"), "region").distinct()
    found = a.select(F.concat_ws("/", sheet, "row", "col").alias("tile_id"), "label", geometry.to_tile(F.col("region"), F.col("box")).alias("bbox"), F.col("confidence").alias("score"), F.col("doc_ord").alias("ord"))
    out = tiling.sheet_detections(found, tiles_)
    return out.select("sheet_id", "label", "ord", "conf", *[_r(c) for c in ("x_min", "y_min", "x_max", "y_max")], F.array_join("tiles", ",").alias("tiles"))


# --- graphs --------------------------------------------------------------------------------------------------------

_PAIRS = f""", nodes AS (SELECT set_id, sheet_ord, view_ord, entity_ord, entity_id, label, (x_min + x_max) / 2 AS x, (y_min + y_max) / 2 AS y FROM ents WHERE label IN ({_LABELS}) AND x_min IS NOT NULL),
    ranked AS (
      SELECT a.set_id, a.sheet_ord, a.view_ord, a.entity_ord AS i, b.entity_ord AS j,
        row_number() OVER (PARTITION BY a.set_id, a.sheet_ord, a.view_ord, a.entity_ord ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.entity_ord) AS k, a.label = 'Panelboard' AS panel
      FROM nodes a JOIN nodes b USING (set_id, sheet_ord, view_ord) WHERE a.entity_ord <> b.entity_ord),
    keys AS (SELECT DISTINCT set_id, sheet_ord, view_ord, least(i, j) AS i, greatest(i, j) AS j FROM ranked WHERE k <= 8 OR panel),
    pairs AS (
      SELECT set_id, sheet_ord, view_ord, a.entity_id AS entity_id_1, b.entity_id AS entity_id_2, a.label AS label_1, b.label AS label_2, a.x AS x_1, a.y AS y_1, b.x AS x_2, b.y AS y_2
      FROM keys k JOIN nodes a USING (set_id, sheet_ord, view_ord) JOIN nodes b USING (set_id, sheet_ord, view_ord) WHERE a.entity_ord = i AND b.entity_ord = j)
"""


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return graph.candidates(graph.nodes(_entities(s, d)))


@_query(_PAIRS + "SELECT set_id, sheet_ord, view_ord, entity_id_1, entity_id_2 FROM pairs")
def graph_candidates(s, d):
    return _pairs(s, d).select(*graph.VIEW, "entity_id_1", "entity_id_2")


@_query(_PAIRS + f""", ordered AS (SELECT *, (x_2 < x_1) OR (x_2 = x_1 AND y_2 < y_1) AS swap FROM pairs)
    SELECT set_id, entity_id_1, entity_id_2, round(abs(x_2 - x_1), 6) AS dx, round(CASE WHEN swap THEN y_1 - y_2 ELSE y_2 - y_1 END, 6) AS dy,
      list_position([{_LABELS}], CASE WHEN swap THEN label_2 ELSE label_1 END) - 1 AS left_class, list_position([{_LABELS}], CASE WHEN swap THEN label_1 ELSE label_2 END) - 1 AS right_class, 23 AS n FROM ordered""")
def graph_features(s, d):
    f = F.col("features")
    at = lambda a, b: (F.array_position(F.slice(f, a, b), 1.0) - 1)
    return graph.pair_features(_pairs(s, d)).select("set_id", "entity_id_1", "entity_id_2", _r(f[0]).alias("dx"), _r(f[1]).alias("dy"), at(4, 10).alias("left_class"), at(14, 10).alias("right_class"), F.size(f).alias("n"))


_LABELLED = _PAIRS + """, edges AS (
      SELECT set_id, sheet_ord, view_ord, least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, arg_max(connection_type, conn_ord) AS edge_type
      FROM conns WHERE connection_type IN ('conductor', 'home_run', 'switch_leg') GROUP BY ALL),
    labelled AS (SELECT p.*, coalesce(e.edge_type, 'none') AS edge_type FROM pairs p LEFT JOIN edges e ON e.set_id = p.set_id AND e.sheet_ord = p.sheet_ord AND e.view_ord = p.view_ord
      AND e.a = least(entity_id_1, entity_id_2) AND e.b = greatest(entity_id_1, entity_id_2))
"""


def _labelled(s: SparkSession, d: str) -> DataFrame:
    return graph.labelled(_pairs(s, d), _connections(s, d))


@_query(_LABELLED + """SELECT set_id, edge_type, entity_id_1, entity_id_2,
      CASE WHEN CASE edge_type WHEN 'home_run' THEN label_2 = 'Panelboard' WHEN 'switch_leg' THEN label_1 IN ('Single-Pole Switch', 'Three-Way Switch') ELSE (x_1 < x_2) OR (x_1 = x_2 AND y_1 <= y_2) END
        THEN entity_id_1 ELSE entity_id_2 END AS source_id FROM labelled""")
def graph_labelled(s, d):
    return _labelled(s, d).withColumns(graph.oriented(F.col("edge_type"))).select("set_id", "edge_type", "entity_id_1", "entity_id_2", "source_id")


@_query(_LABELLED + """SELECT t.edge_type, round((SELECT count(*) FROM labelled) / greatest(count(l.edge_type), 1), 6) AS weight
    FROM (VALUES ('none'), ('conductor'), ('home_run'), ('switch_leg')) t(edge_type) LEFT JOIN labelled l USING (edge_type) GROUP BY t.edge_type""")
def graph_class_weights(s, d):
    return graph.class_weights(_labelled(s, d)).select("edge_type", _r("weight"))


# --- few-shot ------------------------------------------------------------------------------------------------------


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").alias("vector"), F.col("vec_id").alias("ord"))


_UNIT = "units AS (SELECT vec_id, label::VARCHAR AS label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings)"
_PROTOS = f"""WITH {_UNIT},
    means AS (SELECT label, k, avg(u[k]) AS x, min(vec_id) AS ord FROM (SELECT *, unnest(range(1, len(u) + 1)) AS k FROM units) GROUP BY ALL),
    sums AS (SELECT label, list(x ORDER BY k) AS m, min(ord) AS ord FROM means GROUP BY label),
    protos AS (SELECT label, ord, list_transform(m, lambda x: x / sqrt(list_sum(list_transform(m, lambda y: y * y)))) AS p FROM sums)
"""


@_query(_PROTOS + "SELECT label, k AS dimension, round(p[k], 6) AS x FROM (SELECT *, unnest(range(1, len(p) + 1)) AS k FROM protos)", base=False)
def fewshot_prototypes(s, d):
    return fewshot.prototypes(_vectors(s, d)).select("label", F.posexplode("prototype").alias("k", "x")).select("label", (F.col("k") + 1).alias("dimension"), _r("x"))


@_query(_PROTOS + """, sims AS (SELECT vec_id, protos.label, ord, list_sum(list_transform(range(1, len(u) + 1), lambda k: u[k] * p[k])) AS s FROM units CROSS JOIN protos)
    SELECT vec_id, CASE WHEN max(s) >= 0.55 THEN arg_max(label, s) END AS label, round(max(s), 6) AS similarity FROM sims GROUP BY vec_id""", base=False)
def fewshot_classify(s, d):
    rows = _vectors(s, d)
    return fewshot.classify(rows, fewshot.prototypes(rows)).select("vec_id", "label", _r("similarity"))


# --- boards --------------------------------------------------------------------------------------------------------


def _seeds(s: SparkSession, d: str) -> DataFrame:
    return _entities(s, d).groupBy("label", "produced_by", "model_version").agg(F.avg("confidence").alias("value")).where("produced_by IS NOT NULL AND model_version IS NOT NULL AND label IS NOT NULL")


_SEEDS = ", seeds AS (SELECT label, produced_by, model_version, avg(confidence) AS value FROM ents WHERE produced_by IS NOT NULL AND model_version IS NOT NULL AND label IS NOT NULL GROUP BY ALL)"


@_query(_SEEDS + f"""SELECT label, produced_by, round(avg(value), 9) AS mean, round(coalesce(stddev_samp(value), 0), 9) AS std, count(*) AS n,
      round(CASE WHEN count(*) > 1 THEN [{", ".join(map(str, fixed.T95))}][count(*) - 1] * stddev_samp(value) / sqrt(count(*)) ELSE 0 END, 9) AS ci95 FROM seeds GROUP BY label, produced_by""")
def board_seeds(s, d):
    return boards.over_seeds(_seeds(s, d), ["label", "produced_by"]).select("label", "produced_by", _r("mean", 9), _r("std", 9), "n", _r("ci95", 9))


@_query(_SEEDS + ", board AS (SELECT label AS drawing_type, produced_by AS model, round(avg(value), 6) AS value FROM seeds GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY drawing_type ORDER BY value DESC, model) AS rank FROM board")
def board_ranked(s, d):
    rows = boards.over_seeds(_seeds(s, d), ["label", "produced_by"]).select(F.lit("detection_map").alias("metric"), F.col("label").alias("drawing_type"), F.col("produced_by").alias("model"), F.round("mean", 6).alias("value"), F.col("produced_by").alias("ord"))
    return boards.ranked(rows).select("drawing_type", "model", "value", "rank")


@_query("SELECT set_id, CASE WHEN ('0x' || substr(sha1('7:' || set_id), 1, 15))::UBIGINT / 1152921504606846976.0 < 0.2 THEN 'val' ELSE 'train' END AS split FROM (SELECT DISTINCT set_id FROM entities WHERE set_id IS NOT NULL)", base=False)
def split_by_hash(s, d):
    names = table(s, d, "entities").select("set_id").where("set_id IS NOT NULL").distinct()
    return boards.hash_split(names, F.col("set_id"), val_fraction=0.2, seed=7)


_EXPECTED = f""", expected AS (SELECT set_id, label, count(DISTINCT entity_id) AS n FROM (SELECT set_id, label, lower(regexp_replace(entity_id, '[\\s\\-]', '', 'g')) AS entity_id FROM evidence) WHERE label IS NOT NULL GROUP BY ALL),
    actual AS (SELECT set_id, {_KEY} AS label, count(*) AS n FROM ents GROUP BY ALL)
"""


@_query(_EXPECTED + """SELECT set_id, 'missing_sheet' AS code, NULL AS label, NULL::BIGINT AS expected, NULL::BIGINT AS got FROM (SELECT DISTINCT set_id FROM expected) WHERE set_id NOT IN (SELECT set_id FROM actual)
    UNION ALL SELECT e.set_id, 'entity_count', e.label, e.n, coalesce(a.n, 0) FROM expected e LEFT JOIN actual a ON a.set_id = e.set_id AND a.label = e.label WHERE e.set_id IN (SELECT set_id FROM actual) AND coalesce(a.n, 0) <> e.n
    UNION ALL SELECT set_id, 'entity_total', NULL, w, h FROM (SELECT set_id, sum(n)::BIGINT AS w FROM expected GROUP BY 1) JOIN (SELECT set_id, sum(n)::BIGINT AS h FROM actual GROUP BY 1) USING (set_id) WHERE w <> h""")
def validate_counts(s, d):
    """Entities there against the ones that evidence speaks of, for each set as a whole."""
    whole = F.lit("all").alias("sheet_number")
    cited = table(s, d, "evidence").where("label IS NOT NULL").select("set_id", "label", F.lower(F.regexp_replace("entity_id", r"[\s\-]", "")).alias("e")).distinct()
    expected = cited.groupBy("set_id", whole, "label").agg(F.count("e").alias("n"))
    label = grounding.matched_label(F.col("label"), F.col("ifc_class"), F.col("entity_type"))
    actual = _entities(s, d).groupBy("set_id", whole, label.alias("label")).agg(F.count("*").alias("n"))
    return boards.count_issues(expected, actual).drop("sheet_number")


@_query(f""", cited AS (SELECT DISTINCT set_id, label, (bbox.x_min + bbox.x_max) / 2 AS x, (bbox.y_min + bbox.y_max) / 2 AS y FROM evidence WHERE label IS NOT NULL AND bbox IS NOT NULL)
    SELECT set_id, label, count(*) AS n FROM cited c WHERE NOT EXISTS (FROM ents e WHERE e.set_id = c.set_id AND {_KEY.replace("label", "e.label")} = c.label AND abs((x_min + x_max) / 2 - x) <= 0.001 AND abs((y_min + y_max) / 2 - y) <= 0.001) GROUP BY ALL""")
def validate_placements(s, d):
    whole = F.lit("all").alias("sheet_number")
    c = geometry.center(F.col("bbox"))
    expected = table(s, d, "evidence").where("label IS NOT NULL AND bbox IS NOT NULL").select("set_id", whole, "label", c["x"].alias("x"), c["y"].alias("y")).distinct()
    label = grounding.matched_label(F.col("label"), F.col("ifc_class"), F.col("entity_type"))
    have = _entities(s, d).select("set_id", whole, label.alias("label"), "geometry")
    return boards.placement_issues(expected, have, tolerance=0.001).groupBy("set_id", "label").agg(F.count("*").alias("n"))


# --- metrics -------------------------------------------------------------------------------------------------------


def _judged(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Predictions are the surer entities, moved by a part of their confidence; the truth is all entities as they are."""
    columns = ("set_id", "doc_ord", "entity_id", "entity_type", "label", "ifc_class", "geometry", "text_spans", "dimensions", "confidence", "attributes")
    rows = cut(_entities(s, d).select(*columns))  # both sides are read from it, more than once
    true = metrics.judged(rows)
    by = (F.col("confidence") - 0.5) / 50
    points = F.transform("geometry.points", lambda p: F.struct((p["x"] + by).alias("x"), (p["y"] + by).alias("y")))
    pred = rows.where("confidence >= 0.3").withColumn("geometry", F.col("geometry").withField("points", points))
    return metrics.judged(pred), true


def _metric(name: str, sql: str | None = None) -> None:
    def query(s, d):
        if name == "graph_edge_ap":
            pred, true = _judged(s, d)
            edges = _connections(s, d).select(F.col("set_id").alias("doc"), "source_id", "target_id", "directed", F.col("confidence").alias("conf"), F.conv(F.substring(F.md5("conn_id"), 1, 15), 16, 10).cast("long").alias("ord"))
            return metrics.graph_edge_ap(pred, edges, true, edges).select(_r("value"))
        return metrics.METRICS[name](*_judged(s, d)).select(_r("value"))

    QUERIES[f"metric_{name}"] = query
    if sql:
        ORACLE[f"metric_{name}"] = _BASE + sql


_COUNTS = f""", t AS (SELECT set_id, {_KEY} AS label, count(*) AS n FROM ents GROUP BY ALL), p AS (SELECT set_id, {_KEY} AS label, count(*) AS m FROM ents WHERE confidence >= 0.3 GROUP BY ALL)
    , counted AS (SELECT n, coalesce(m, 0) AS m FROM t LEFT JOIN p USING (set_id, label))"""
_PAIRED = f""", true_ AS (SELECT set_id, doc_ord, entity_id, {_KEY} AS label, confidence AS conf, x_min AS x0, y_min AS y0, x_max AS x1, y_max AS y1 FROM ents WHERE x_min IS NOT NULL AND {_AREA} > 0),
    shifted AS (SELECT *, list_transform(pts, lambda p: p.x + (confidence - 0.5) / 50) AS xs, list_transform(pts, lambda p: p.y + (confidence - 0.5) / 50) AS ys, abs(geometry.radius) AS r FROM ents WHERE confidence >= 0.3 AND len(pts) > 0),
    pred_ AS (
      SELECT * FROM (SELECT set_id, doc_ord, entity_id, {_KEY} AS label, confidence AS conf, CASE WHEN is_round THEN xs[1] - r ELSE list_min(xs) END AS x0, CASE WHEN is_round THEN ys[1] - r ELSE list_min(ys) END AS y0,
        CASE WHEN is_round THEN xs[1] + r ELSE list_max(xs) END AS x1, CASE WHEN is_round THEN ys[1] + r ELSE list_max(ys) END AS y1 FROM shifted) WHERE greatest(x1 - x0, 0) * greatest(y1 - y0, 0) > 0),
    met AS (
      SELECT set_id, label, p.doc_ord AS l, t.doc_ord AS r, p.conf, greatest(least(p.x1, t.x1) - greatest(p.x0, t.x0), 0) * greatest(least(p.y1, t.y1) - greatest(p.y0, t.y0), 0) AS i,
        (p.x1 - p.x0) * (p.y1 - p.y0) + (t.x1 - t.x0) * (t.y1 - t.y0) AS a FROM pred_ p JOIN true_ t USING (set_id, label)),
    pairs AS (SELECT *, i / (a - i) AS iou FROM met WHERE i / (a - i) >= 0.5)
"""


def _greedy(order: str, latest: bool = False) -> str:
    """SQL of matching in order: each prediction takes the free true box it overlaps most."""
    return f""", options AS (SELECT set_id, label, l, row_number() OVER (PARTITION BY set_id, label ORDER BY {order}) AS k, list({{'r': r, 'iou': iou}} ORDER BY iou DESC, r {'DESC' if latest else 'ASC'}) AS o FROM pairs GROUP BY set_id, label, l, conf),
    walked AS (
      SELECT set_id, label, 0::BIGINT AS k, NULL::BIGINT AS l, NULL::BIGINT AS r, NULL::DOUBLE AS iou, []::BIGINT[] AS used FROM (SELECT DISTINCT set_id, label FROM options)
      UNION ALL SELECT set_id, label, k, l, c.r, c.iou, CASE WHEN c.r IS NULL THEN used ELSE list_append(used, c.r) END
      FROM (SELECT w.set_id, w.label, n.k, n.l, w.used, list_filter(n.o, lambda x: NOT list_contains(w.used, x.r))[1] AS c FROM walked w JOIN options n ON n.set_id = w.set_id AND n.label = w.label AND n.k = w.k + 1)),
    matches AS (SELECT * FROM walked WHERE r IS NOT NULL)
"""


_AP = """, ranked AS (SELECT *, row_number() OVER w AS n, sum(hit) OVER w AS h FROM scored WINDOW w AS (PARTITION BY label ORDER BY conf DESC, doc, ord)),
    enveloped AS (SELECT *, max(h / n) OVER (PARTITION BY label ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM ranked),
    aps AS (SELECT label, coalesce(sum(env) FILTER (hit = 1), 0) / any_value(n_true) AS ap FROM totals LEFT JOIN enveloped USING (label) GROUP BY label)
    SELECT round(coalesce(avg(ap), 0), 6) AS value FROM aps"""
_MAP = _PAIRED + _greedy("conf DESC, l") + """, scored AS (SELECT label, set_id AS doc, p.doc_ord AS ord, p.conf, (m.l IS NOT NULL)::INT AS hit FROM pred_ p LEFT JOIN matches m USING (set_id, label) WHERE m.l IS NULL OR m.l = p.doc_ord),
    totals AS (SELECT label, count(*) AS n_true FROM true_ GROUP BY label)""".replace(
    "FROM pred_ p LEFT JOIN matches m USING (set_id, label) WHERE m.l IS NULL OR m.l = p.doc_ord", "FROM pred_ p LEFT JOIN (SELECT set_id, label, l, l AS doc_ord FROM matches) m USING (set_id, label, doc_ord)").replace("p.doc_ord AS ord", "doc_ord AS ord") + _AP
_metric("detection_map", _MAP)
_metric("counting_mape", _COUNTS + "SELECT round(avg(abs(m - n) / n) * 100, 6) AS value FROM counted")
_metric("counting_exact_match", _COUNTS + "SELECT round(avg((m = n)::INT), 6) AS value FROM counted")
_metric("ocr_exact_match", r""", spans AS (SELECT set_id, confidence, regexp_replace(trim(lower(s.text)), '\s+', ' ', 'g') AS t FROM (SELECT set_id, confidence, unnest(text_spans) AS s FROM ents)),
    c AS (SELECT set_id, t, count(*) AS n, count(*) FILTER (confidence >= 0.3) AS m FROM spans GROUP BY ALL) SELECT round(sum(least(n, m)) / sum(n), 6) AS value FROM c""")
_metric("dimension_accuracy", """, spans AS (SELECT set_id, doc_ord, confidence, unnest(range(1, len(dimensions) + 1)) AS k, dimensions FROM ents),
    sizes AS (SELECT set_id, doc_ord * 1000 + k AS ord, confidence, dimensions[k].value_mm AS v FROM spans WHERE dimensions[k].value_mm IS NOT NULL),
    options AS (SELECT t.set_id, t.ord, row_number() OVER (PARTITION BY t.set_id ORDER BY t.ord) AS k, list(p.ord ORDER BY p.ord) AS o FROM sizes t JOIN sizes p ON p.set_id = t.set_id AND p.confidence >= 0.3 AND abs(p.v - t.v) <= 1 GROUP BY t.set_id, t.ord),
    walked AS (
      SELECT set_id, 0::BIGINT AS k, []::BIGINT[] AS used FROM (SELECT DISTINCT set_id FROM options)
      UNION ALL SELECT set_id, k, CASE WHEN c IS NULL THEN used ELSE list_append(used, c) END
      FROM (SELECT w.set_id, n.k, w.used, list_filter(n.o, lambda x: NOT list_contains(w.used, x))[1] AS c FROM walked w JOIN options n ON n.set_id = w.set_id AND n.k = w.k + 1))
    SELECT round((SELECT sum(n) FROM (SELECT max(len(used)) AS n FROM walked GROUP BY set_id)) / (SELECT count(*) FROM sizes), 6) AS value""")
_metric("panoptic_quality", _PAIRED + _greedy("l") + "SELECT round((SELECT sum(iou) FROM matches) / (((SELECT count(*) FROM pred_) + (SELECT count(*) FROM true_)) / 2), 6) AS value")
_metric("external_wall_iou", f""", walls AS (SELECT set_id, confidence, row_number() OVER () AS polygon, pts FROM ents WHERE geometry.type = 'polygon' AND (entity_type = 'wall' OR regexp_matches(lower({_KEY}), 'wall|room'))),
    both_ AS (SELECT set_id, polygon, 't' AS side, pts, 0::DOUBLE AS by_ FROM walls UNION ALL SELECT set_id, polygon, 'p', pts, (confidence - 0.5) / 50 FROM walls WHERE confidence >= 0.3),
    sides AS (SELECT *, (pts[k].x + by_) * 256 AS x1, (pts[k].y + by_) * 256 AS y1, (pts[k % len(pts) + 1].x + by_) * 256 AS x2, (pts[k % len(pts) + 1].y + by_) * 256 AS y2 FROM (SELECT *, unnest(range(1, len(pts) + 1)) AS k FROM both_ WHERE len(pts) >= 3)),
    crossed AS (SELECT *, unnest(range(greatest(ceil(least(y1, y2) - 0.5), 0)::BIGINT, least(ceil(greatest(y1, y2) - 0.5), 256)::BIGINT)) AS y FROM sides),
    places AS (SELECT set_id, side, polygon, y, list_sort(list(x1 + (y + 0.5 - y1) * (x2 - x1) / (y2 - y1))) AS xs FROM crossed GROUP BY ALL),
    spans AS (SELECT set_id, side, y, greatest(ceil(xs[2 * j - 1] - 0.5), 0)::BIGINT AS a, least(floor(xs[2 * j] - 0.5), 255)::BIGINT AS b FROM (SELECT *, unnest(range(1, len(xs) // 2 + 1)) AS j FROM places)),
    pixels AS (SELECT DISTINCT set_id, side, y, x FROM (SELECT set_id, side, y, unnest(range(a, b + 1)) AS x FROM spans)),
    counted AS (SELECT set_id, count(*) FILTER (n = 2) AS i, count(*) AS u FROM (SELECT set_id, y, x, count(*) AS n FROM pixels GROUP BY ALL) GROUP BY set_id)
    SELECT round(avg(coalesce(i / u, 0)), 6) AS value FROM (SELECT DISTINCT set_id FROM walls) LEFT JOIN counted USING (set_id)""")
_metric("chamfer_distance", """, pts_t AS (SELECT set_id, doc_ord, confidence, unnest(pts) AS q FROM ents WHERE geometry.type IN ('polyline', 'polygon')),
    pts_p AS (SELECT set_id, q.x + (confidence - 0.5) / 50 AS x, q.y + (confidence - 0.5) / 50 AS y FROM pts_t WHERE confidence >= 0.3),
    pairs AS (SELECT p.set_id, p.rowid_ AS a, t.rowid_ AS b, sqrt((p.x - t.q.x) * (p.x - t.q.x) + (p.y - t.q.y) * (p.y - t.q.y)) AS d
      FROM (SELECT *, row_number() OVER () AS rowid_ FROM pts_p) p JOIN (SELECT *, row_number() OVER () AS rowid_ FROM pts_t) t ON p.set_id = t.set_id),
    one AS (SELECT set_id, avg(d) AS d FROM (SELECT set_id, a, min(d) AS d FROM pairs GROUP BY ALL) GROUP BY set_id),
    two AS (SELECT set_id, avg(d) AS e FROM (SELECT set_id, b, min(d) AS d FROM pairs GROUP BY ALL) GROUP BY set_id)
    SELECT round(avg(d + e), 6) AS value FROM one JOIN two USING (set_id)""")
_metric("loop_closure_validity", f"SELECT round(avg((len(pts) >= 3 AND {_SHOELACE} > 1e-9)::INT), 6) AS value FROM ents WHERE confidence >= 0.3 AND geometry.type = 'polygon'")
_metric("graph_node_ap", _MAP)
_metric("graph_edge_ap", _PAIRED + _greedy("conf DESC, l", latest=True) + """, names AS (SELECT m.set_id, p.entity_id AS pred_id, t.entity_id AS true_id FROM matches m JOIN pred_ p ON p.set_id = m.set_id AND p.label = m.label AND p.doc_ord = m.l JOIN true_ t ON t.set_id = m.set_id AND t.label = m.label AND t.doc_ord = m.r),
    mapped AS (SELECT c.set_id AS doc, ('0x' || substr(md5(conn_id), 1, 15))::BIGINT AS ord, coalesce(c.confidence, 1) AS conf, a.true_id AS s, b.true_id AS t FROM conns c LEFT JOIN names a ON a.set_id = c.set_id AND a.pred_id = c.source_id LEFT JOIN names b ON b.set_id = c.set_id AND b.pred_id = c.target_id),
    known AS (SELECT set_id AS doc, least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, bool_or(coalesce(directed, true) AND source_id <= target_id) AS d0, bool_or(coalesce(directed, true) AND source_id > target_id) AS d1, bool_or(NOT coalesce(directed, true)) AS u FROM conns GROUP BY ALL),
    tried AS (SELECT m.*, least(s, t) AS a, greatest(s, t) AS b, s > t AS way, CASE WHEN s > t THEN coalesce(d1, false) ELSE coalesce(d0, false) END AS straight, coalesce(u, false) AS u FROM mapped m LEFT JOIN known k ON k.doc = m.doc AND k.a = least(s, t) AND k.b = greatest(s, t)),
    first AS (SELECT *, straight AND s IS NOT NULL AND t IS NOT NULL AND row_number() OVER (PARTITION BY doc, a, b, way, straight, s IS NULL OR t IS NULL ORDER BY ord) = 1 AS taken FROM tried),
    scored AS (SELECT 'edge' AS label, doc, ord, conf, (taken OR (u AND s IS NOT NULL AND t IS NOT NULL AND row_number() OVER (PARTITION BY doc, a, b, taken, s IS NULL OR t IS NULL ORDER BY ord) = 1))::INT AS hit FROM first),
    totals AS (SELECT 'edge' AS label, count(*) AS n_true FROM (SELECT DISTINCT set_id, CASE WHEN coalesce(directed, true) THEN [source_id, target_id, 'd'] ELSE [least(source_id, target_id), greatest(source_id, target_id), 'u'] END FROM conns))""" + _AP)


@_query(f"SELECT set_id, {_KEY} AS label, count(*) AS n FROM ents WHERE x_min IS NOT NULL AND {_AREA} > 0 GROUP BY ALL")
def detections_per_label(s, d):
    return metrics.detections(metrics.judged(_entities(s, d))).groupBy(F.col("doc").alias("set_id"), "label").agg(F.count("*").alias("n"))
