"""Queries over generated models and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.common import table
from quillspan.operators import generator, grounding
from quillspan.operators.drawing import current
from quillspan.operators.graph import nodes
from quillspan.plans import drawings
from quillspan.streaming.arrivals import event_windows


def _devices(s: SparkSession, d: str) -> DataFrame:
    """The symbols of each sheet taken as the devices of a model."""
    rows = nodes(current(table(s, d, "entities"), "set_id", "entity_id"))
    return rows.select(F.concat_ws(":", "set_id", F.col("sheet_ord").cast("string")).alias("model_id"), F.col("entity_id").alias("device_id"), "label", "x", "y")


def circuit_packing(s: SparkSession, d: str) -> DataFrame:
    return generator.circuits(_devices(s, d))


def circuit_loads(s: SparkSession, d: str) -> DataFrame:
    devices = _devices(s, d)
    return generator.circuit_loads(devices, generator.circuits(devices))


def circuit_edges(s: SparkSession, d: str) -> DataFrame:
    return generator.edges(generator.circuits(_devices(s, d)))


def model_expected(s: SparkSession, d: str) -> DataFrame:
    devices = _devices(s, d)
    return generator.expected(devices, generator.circuits(devices))


def model_questions(s: SparkSession, d: str) -> DataFrame:
    devices = _devices(s, d)
    return generator.template_questions(devices, generator.circuits(devices))


def window_events(s: SparkSession, d: str) -> DataFrame:
    rows = event_windows(table(s, d, "events"))
    return rows.select("start", "event_type", "n", F.round("total", 2).alias("total"))


QUERIES = {f.__name__: f for f in (circuit_packing, circuit_loads, circuit_edges, model_expected, model_questions, window_events)}
# Devices of each sheet, and circuits filled one device after the other.
_CIRCUITS = f"""{drawings._BASE}, devices AS (SELECT set_id || ':' || sheet_ord AS model_id, entity_id AS device_id, label, (x_min + x_max) / 2 AS x, (y_min + y_max) / 2 AS y FROM ents WHERE label IN ({drawings._LABELS}) AND x_min IS NOT NULL AND set_id IS NOT NULL),
    loads(label, pool, va) AS (VALUES {", ".join(f"('{label}', {'0' if label in generator.RECEPTACLES else '1' if label in generator.LIGHTS else 'NULL'}, {va or 0})" for label, va in [(c[0], c[4]) for c in grounding.DETECTOR_CLASSES])}),
    ordered AS (SELECT model_id, device_id, pool, va, row_number() OVER (PARTITION BY model_id ORDER BY pool, x, y, device_id) AS k FROM devices JOIN loads USING (label) WHERE pool IS NOT NULL),
    placed_ AS (
      SELECT model_id, device_id, pool, va AS load, k, 1 AS number, 0 AS position FROM ordered WHERE k = 1
      UNION ALL SELECT o.model_id, o.device_id, o.pool, CASE WHEN fresh THEN va ELSE load + va END, o.k, number + fresh::INT, CASE WHEN fresh THEN 0 ELSE position + 1 END
      FROM (SELECT p.model_id, p.load, p.number, p.position, o, o.pool <> p.pool OR p.load + o.va > {generator.BUDGET_VA} OR p.position + 1 >= {generator.MOST_DEVICES} AS fresh, o.va AS va FROM placed_ p JOIN ordered o ON o.model_id = p.model_id AND o.k = p.k + 1)),
    circuits AS (SELECT model_id, device_id, number, position, CASE number % 2 WHEN 1 THEN 'A' ELSE 'B' END AS phase FROM placed_),
    runs AS (SELECT model_id, number, device_id AS source_id, lead(device_id) OVER (PARTITION BY model_id, number ORDER BY position) AS target_id FROM circuits),
    panels AS (SELECT model_id, max(number)::BIGINT AS n FROM circuits GROUP BY model_id)
"""
_ASK = "SELECT model_id, model_id || '-q-' || {name} AS q_id, {question} AS question, {n}::VARCHAR AS answer FROM "
ORACLE = {
    "circuit_packing": _CIRCUITS + "SELECT * FROM circuits",
    "circuit_loads": _CIRCUITS + "SELECT model_id, number, phase, sum(va)::BIGINT AS load_va, count(*) AS n_devices FROM circuits JOIN ordered USING (model_id, device_id) GROUP BY ALL",
    "circuit_edges": _CIRCUITS + "SELECT model_id, number, CASE WHEN target_id IS NULL THEN 'home_run' ELSE 'conductor' END AS connection_type, source_id, target_id FROM runs",
    "model_expected": _CIRCUITS + """SELECT model_id, 'plan' AS sheet, 'entity' AS kind, label, count(*) AS n FROM devices GROUP BY model_id, label
        UNION ALL SELECT DISTINCT model_id, s, 'entity', 'Panelboard', 1 FROM devices, (VALUES ('plan'), ('single_line')) v(s)
        UNION ALL SELECT model_id, 'plan', 'edge', CASE WHEN target_id IS NULL THEN 'home_run' ELSE 'conductor' END, count(*) FROM runs GROUP BY ALL
        UNION ALL SELECT model_id, s, k, l, n FROM panels, (VALUES ('schedule', 'entity', 'circuit_row'), ('single_line', 'entity', 'circuit'), ('single_line', 'edge', 'feeder')) v(s, k, l)""",
    "model_questions": _CIRCUITS + _ASK.format(name="'circuits'", question="'How many branch circuits does the panel have?'", n="n") + "panels UNION ALL "
        + _ASK.format(name="'receptacles'", question="'How many receptacles are on the plan?'", n=f"count(*) FILTER (label IN ({', '.join(repr(x) for x in generator.RECEPTACLES)}))") + "devices GROUP BY model_id UNION ALL "
        + _ASK.format(name="'count-' || lower(replace(label, ' ', '_'))", question="'How many symbols of ' || label || ' are on the plan?'", n="count(*)") + "devices GROUP BY model_id, label",
    "window_events": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
}
