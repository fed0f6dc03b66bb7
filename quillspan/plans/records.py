"""Queries over records as received: flat tables of nested payloads, and orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspan.common import table
from quillspan.operators.nested import flat_table, flatten, positions, unreadable
from quillspan.operators.orphans import References, orphan_counts, orphans

_COLUMNS = {
    "set": ["schema_version", "id", "name", "source", "metadata", "license_provenance", "data_lane"],
    "sheet": ["id", "sheet_number", "discipline", "title_block"],
    "view": ["id", "view_type"],
    "entity": ["id", "entity_type", "label", "confidence", "geometry", "attributes", "license_provenance", "data_lane", "ontology", "text_spans"],
    "connection": ["id", "source_id", "target_id", "connection_type", "confidence"],
    "port": ["name", "amps", "tags"],
    "text_span": ["text", "confidence", "source_bbox", "rotation_deg"],
    "issue": ["number", "status", "on"],
}


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(table(spark, sf_dir, "raw_drawing_sets"), kinds=("sheet", "view", "entity", "connection", "port", "issue"))


def _flat(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flat_table(flatten(table(spark, sf_dir, "raw_drawing_sets"), kinds=(kind,), with_origin=True), kind, _COLUMNS[kind], rest="rest")

    return query


def p4_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unreadable(table(spark, sf_dir, "raw_drawing_sets"))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "entities").select("set_id", "entity_id", "recorded_at", "is_deleted")
    return orphans(
        parents,
        [
            References("connections", table(spark, sf_dir, "connections"), "conn_id", ("source_id", "target_id"), "set_id", "recorded_at"),
            References("evidence", table(spark, sf_dir, "evidence"), "evidence_id", ("entity_id",), "set_id", "recorded_at"),
        ],
        key="entity_id", scope="set_id", at="recorded_at", deleted="is_deleted",
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("table_name", "row_key", "ref_field", "reason").distinct()


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_counts(_orphans(spark, sf_dir))


_P5 = r"""
    WITH norm_e AS (
      SELECT set_id, lower(regexp_replace(entity_id, '[\s\-]', '', 'g')) AS id, recorded_at, max(is_deleted) AS is_deleted
      FROM entities GROUP BY ALL),
    refs AS (
      SELECT DISTINCT * FROM (
        SELECT 'connections' AS table_name, conn_id AS row_key, 'source_id' AS ref_field, set_id, source_id AS raw, recorded_at FROM connections
        UNION ALL SELECT 'connections', conn_id, 'target_id', set_id, target_id, recorded_at FROM connections
        UNION ALL SELECT 'evidence', CAST(evidence_id AS VARCHAR), 'entity_id', set_id, entity_id, recorded_at FROM evidence)
      WHERE raw IS NOT NULL AND NOT regexp_full_match(raw, '\s*')),
    judged AS (
      SELECT r.table_name, r.row_key, r.ref_field, r.recorded_at AS ref_at, count(e.id) AS n,
             count(e.id) FILTER (e.recorded_at <= r.recorded_at) AS n_before,
             arg_max(e.is_deleted, e.recorded_at) FILTER (e.recorded_at <= r.recorded_at) AS gone
      FROM refs r LEFT JOIN norm_e e ON e.set_id = r.set_id AND e.id = lower(regexp_replace(r.raw, '[\s\-]', '', 'g'))
      GROUP BY ALL),
    orphan AS (
      SELECT table_name, row_key, ref_field, ref_at,
             CASE WHEN n = 0 THEN 'missing' WHEN n_before = 0 THEN 'late' WHEN gone THEN 'deleted' END AS reason
      FROM judged)
"""

def _unwrapped(x: str) -> str:
    """SQL of a text, or of what is encoded in it, once or twice; null if that isn't JSON."""
    t = f"trim({x}, chr(65279) || ' ' || chr(9) || chr(10) || chr(13))"
    for _ in range(2):
        t = f"CASE WHEN json_valid({t}) THEN CASE json_type({t}) WHEN 'VARCHAR' THEN ({t}) ->> '$' ELSE {t} END END"
    return t


def _member(o: str, name: str) -> str:
    """SQL of a member as the text of a field."""
    return f"CASE json_type({o}, '$.{name}') WHEN 'VARCHAR' THEN {o} ->> '$.{name}' WHEN 'NULL' THEN NULL ELSE CAST(json_extract({o}, '$.{name}') AS VARCHAR) END"


def _stage(name: str, parent: str, source: str, ordinal: str) -> str:
    """SQL of the objects of a list (or a lone one) with their positions; ``source`` is the list's text in ``parent``."""
    return f"""
    {name}_text AS (SELECT *, {_unwrapped(source)} AS t FROM {parent}),
    {name}_list AS (SELECT * EXCLUDE (t), json_extract(CASE json_type(t) WHEN 'OBJECT' THEN '[' || t || ']' ELSE t END, '$[*]') AS l FROM {name}_text WHERE CASE WHEN json_valid(t) THEN json_type(t) IN ('ARRAY', 'OBJECT') END),
    {name}_item AS (SELECT * EXCLUDE (l, o, k), l[k]::VARCHAR AS item, (k - 1)::INT AS {ordinal} FROM (SELECT *, unnest(range(1, len(l) + 1)) AS k FROM {name}_list)),
    {name} AS (SELECT * FROM (SELECT * EXCLUDE (item), {_unwrapped("item")} AS o FROM {name}_item) WHERE CASE WHEN json_valid(o) THEN json_type(o) = 'OBJECT' END)"""


def _anywhere(name: str, parent: str, member: str, key: str, keep: str, ordinal: str) -> str:
    """SQL of the objects of all lists of a name at any depth of a member."""
    at = f"{name}_at"
    return f"""
    {at} AS (SELECT *, {_unwrapped(_member("o", member))} AS m FROM {parent}),
    {name}_found AS (SELECT p.* EXCLUDE (m, o), '' AS o, t.value::VARCHAR AS v, (row_number() OVER (PARTITION BY {keep} ORDER BY t.id) - 1)::INT AS list_ord FROM {at} p, json_tree(p.m) t WHERE t.key = '{key}'),""" + _stage(name, f"{name}_found", "v", ordinal)


_DOCS = f"""
    WITH given AS (SELECT DISTINCT set_key, payload FROM raw_drawing_sets),
    opened AS (SELECT set_key, payload, {_unwrapped("payload")} AS o FROM given),
    sets AS (SELECT set_key, sha256(payload) AS record, o FROM opened WHERE CASE WHEN json_valid(o) THEN json_type(o) = 'OBJECT' AND regexp_matches(split_part(trim({_member("o", "schema_version")}), '.', 1), '^0+$') END),"""
_P4 = _DOCS + ",".join([
    _stage("sheet", "sets", _member("o", "sheets"), "sheet_ord"),
    _stage("view", "sheet", _member("o", "views"), "view_ord"),
    _stage("entity", "view", _member("o", "entities"), "item_ord"),
    _stage("connection", "view", _member("o", "connections"), "item_ord"),
    _anywhere("port", "entity", "attributes", "ports", "set_key, record, sheet_ord, view_ord, item_ord", "sub_ord"),
    _stage("text_span", "entity", _member("o", "text_spans"), "sub_ord"),
    _anywhere("issue", "sets", "metadata", "issues", "set_key, record", "item_ord"),
]) + "\n"
_P4_ORDINALS = {
    "set": [], "sheet": ["sheet_ord"], "view": ["sheet_ord", "view_ord"], "entity": ["sheet_ord", "view_ord", "item_ord"], "connection": ["sheet_ord", "view_ord", "item_ord"],
    "port": ["sheet_ord", "view_ord", "item_ord", "list_ord", "sub_ord"], "text_span": ["sheet_ord", "view_ord", "item_ord", "sub_ord"], "issue": ["list_ord", "item_ord"],
}


def _p4_table(kind: str) -> str:
    tables = {"set": ["sheets"], "sheet": ["views"], "view": ["entities", "connections"]}.get(kind, [])
    known = ", ".join(f"'{c}'" for c in _COLUMNS[kind] + tables)
    rest = f"""CASE WHEN len(list_filter(json_keys(o), lambda k: NOT list_contains([{known}], k))) > 0
        THEN to_json(map_from_entries(list_transform(list_filter(json_keys(o), lambda k: NOT list_contains([{known}], k)), lambda k: {{'k': k, 'v': o ->> ('$."' || k || '"')}})))::VARCHAR END AS rest"""
    return _P4 + f"SELECT {', '.join(['set_key', 'record', *_P4_ORDINALS[kind], *[_member('o', c) + f' AS {chr(34)}{c}{chr(34)}' for c in _COLUMNS[kind]], rest])} FROM {'sets' if kind == 'set' else kind}"


def _p4_found() -> str:
    each = []
    for kind in ("sheet", "view", "entity", "connection", "port", "issue"):
        ords = [c if c in _P4_ORDINALS[kind] else f"-1 AS {c}" for c in ("sheet_ord", "view_ord", "item_ord", "sub_ord")]
        each.append(f"SELECT set_key, '{kind}' AS node_kind, {', '.join(ords)} FROM {kind}")
    return _P4 + " UNION ".join(each)


UNREADABLE = f"""SELECT DISTINCT set_key, CASE WHEN payload IS NULL OR regexp_full_match(payload, '\\s*') THEN 'empty' WHEN NOT json_valid(trim(payload, chr(65279) || ' ' || chr(9) || chr(10) || chr(13))) THEN 'broken'
        WHEN o IS NULL OR json_type(o) <> 'OBJECT' THEN 'no object' ELSE 'foreign version' END AS reason
        FROM (SELECT set_key, payload, {_unwrapped("payload")} AS o FROM raw_drawing_sets)
        WHERE payload IS NULL OR NOT coalesce(json_valid(o), false) OR json_type(o) <> 'OBJECT' OR NOT coalesce(regexp_matches(split_part(trim({_member("o", "schema_version")}), '.', 1), '^0+$'), false)"""

QUERIES = {
    "p4_found": p4_found,
    **{f"p4_{'entities' if k == 'entity' else k + 's'}": _flat(k) for k in _COLUMNS},
    "p4_unreadable": p4_unreadable,
    "p5_found": p5_found,
    "p5_counts": p5_counts,
}

ORACLE = {
    "p4_found": _p4_found(),
    **{f"p4_{'entities' if k == 'entity' else k + 's'}": _p4_table(k) for k in _COLUMNS},
    "p4_unreadable": UNREADABLE,
    "p5_found": _P5 + "SELECT DISTINCT table_name, row_key, ref_field, reason FROM orphan WHERE reason IS NOT NULL",
    "p5_counts": _P5 + """SELECT table_name, ref_field, reason, strftime(ref_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n_orphans
        FROM orphan WHERE reason IS NOT NULL GROUP BY ALL""",
}
