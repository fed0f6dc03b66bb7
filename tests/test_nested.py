import json
import subprocess
import sys

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspan.operators import nested as N
from quillspan.plans.records import QUERIES
from tests.conftest import rows

PORT = {"name": "p0", "amps": 20}
RECORD = {
    "schema_version": "0.2.0",
    "id": "a",
    "sheets": [
        None,
        {
            "id": "s1",
            "views": {
                "id": "v",
                "entities": [{"id": "e0", "attributes": {"circuit": {"feed": {"ports": [None, PORT]}}}}, None, json.dumps({"id": "e2", "attributes": json.dumps({"ports": PORT})})],
                "connections": {"id": "c", "source_id": "e0"},
            },
        },
        "text",
        {"id": "s3", "views": None},
    ],
    "metadata": json.dumps({"review": {"issues": [{"number": 1}]}}),
}
EXPECTED = [
    ("connection", 1, 0, 0, -1), ("entity", 1, 0, 0, -1), ("entity", 1, 0, 2, -1), ("issue", -1, -1, 0, -1), ("port", 1, 0, 0, 1), ("port", 1, 0, 2, 0),
    ("set", -1, -1, -1, -1), ("sheet", 1, -1, -1, -1), ("sheet", 3, -1, -1, -1), ("view", 1, 0, -1, -1),
]


def frame(spark, payloads):
    return spark.createDataFrame([(k, p, "x") for k, p in enumerate(payloads)], "set_key bigint, payload string, fields string")


def test_positions_lone_objects_and_encoded_members(spark):
    for payload in (json.dumps(RECORD), json.dumps(json.dumps(RECORD)), "﻿\n " + json.dumps(RECORD, indent=2)):
        got = N.flatten(frame(spark, [payload])).drop("fields", "set_key")
        assert rows(got) == EXPECTED


def test_unreadable_payloads(spark):
    bad = [None, "", "  ", "null", "[]", '"text"', "{}}", json.dumps(RECORD)[:-5], "<html>502</html>", "{}", '{"schema_version": "1.0.0"}', '{"schema_version": null}', '{"schema_version": "x"}', '{"schema_version": true}']
    assert N.flatten(frame(spark, bad)).count() == 0
    assert {r[0] for r in rows(N.unreadable(frame(spark, bad)))} == set(range(len(bad)))
    assert rows(N.unreadable(frame(spark, [json.dumps(RECORD)]))) == []


def test_tables_keep_members_and_parents(spark):
    flat = N.flatten(frame(spark, [json.dumps(RECORD)]))
    assert rows(N.flat_table(flat, "entity", ["id", "label"])) == [(0, 1, 0, 0, "e0", None), (0, 1, 0, 2, "e2", None)]
    assert rows(N.flat_table(flat, "port", ["name", "amps"])) == [(0, 1, 0, 0, 1, "p0", "20"), (0, 1, 0, 2, 0, "p0", "20")]
    assert rows(N.flat_table(flat, "set", ["id"])) == [(0, "a")]


def test_repeated_rows_null_keys_and_empty_table(spark):
    df = spark.createDataFrame([(None, json.dumps(RECORD)), (None, json.dumps(RECORD))], "set_key bigint, payload string")
    assert N.positions(df).count() == len(EXPECTED) == N.flatten(df).count()
    assert N.flatten(df.where("false")).count() == 0


def test_objects_of_several_lists_and_payloads_are_kept(spark):
    """Lists of one name at different depths, and different payloads of one key or none, keep all their objects."""
    one = {"schema_version": "0.2.0", "id": "one", "metadata": {"a": {"issues": [{"number": 1}, {"number": 2}]}, "issues": {"number": 3}}}
    entity = {"attributes": {"ports": [{"name": "p"}], "in": [{"ports": None}, {"ports": [None, {"name": "q"}, {"name": "r"}]}]}}
    two = {"schema_version": "0.2.0", "id": "two", "metadata": {"issues": {"number": 4}}, "sheets": {"views": {"entities": entity}}}
    df = spark.createDataFrame([(k, json.dumps(p)) for k, p in [(None, one), (None, two), (None, one), (7, one), (7, one), (7, two)]], "set_key bigint, payload string")
    flat = N.flatten(df, with_origin=True)
    for key in (None, 7):
        mine = flat.where(F.col("set_key").eqNullSafe(F.lit(key).cast("bigint")))
        sets = {r["record"]: r["id"] for r in N.flat_table(mine, "set", ["id"]).collect()}
        assert sorted(sets.values()) == ["one", "two"]
        issues = N.flat_table(mine, "issue", ["number"])
        assert issues.columns == ["set_key", "record", "list_ord", "item_ord", "number"]
        assert sorted((sets[r[1]], *r[2:]) for r in issues.collect()) == [("one", 0, 0, "1"), ("one", 0, 1, "2"), ("one", 1, 0, "3"), ("two", 0, 0, "4")]
        ports = N.flat_table(mine, "port", ["name"]).collect()
        assert sorted((sets[r[1]], *r[2:]) for r in ports) == [("two", 0, 0, 0, 0, 0, "p"), ("two", 0, 0, 0, 2, 1, "q"), ("two", 0, 0, 0, 2, 2, "r")]
    assert N.flat_table(N.flatten(df), "issue", ["number"]).count() == 8


def test_registered_tables_keep_every_member(spark, tmp_path):
    """Ontology and text spans have columns, spans a table as well, and members without a column are in ``rest``."""
    spans = [{"text": "TYP."}, None, {"text": "WP", "confidence": 0.5, "bbox": [1, 2]}]
    entity = {"id": "e", "ontology": {"masterformat": "26"}, "text_spans": json.dumps(spans), "sheets": 1, "extra": None, "ports": "x"}
    record = {"schema_version": "0.2.0", "new": [1], "sheets": {"scale": 2, "views": {"id": "v", "entities": [entity, {"id": "f"}]}}}
    frame(spark, [json.dumps(record)]).write.parquet(str(tmp_path / "raw_drawing_sets.parquet"))
    one = lambda name, *columns: rows(QUERIES[name](spark, str(tmp_path)), *columns)
    assert one("p4_entities", "id", "ontology", "text_spans", "rest") == [
        ("e", '{"masterformat":"26"}', json.dumps(spans), '{"sheets":"1","extra":null,"ports":"x"}'), ("f", None, None, None)
    ]
    assert one("p4_text_spans", "sheet_ord", "view_ord", "item_ord", "sub_ord", "text", "confidence", "rest") == [(0, 0, 0, 0, "TYP.", None, None), (0, 0, 0, 2, "WP", "0.5", '{"bbox":"[1,2]"}')]
    assert one("p4_sets", "schema_version", "rest") == [("0.2.0", '{"new":"[1]"}')]
    assert one("p4_sheets", "rest") == [('{"scale":"2"}',)] and one("p4_views", "id", "rest") == [("v", None)]


def test_very_deep_and_very_long():
    deep = {"schema_version": "0.1.0", "metadata": {"issues": []}}
    inner = deep["metadata"]
    for _ in range(600):
        inner["x"] = {"issues": [{"n": 1}]}
        inner = inner["x"]
    assert sum(path == "issue:" for path, _, _ in N.triples(json.dumps(deep))) == 600
    wide = {"schema_version": "0.1.0", "sheets": [{"id": "x" * 50} for _ in range(20_000)]}
    assert sum(path == "sheet:" for path, _, _ in N.triples(json.dumps(wide))) == 20_000
    # Deeper than the library's reader goes.
    levels = 60_000
    text = '{"schema_version": "0.1.0", "metadata": ' + '{"x": [' * levels + '{"issues": {"n": [1, "a", null, true, -2.5]}}' + "]}" * levels + "}"
    assert [v for path, _, v in N.triples(text) if path == "issue:n"] == ['[1,"a",null,true,-2.5]']
    assert not list(N.triples(text[:-1])) and not list(N.triples(text + "}"))


def test_encoded_any_number_of_times_and_repeated_members():
    payload = json.dumps(RECORD)
    want = list(N.triples(payload))
    for _ in range(7):
        payload = json.dumps(payload)
    assert list(N.triples(payload)) == want
    sheets = RECORD["sheets"]
    for _ in range(6):
        sheets = json.dumps(sheets)
    assert list(N.triples(json.dumps({**RECORD, "sheets": sheets}))) == want
    # Of members of one name the last holds, wherever the version is.
    text = '{"sheets": [{"id": "no"}], "id": "a", "sheets": [{"id": "b", "views": [7], "id": "c"}], "id": "d", "schema_version": "9.0.0", "schema_version": "0.2.0"}'
    assert [(p, v) for p, _, v in N.triples(text)] == [("set:", None), ("sheet:", None), ("sheet:id", "c"), ("set:id", "d"), ("set:schema_version", "0.2.0")]


def test_half_a_character_and_odd_items(spark):
    text = '{"schema_version": 0.2, "name": "\\ud800x", "sheets": [[{"id": 1}], "[]", "{", 3, {"views": "\\"{}\\""}]}'
    assert rows(N.flat_table(N.flatten(frame(spark, [text])), "set", ["name"])) == [(0, "?x")]
    assert [r[1:] for r in rows(N.flatten(frame(spark, [text])).drop("fields")) if r[0] == "view"] == []
    assert rows(N.positions(frame(spark, [text]), kinds=("view", "sheet")).drop("set_key")) == [("sheet", 4, -1, -1, -1), ("view", 4, 0, -1, -1)]


def test_a_large_record_is_never_held_whole():
    """A large record is read in memory that its objects would exceed many times."""
    code = """
import resource, sys
from quillspan.operators.nested import pivoted
sheet = '{"id": "s", "views": [{"entities": [' + ",".join('{"id": "e%d", "attributes": {"ports": [{"name": "p"}]}}' % k for k in range(400)) + ']}]}'
text = '{"schema_version": "0.2.0", "sheets": [' + ",".join([sheet] * 3_000) + "]}"
assert len(text) > 60_000_000
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = sum(1 for _, row in zip(range(200_000), pivoted(text)))
grown = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024
print(n, grown)
assert n == 200_000 and grown < 50
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300)


def test_all_tables_in_one_reading(spark, tmp_path):
    df = frame(spark, [json.dumps(RECORD), None, json.dumps({**RECORD, "id": "b"})])
    N.write_tables(df, str(tmp_path / "tables"))
    back = spark.read.parquet(str(tmp_path / "tables"))
    flat = N.flatten(df, with_origin=True)
    for kind in N.TABLES:
        assert rows(N.flat_table(back, kind, ["id", "name"])) == rows(N.flat_table(flat, kind, ["id", "name"]))


leaves = st.none() | st.booleans() | st.integers(-9, 9) | st.text(max_size=4)
views = st.fixed_dictionaries({"entities": st.lists(st.none() | st.fixed_dictionaries({"label": leaves}), max_size=4)})
records = st.fixed_dictionaries({"schema_version": st.just("0.2.0"), "sheets": st.lists(st.none() | st.fixed_dictionaries({"views": st.lists(views, max_size=3)}), max_size=3)})


@settings(max_examples=60, deadline=None)
@given(records)
def test_triples_round_trip(record):
    """Every entity is met once, at its place, with its label."""
    got = {ords: value for path, ords, value in N.triples(json.dumps(record)) if path == "entity:label"}
    want = {
        (i, j, k, -1): e["label"] if isinstance(e["label"], str) or e["label"] is None else json.dumps(e["label"])
        for i, s in enumerate(record["sheets"]) if s for j, v in enumerate(s["views"]) for k, e in enumerate(v["entities"]) if e
    }
    assert got == want
