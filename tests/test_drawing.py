"""Takeoff, grounding, questions, licences, validation on the small cases that can be checked by hand."""

import pytest
from pyspark.sql import functions as F

from quillspan.functions import geometry as G
from quillspan.operators import boards, grounding, licensing, questions, takeoff
from quillspan.operators.drawing import current
from quillspan.plans import drawings
from tests.conftest import rows

ENTITY = f"set_id string, sheet_ord int, sheet_number string, discipline string, doc_ord bigint, entity_id string, entity_type string, label string, confidence double, geometry {G.GEOMETRY}, ifc_class string, ontology struct<masterformat:string,uniformat:string,omniclass:string,uniclass:string,extra:map<string,string>>, license_provenance string, data_lane string"
NO_CODES = (None, None, None, None, {})


def box(cx, cy, half=0.02):
    return ("bbox", [(cx - half, cy - half), (cx + half, cy + half)], None, None, None)


def entity(k, label, conf=0.9, kind="symbol", geometry=None, sheet="E-101", set_id="s", id=None, ifc=None, codes=NO_CODES, license="owned", lane="commercial"):
    return (set_id, 0 if sheet == "E-101" else 1, sheet, {"E": "electrical", "A": "architectural"}.get(sheet[0], "unknown"), k, id or f"e{k}", kind, label, conf, geometry, ifc, codes, license, lane)


def frame(spark, items):
    return spark.createDataFrame(items, ENTITY)


def edges(spark, items):
    return spark.createDataFrame([("s", 0, a, b, t) for a, b, t in items], "set_id string, sheet_ord int, source_id string, target_id string, connection_type string")


def test_counts_thresholds_and_exclusions(spark):
    e = frame(spark, [entity(k, "Duplex Receptacle") for k in range(3)] + [entity(3, "Panelboard", 0.95), entity(4, "note", kind="text"), entity(5, "n", kind="graph_node"), entity(6, None), entity(7, "wall", kind="wall")])
    assert rows(takeoff.takeoff_lines(e), "label", "n") == [("Duplex Receptacle", 3), ("Panelboard", 1)]
    e = frame(spark, [entity(k, "Light Fixture", c) for k, c in enumerate((0.9, 0.3, 0.05))])
    assert rows(takeoff.takeoff_lines(e, min_confidence=0.1), "n", "needs_review") == [(2, 1)]
    assert takeoff.takeoff_evidence(e).count() == 3
    assert rows(takeoff.totals(takeoff.takeoff_lines(e)), "n") == [(3,)] * 3


def test_evidence_of_every_counted_entity_is_registered(spark, monkeypatch):
    e = frame(spark, [entity(k, "Light Fixture", c) for k, c in enumerate((0.9, 0.25, 0.05, 0.0))])
    monkeypatch.setattr(drawings, "_rows", lambda s, d: e)
    assert rows(drawings.QUERIES["takeoff_evidence_all"](spark, ""), "confidence") == [(0.0,), (0.05,), (0.25,), (0.9,)]
    assert rows(drawings.QUERIES["takeoff_lines"](spark, ""), "n") == [(4,)]
    assert rows(drawings.QUERIES["takeoff_evidence"](spark, ""), "confidence") == [(0.25,), (0.9,)]


def test_first_codes_win(spark):
    e = frame(spark, [entity(2, "x", codes=("26", None, None, None, {})), entity(1, "x", ifc="IfcOutlet"), entity(0, "x", ifc="", codes=("", None, None, None, {}))])
    assert rows(takeoff.takeoff_lines(e), "masterformat", "ifc_class") == [(None, "IfcOutlet")]
    text = takeoff.to_markdown([r.asDict() for r in takeoff.takeoff_lines(e).collect()], {"home_run": 2}, name="set")
    assert "| x | 3 | EA |" in text and "home_run: 2" in text


def test_quantities(spark):
    triangle = ("polygon", [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)], None, None, None)
    e = frame(spark, [entity(0, "a", geometry=box(0.05, 0.05), id="a"), entity(1, "b", geometry=box(0.45, 0.10), id="b"), entity(2, "room", kind="room", geometry=triangle), entity(3, "w", kind="wall", geometry=box(0.5, 0.5, 0.25)), entity(4, None, kind="room", geometry=triangle)])
    c = edges(spark, [("a", "b", "home_run"), ("a", "gone", "home_run"), ("b", "a", "")])
    got = rows(takeoff.quantities(e, c), "kind", "name", "unit", "n", "quantity", "scale_known")
    assert got == [("area", "room", "norm²", 1, 0.5, False), ("linear", "Wall", "norm", 1, 0.5, False), ("linear", "home_run", "norm", 1, 0.4, False), ("linear", "unspecified", "norm", 1, 0.4, False)]
    sheets = spark.createDataFrame([("s", 1, 5.0, 5.0, "ft", 1.0, None), ("s", 0, 10.0, 10.0, "pt", 1.0, "m"), ("s", -1, 9.0, 9.0, "x", 0.0, "x")], "set_id string, sheet_ord int, width double, height double, size_unit string, ratio double, real_world_unit string")
    assert ("area", "room", "m²", 1, 50.0, True) in rows(takeoff.quantities(e, c, takeoff.scales(sheets)), "kind", "name", "unit", "n", "quantity", "scale_known")
    assert rows(takeoff.connection_counts(c), "connection_type", "n") == [("home_run", 2), ("unspecified", 1)]


def test_grounding(spark):
    e = frame(spark, [entity(0, " PANELBOARD ", codes=("old", None, "keep", None, {})), entity(1, "nonsense", ifc="Own"), entity(2, None), entity(3, "Light Fixture")])
    got = {r.entity_id: r for r in grounding.ground(e).collect()}
    assert (got["e0"].ifc_class, got["e0"].ontology.masterformat, got["e0"].ontology.omniclass) == ("IfcElectricDistributionBoard", "26 24 16", None)
    assert (got["e1"].ifc_class, got["e1"].grounded, got["e2"].grounded) == ("Own", False, None)
    assert rows(grounding.coverage(grounding.ground(e))) == [("s", 2, 3)]
    assert [r[0] for r in rows(grounding.remap(frame(spark, [entity(k, x) for k, x in enumerate(("Double Socket", "Light Switch", "Radiator", "Gas Meter Box"))])), "label")] == ["Duplex Receptacle", "Single-Pole Switch"]
    key = grounding.matched_label(F.col("a"), F.col("b"), F.lit("symbol"))
    assert rows(spark.createDataFrame([("", "I"), ("x", "I"), (None, "")], "a string, b string").select(key)) == [("I",), ("symbol",), ("x",)]
    found = spark.createDataFrame([("Panelboard", 1.5), ("thing", -1.0)], "label string, score double")
    assert rows(grounding.from_detections(found), "label", "entity_type", "ifc_class", "confidence") == [("Panelboard", "symbol", "IfcElectricDistributionBoard", 1.0), ("thing", "other", None, 0.0)]


@pytest.fixture(scope="module")
def two_sheets(spark):
    e = frame(spark, [entity(0, "Duplex Receptacle", 0.9, id="r1"), entity(1, "Duplex Receptacle", 0.3, id="r2"), entity(2, "Light Fixture", 0.9, id="l1"), entity(3, "Panelboard", 0.95, id="panel"), entity(4, "door", 0.9, kind="opening", sheet="A-101", id="d1")])
    sheets = spark.createDataFrame([("s", 0, "E-101", "electrical"), ("s", 1, "A-101", "architectural")], "set_id string, sheet_ord int, sheet_number string, discipline string")
    return e, sheets, edges(spark, [("r1", "l1", "conductor")])


@pytest.mark.parametrize(
    ("question", "expected"),
    [
        ("how many receptacles?", [(None, 2)]),
        ("How many doors on A-101", [(None, 1)]),
        ("how many receptacles on A-101", [(None, 0)]),
        ("how many doors on X-999", [(None, None)]),
        ("list the doors on X-999", [(None, None)]),
        ("show me windows", []),
        ("count of everything", [(None, 0)]),
        ("how many", [(None, 5)]),
        ("what disciplines are in this set", [("architectural", None), ("electrical", None)]),
        ("how many sheets", [(None, 2)]),
        ("list the sheets", [("A-101", None), ("E-101", None)]),
        ("list the panels", [("Panelboard", 1)]),
        ("what is the weather", [(None, None)]),
    ],
)
def test_questions(two_sheets, question, expected):
    e, sheets, _ = two_sheets
    got = questions.answer(e, sheets, question)
    assert rows(got, "value_text", "value_number") == sorted(expected, key=repr)
    assert all((r.note is not None) == (r.value_text is None and r.value_number is None) for r in got.collect())


def test_evidence_and_columns_of_questions(spark, two_sheets):
    e, _, _ = two_sheets
    assert rows(questions.answer_evidence(e, "how many receptacles?"), "sheet_number", "entity_id") == [("E-101", "r1"), ("E-101", "r2")]
    assert questions.answer_evidence(e, "how many receptacles on A-101").count() == questions.answer_evidence(e, "how many sheets").count() == 0
    asked = spark.createDataFrame([("How many duplex receptacles are there on E-1.2?",), ("account",), (None,)], "q string").select(questions.routed(F.col("q")).alias("r"))
    assert rows(asked.select("r.*")) == sorted([("count", "duplex receptacle", "e-1.2"), ("count", "account", None), ("unknown", None, None)], key=repr)


def test_requests(spark, two_sheets):
    e, _, c = two_sheets
    got = rows(questions.requests(e, c), "number", "severity", "label", "n_low", "n_total", "entity_id")
    assert got == [("001", "review", "Duplex Receptacle", 1, 2, None), ("002", "discrepancy", "Panelboard", None, None, "panel")]
    first = questions.requests(e, c).orderBy("number").first()
    assert (first.discipline, first.subject) == ("electrical", "Quantity of Duplex Receptacle to be confirmed on E-101") and "1 of 2" in first.body and "50%" in first.body
    assert rows(questions.request_evidence(e), "entity_id") == [("r2",)]
    assert questions.requests(e.where("confidence > 0.5"), edges(spark, [])).count() == 0


def test_licences(spark):
    safe = ("CC0", "public-domain", "permissive", "synthetic-owned", "owned", "proprietary-licensed")
    other = ("CC-BY", "CC-BY-SA", "CC-BY-ND", "CC-BY-NC", "CC-BY-NC-SA", "CC-BY-NC-ND", "research-only", "unknown", None)
    e = frame(spark, [entity(k, "x", license=x) for k, x in enumerate(safe + other)] + [entity(99, "x", license="CC-BY", lane="research")])
    assert {r.license_provenance for r in licensing.lane_violations(e).collect()} == set(other)
    assert rows(licensing.offenders(frame(spark, [entity(0, "x", license="unknown"), entity(1, "x")]))) == [("s", False, 1, "unknown")]
    sets = spark.createDataFrame([("s", "commercial", "CC0")], "set_id string, data_lane string, license_provenance string")
    assert licensing.set_violations(sets, frame(spark, [entity(0, "x", lane="research"), entity(1, "x")])).count() == 1
    assert rows(licensing.licenses_present(frame(spark, [entity(0, "x")]), sets)) == [("s", 1, "CC0,owned")]
    assert licensing.not_owned(frame(spark, [entity(0, "x"), entity(1, "x", license="synthetic-owned")])).count() == 1


def test_current_rows(spark):
    df = spark.createDataFrame([("s", "a", 1, False), ("s", "a", 2, True), ("s", "b", 1, True), ("s", "b", 2, False), ("s", "b", 2, False), ("s", "c", 1, None)], "set_id string, entity_id string, recorded_at int, is_deleted boolean")
    assert rows(current(df, "set_id", "entity_id"), "entity_id", "recorded_at") == [("b", 2), ("c", 1)]


def test_validation(spark):
    counts = lambda items: spark.createDataFrame([("s", sheet, label, n) for sheet, label, n in items], "set_id string, sheet_number string, label string, n bigint")
    want = counts([("1", "a", 2), ("1", "b", 1), ("2", "a", 1)])
    assert rows(boards.count_issues(want, counts([("1", "a", 2), ("1", "b", 1), ("2", "a", 1)]))) == []
    got = rows(boards.count_issues(want, counts([("1", "a", 1), ("1", "x", 5)])), "sheet_number", "code", "label", "expected", "got")
    assert got == [("1", "entity_count", "a", 2, 1), ("1", "entity_count", "b", 1, 0), ("1", "entity_total", None, 3, 6), ("2", "missing_sheet", None, None, None)]
    there = frame(spark, [entity(0, "a", geometry=box(0.5, 0.5)), entity(1, "a")])
    places = spark.createDataFrame([("s", "E-101", "a", 0.5 + 5e-7, 0.5), ("s", "E-101", "a", 0.6, 0.5), ("s", "E-101", "b", 0.5, 0.5)], "set_id string, sheet_number string, label string, x double, y double")
    assert rows(boards.placement_issues(places, there), "label", "x") == [("a", 0.6), ("b", 0.5)]


def test_ranks_and_hash_split(spark):
    board = spark.createDataFrame([("detection_map", "mep", "m", 0.5, 1), ("detection_map", "mep", "n", 0.9, 2), ("counting_mape", "mep", "m", 5.0, 3), ("counting_mape", "mep", "n", 2.0, 4)], "metric string, drawing_type string, model string, value double, ord int")
    assert [r.model for r in boards.ranked(board).where("rank = 1").collect()] == ["n", "n"]
    assert boards.query_results(board, metric="counting_mape", drawing_type="mep").count() == 2
    import hashlib

    names = spark.createDataFrame([(f"s{k}",) for k in range(50)], "name string")
    for r in boards.hash_split(names, F.col("name"), val_fraction=0.3, seed=0).collect():
        assert r.split == ("val" if int(hashlib.sha1(f"0:{r.name}".encode()).hexdigest()[:15], 16) / float(1 << 60) < 0.3 else "train")
