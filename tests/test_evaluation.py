"""Evaluation matrix, boards, register, audits, projections and datasets on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from quillspan.operators import drawing, evaluation, licensing, metrics, registry, takeoff, tiling
from tests.conftest import rows
from tests.test_drawing import box, entity, frame

SAMPLES = "doc string, drawing_type string, origin string, condition string, dataset string"


@pytest.fixture(scope="module")
def truth(spark):
    items = [entity(k, "Duplex Receptacle", geometry=box(0.1 + k / 10, 0.5), set_id=s) for s in ("a", "b") for k in range(4)]
    return metrics.judged(frame(spark, items).withColumn("attributes", F.lit(None).cast("string")))


def test_matrix(spark, truth, tmp_path):
    samples = spark.createDataFrame([("a", "mep", "vector", "clean", "d"), ("b", "mep", "raster", None, "d"), ("c", None, None, None, None)], SAMPLES)
    assert rows(evaluation.slices(samples), "drawing_type", "condition", "n_samples") == [("mep", "clean", 1), ("mep", "clean", 1), ("unknown", "clean", 1)]
    task = evaluation.Task("t", ("detection_map", "counting_exact_match"), samples.where("doc <> 'c'"), truth)
    drops = evaluation.Model("drops", predict=lambda t, seed: t.where(F.col("ord") >= seed), stochastic=True)
    perfect = evaluation.Model("perfect", predict=lambda t, seed: t)
    out = evaluation.run_matrix([task], [perfect, drops, evaluation.reported("published, real drawings"), evaluation.reported("published, general models")]).cache()
    got = {(r.model, r.metric, r.origin): r for r in out.collect()}
    assert got["perfect", "detection_map", "vector"].value == 1.0 and got["perfect", "detection_map", "vector"].n_seeds == 1
    d = got["drops", "detection_map", "raster"]
    assert d.n_seeds == 3 and d.value == pytest.approx(0.75) and d.ci95 == pytest.approx(4.303 * 0.25 / 3**0.5)
    # Reported numbers come in place of measured ones; a model that neither reports nor predicts has no row.
    r = got["published, real drawings", "detection_map", "vector"]
    assert (r.value, r.kind, r.citation) == (0.825, "reported", "arXiv 2508.10449")
    assert ("published, real drawings", "counting_exact_match", "vector") not in got and len(got) == 2 * 2 * 2 + 2 + 2
    path = str(tmp_path / "board")
    evaluation.append(out, path)
    evaluation.append(out.where("model = 'perfect'"), path)
    back = evaluation.stored(spark, path)
    assert back.count() == out.count() + 4 and evaluation.listings(back).collect() == [("counting_exact_match", "mep"), ("detection_map", "mep")]
    text = evaluation.render(out)
    assert "| 1 | perfect (best) | clean | 100.0% | 1 | measured | measured |" in text and text.index("perfect (best)") < text.index("| drops |")
    assert evaluation.compared(out).where("metric = 'detection_map' AND rank = 1").first().model == "perfect"


def test_two_boards_are_never_mixed(spark, truth):
    samples = spark.createDataFrame([("a", "mep", "raster", "clean", "made")], SAMPLES)
    task = evaluation.Task("t", ("counting_exact_match",), samples, truth)
    perfect = evaluation.Model("mine", predict=lambda t, seed: t)
    made, real = evaluation.two_boards(perfect, task, None)
    assert {r.model for r in made.collect()} == {"mine", "truth"}
    assert [(r.model, r.kind, r.dataset) for r in real.collect()] == [("published, general models", "reported", "none yet")]
    found = samples.withColumn("dataset", F.lit("found"))
    made, real = evaluation.two_boards(perfect, task, evaluation.Task("r", task.metrics, found, truth))
    assert {r.dataset for r in made.collect()} == {"made"} and {(r.model, r.dataset) for r in real.collect()} == {("mine", "found"), ("truth", "found"), ("published, general models", "found")}


def test_register_and_audits(spark, tmp_path):
    records = [{"name": "One", "license_provenance": "CC0", "data_lane": "commercial"}, {"name": "Two", "license_provenance": "CC-BY-NC", "data_lane": "research", "tasks": ["qa"]}, {"name": "Bad", "license_provenance": "CC-BY", "data_lane": "commercial"}]
    (tmp_path / "r.json").write_text(json.dumps({"datasets": records}))
    register = registry.read_registry(spark, str(tmp_path / "r.json"))
    assert registry.named(register, "oNE").first().license_provenance == "CC0" and rows(registry.in_lane(register, "research"), "name") == [("Two",)]
    assert rows(registry.audit_registry(register)) == [("Bad", "CC-BY")]
    with pytest.raises(KeyError):
        registry.named(register, "none")
    (tmp_path / "x.json").write_text(json.dumps([{"name": "x", "colour": 1}]))
    with pytest.raises(ValueError):
        registry.read_registry(spark, str(tmp_path / "x.json"))
    sets = spark.createDataFrame([(1, "r", "CC0", "commercial"), (2, "s", "CC-BY-NC", "commercial"), (3, "t", "unknown", "research")], "set_key bigint, record string, license_provenance string, data_lane string")
    inside = spark.createDataFrame([(1, "r", "CC0", "commercial"), (1, "r", "owned", "research"), (2, "s", None, "commercial"), (3, "t", "unknown", "research")], sets.schema)
    lost = spark.createDataFrame([(9, "broken")], "set_key bigint, reason string")
    got = rows(registry.audit_documents(sets, inside, lost))
    assert got == [(1, "licence of entities", "owned"), (2, "licence of entities", "none"), (2, "licence of the set", "CC-BY-NC"), (9, "unreadable", "broken")]
    assert rows(registry.audit_counts(sets, lost)) == [(3, 2, 1)]
    docs = spark.createDataFrame([(f"d{k}", "{}", "CC0", "research") for k in range(5)], "name string, payload string, license_provenance string, data_lane string")
    assert rows(registry.prepare(docs, str(tmp_path / "out"))) == [("research", "CC0", 5)]
    assert rows(registry.prepare(docs, str(tmp_path / "out"), limit=2)) == [("research", "CC0", 2)] and rows(spark.read.parquet(str(tmp_path / "out")), "name") == [("d0",), ("d1",)]
    odd = frame(spark, [entity(0, "x", kind="thing"), entity(1, "x", license="mine"), entity(2, "x", lane=None)])
    assert rows(licensing.unknown_values(odd)) == [("entity_type", "thing", 1), ("license_provenance", "mine", 1)]


def test_projections(spark):
    key = ["doc"]
    sheets = spark.createDataFrame([("a", 0), ("a", 1), ("b", 2), ("b", 3)], "doc string, sheet_ord int")
    views = spark.createDataFrame([("a", 0, "detail"), ("a", 1, "Plan"), ("b", 3, None)], "doc string, sheet_ord int, view_type string")
    plans = drawing.plan_sheets(sheets, views, key)
    assert rows(plans) == [("a", 1), ("b", 2)]
    e = spark.createDataFrame([("a", 1, 0, "x", "Panelboard", "g"), ("a", 1, 1, "y", "Panelboard", "g"), ("a", 1, 0, "z", "Panelboard", None), ("a", 0, 0, "w", "Panelboard", "g"), ("a", 1, 0, "v", "door", "g")], "doc string, sheet_ord int, view_ord int, id string, label string, geometry string")
    assert rows(drawing.detection_projection(e, plans, key, labels=("Panelboard",)), "id") == [("x",), ("y",)]
    c = spark.createDataFrame([("a", 1, 0, "x", "y"), ("a", 1, 0, "x", "z"), ("a", 1, 1, "y", "x"), ("a", 0, 0, "x", "y")], "doc string, sheet_ord int, view_ord int, source_id string, target_id string")
    assert rows(drawing.graph_projection(e, c, plans, key, labels=("Panelboard",)), "source_id", "target_id", "view_ord") == [("x", "y", 0)]


def test_dataset_keeps_tiles_without_labels(spark, tmp_path):
    tiles_ = spark.createDataFrame([("s", 0, "train"), ("s", 1, "val")], "sheet string, col int, split string")
    lines = spark.createDataFrame([("s", 0, "e2", 3, 0.5, 0.5, 0.25, 0.125), ("s", 0, "e1", 3, 0.1, 0.1, 0.1, 0.1), ("s", 0, "e3", 0, 1.0, 1.0, 0.5, 0.5)], "sheet string, col int, entity_id string, class_index int, cx double, cy double, w double, h double")
    out = tiling.dataset_tiles(tiles_, lines, ["sheet", "col"])
    assert rows(out, "col", "n_labels", "text") == [(0, 3, "0 1.000000 1.000000 0.500000 0.500000\n3 0.100000 0.100000 0.100000 0.100000\n3 0.500000 0.500000 0.250000 0.125000"), (1, 0, "")]
    assert rows(tiling.write_dataset(out, str(tmp_path / "ds"), labels=("a", "b"))) == [("train", 1, 3), ("val", 1, 0)]
    assert "  1: b" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "ds" / "description")).collect())


def test_takeoff_as_values_and_files(spark, tmp_path):
    lines = takeoff.takeoff_lines(frame(spark, [entity(0, "b"), entity(1, "b", 0.1), entity(2, "a"), entity(3, "c", sheet="A-101")]))
    assert [r.label for r in takeoff.ordered(lines).collect()] == ["c", "b", "a"]
    takeoff.write_csv(lines, str(tmp_path / "csv"))
    assert [r.label for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()] == ["c", "b", "a"]
    whole = takeoff.to_dict(takeoff.ordered(lines).collect(), {"z": 1, "a": 2}, [], name="n")
    assert (whole["total_count"], whole["total_needs_review"], list(whole["connections"])) == (4, 1, ["a", "z"])
