import math
import random

import pytest
from pyspark.sql import functions as F

from quillspan.operators import fewshot, generator, graph, plansets, tiling
from quillspan.operators.grounding import LABELS
from tests.conftest import rows


def sheet(spark, *items):
    return spark.createDataFrame(items, "sheet_id string, full_width int, full_height int, tile_size int, overlap int")


def test_tiles_cover_and_cores_own(spark):
    got = tiling.tiles(sheet(spark, ("s", 4000, 3000, 1536, 256), ("small", 100, 50, 1536, 192), ("none", 0, 10, 5, 1), ("null", None, 10, 5, 1))).collect()
    assert {t.sheet_id for t in got} == {"s", "small"}
    own = [t for t in got if t.sheet_id == "s"]
    assert [(t.row, t.col, t.px_x, t.px_w) for t in sorted(own, key=lambda t: (t.row, t.col))][:3] == [(0, 0, 0, 1536), (0, 1, 1280, 1536), (0, 2, 2560, 1440)]
    for x, y in ((0.05, 0.05), (0.5, 0.5), (0.33, 0.02), (0.99, 0.99)):
        assert sum(t.core.x_min <= x <= t.core.x_max and t.core.y_min <= y <= t.core.y_max for t in own) == 1
    thin = tiling.tiles(sheet(spark, ("s", 12, 10, 5, 4))).collect()
    assert all(t.core.x_max > t.core.x_min for t in thin)


def test_plain_tiles_keep_slivers(spark):
    got = rows(tiling.plain_tiles(sheet(spark, ("s", 2000, 100, 1280, 128), ("one", 10, 10, 1280, 128))), "sheet_id", "px_x", "px_w")
    assert got == [("one", 0, 10), ("s", 0, 1280), ("s", 1152, 848)]


def test_detections_of_two_tiles_become_one(spark):
    tiles = tiling.tiles(sheet(spark, ("s", 4000, 3000, 1536, 256)))
    boxes = [("D1", 200, 200, 360, 360), ("D2", 1320, 100, 1480, 260), ("D3", 3000, 2000, 3160, 2160)]
    found = []
    for t in tiles.collect():
        for k, (_, x0, y0, x1, y1) in enumerate(boxes):
            if t.px_x <= x0 and x1 <= t.px_x + t.px_w and t.px_y <= y0 and y1 <= t.px_y + t.px_h:
                found.append((t.tile_id, "d", tuple(((v - o) / s) for v, o, s in ((x0, t.px_x, t.px_w), (y0, t.px_y, t.px_h), (x1, t.px_x, t.px_w), (y1, t.px_y, t.px_h))), 0.9, k))
    assert len(found) == 4
    df = spark.createDataFrame(found, "tile_id string, label string, bbox struct<x_min:double,y_min:double,x_max:double,y_max:double>, score double, ord int")
    got = tiling.sheet_detections(df, tiles).collect()
    assert sorted(len(r.tiles) for r in got) == [1, 1, 2]
    d2 = next(r for r in got if len(r.tiles) == 2)
    assert (d2.x_min, d2.y_max) == (pytest.approx(1320 / 4000, abs=1e-9), pytest.approx(260 / 3000, abs=1e-9))


def test_targets_on_tiles(spark):
    rng = random.Random(2)
    items = [("s", 0, f"e{k}", "Panelboard", tuple(sorted((rng.random(), rng.random()))), rng.choice([900, 1536, 4000, 5000])) for k in range(60)]
    df = spark.createDataFrame([(a, b, c, d, (x[0], x[0], x[1], x[1]), w, w) for a, b, c, d, x, w in items], "set_id string, sheet_ord int, entity_id string, label string, box struct<x_min:double,y_min:double,x_max:double,y_max:double>, full_width int, full_height int")
    want = []
    for _, _, e, _, (a, b), w in items:
        at = (a + b) / 2 * w
        n = 1 if w <= 1536 else math.ceil((w - 1536) / 1344) + 1
        own = [k for k in range(n) if k * 1344 <= at <= min(k * 1344 + 1536, w)]
        want += [(e, r, c) for r in own for c in own]
    got = tiling.assign(df)
    assert rows(got, "entity_id", "row", "col") == sorted(want, key=repr)
    lines = tiling.label_lines(got).collect()
    assert all(0 <= r.cx - r.w / 2 + 1e-9 and r.cx + r.w / 2 <= 1 + 1e-9 and r.class_index == LABELS.index("Panelboard") for r in lines)


NODE = "set_id string, sheet_ord int, view_ord int, ord int, entity_id string, label string, x double, y double"


def nodes(spark, items):
    return spark.createDataFrame([("s", 0, 0, k, f"n{k}", label, x, y) for k, (label, x, y) in enumerate(items)], NODE)


FIVE = [("Panelboard", 0.1, 0.1), ("Duplex Receptacle", 0.5, 0.5), ("Duplex Receptacle", 0.6, 0.5), ("Single-Pole Switch", 0.2, 0.8), ("Recessed Downlight", 0.3, 0.3)]


def test_candidates(spark):
    rng = random.Random(1)
    for items, k in ((FIVE, 2), ([(rng.choice(LABELS), rng.random(), rng.random()) for _ in range(40)], 8), (FIVE[:1], 8), ([FIVE[1]] * 4, 1)):
        want = set()
        for i, a in enumerate(items):
            near = sorted((j for j in range(len(items)) if j != i), key=lambda j: (math.hypot(items[j][1] - a[1], items[j][2] - a[2]), j))[:k]
            want |= {(min(i, j), max(i, j)) for j in near}
            want |= {(min(i, j), max(i, j)) for j in range(len(items)) if j != i and a[0] == "Panelboard"}
        got = rows(graph.candidates(nodes(spark, items), k=k), "entity_id_1", "entity_id_2")
        assert got == sorted(((f"n{a}", f"n{b}") for a, b in want), key=repr)


def test_features_labels_and_direction(spark):
    pairs = graph.candidates(nodes(spark, FIVE), k=8)
    turned = graph.candidates(nodes(spark, FIVE[::-1]), k=8)
    f = lambda df: sorted(tuple(round(v, 9) for v in r.features) for r in graph.pair_features(df).collect())
    assert f(pairs) == f(turned) and {len(x) for x in f(pairs)} == {23}
    edges = spark.createDataFrame([("s", 0, 0, 0, "n1", "n0", "home_run"), ("s", 0, 0, 1, "n4", "n3", "switch_leg"), ("s", 0, 0, 2, "n1", "n2", None)], "set_id string, sheet_ord int, view_ord int, conn_ord int, source_id string, target_id string, connection_type string")
    known = graph.labelled(pairs, edges)
    got = {(r.entity_id_1, r.entity_id_2): (r.edge_type, r.source_id, r.target_id) for r in known.withColumns(graph.oriented(F.col("edge_type"))).collect()}
    assert got["n0", "n1"] == ("home_run", "n1", "n0") and got["n3", "n4"] == ("switch_leg", "n3", "n4") and got["n1", "n2"] == ("none", "n1", "n2")
    assert rows(graph.class_weights(known)) == [("conductor", 10.0), ("home_run", 10.0), ("none", 10 / 8), ("switch_leg", 10.0)]


def test_edge_classifier(spark):
    pairs = graph.candidates(nodes(spark, [("Panelboard" if k % 7 == 0 else "Duplex Receptacle", (k * 37 % 101) / 101, (k * 53 % 97) / 97) for k in range(40)]), k=4)
    rows_ = graph.pair_features(pairs).withColumn("edge_type", F.when((F.col("label_1") == "Panelboard") | (F.col("label_2") == "Panelboard"), "home_run").otherwise("none"))
    model, kinds = graph.fit_edges(rows_, iterations=20)
    from pyspark.ml.functions import array_to_vector, vector_to_array

    scored = model.transform(rows_.withColumn("vector", array_to_vector("features")).withColumnRenamed("features", "f").withColumnRenamed("vector", "features"))
    found = graph.predicted_edges(scored.withColumnRenamed("edge_type", "true"), vector_to_array("probability"))
    judged = scored.join(found.select("entity_id_1", "entity_id_2", F.col("edge_type").alias("predicted")), ["entity_id_1", "entity_id_2"], "left").fillna("none", ["predicted"])
    scores = graph.edge_scores(judged).first()
    assert scores.f1_home_run > 0.95 and scores.f1_conductor == 0 and kinds[0] == "none"


def test_fewshot(spark, monkeypatch):
    df = spark.createDataFrame([(0, "A", [220.0, 20.0, 20.0]), (1, "A", [200.0, 10.0, 30.0]), (2, "B", [20.0, 200.0, 20.0]), (3, "B", [10.0, 220.0, 40.0])], "ord int, label string, vector array<double>")
    q = spark.createDataFrame([(0, [255.0, 0.0, 0.0]), (1, [0.0, 255.0, 0.0]), (2, [0.0, 0.0, 0.0])], "vec_id int, vector array<double>")
    protos = fewshot.prototypes(df)
    got = rows(fewshot.classify(q, protos))
    assert [r[1] for r in got] == ["A", "B", None] and got[0][2] > 0.9
    assert rows(fewshot.classify(q, protos.where("label = 'A'"), floor=0.9))[1][1] is None
    twins = protos.where("label = 'A'").unionByName(protos.where("label = 'A'").withColumns({"label": F.lit("Z"), "ord": F.lit(-1)}))
    assert rows(fewshot.classify(q, twins))[0][1] == "Z"
    monkeypatch.setattr(fewshot, "_BLOCK", 1)
    assert [r[:2] for r in rows(fewshot.classify(q, protos))] == [r[:2] for r in got]


def test_circuits(spark):
    devices = generator.scenes(spark, 30, seed=3, lights=12, receptacles=9)
    assert devices.count() == generator.scenes(spark, 30, seed=3, lights=12, receptacles=9).distinct().count()
    placed = generator.circuits(devices)
    by_model = {}
    for d in devices.collect():
        by_model.setdefault(d.model_id, []).append(d)
    want, loads = [], {}
    for model, own in by_model.items():
        number = 0
        for pool in (generator.RECEPTACLES, generator.LIGHTS):
            chunk, load = 0, None
            for d in sorted((d for d in own if d.label in pool), key=lambda d: (d.x, d.y)):
                va = generator._LOAD[d.label]
                if load is None or load + va > 1920 or chunk >= 12:
                    number, chunk, load = number + 1, 0, 0
                want.append((model, d.device_id, number, chunk, "AB"[(number - 1) % 2]))
                chunk, load = chunk + 1, load + va
                loads[model, number] = load
    assert rows(placed) == sorted(want, key=repr)
    got = generator.circuit_loads(devices, placed).collect()
    assert {(r.model_id, r.number): r.load_va for r in got} == loads and max(loads.values()) <= 1920
    kinds = generator.edges(placed).groupBy("connection_type").count().collect()
    assert {r.connection_type: r["count"] for r in kinds} == {"home_run": len(loads), "conductor": len(want) - len(loads)}
    assert generator.inconsistencies(devices, placed).count() == 0
    assert generator.inconsistencies(devices.where("room > 0"), placed).count() > 0
    one = generator.expected(devices, placed).where("model_id = 'm000000'").collect()
    assert sum(r.n for r in one if r.sheet == "plan" and r.kind == "entity") == len(by_model["m000000"]) + 1
    asked = {r.q_id: r.answer for r in generator.template_questions(devices, placed).collect()}
    assert asked["m000000-q-circuits"] == str(max(n for m, n in loads if m == "m000000"))


def test_listing(spark):
    html = """<a href="/bids/T2612-01%20Final%20Bid%20Plans.pdf">a</a><a HREF="spec.pdf"><a href="../x/T2612-02 drawings.PDF"><a href="../x/T2612-02 drawings.PDF">
    <a href="https://other.example/Plans&amp;More.pdf"><a href='no quotes plan.pdf'><a href="instructions plan.pdf">"""
    page = spark.createDataFrame([("m", "https://host.example/a/b/list?x=1", html), ("n", "https://host.example", None), ("n", None, "x")], "source string, url string, html string")
    got = rows(plansets.refs_in(page), "project", "url", "filename")
    assert got == sorted([
        ("T2612-01", "https://host.example/bids/T2612-01%20Final%20Bid%20Plans.pdf", "T2612-01_Final_Bid_Plans.pdf"),
        ("T2612-02", "https://host.example/a/x/T2612-02 drawings.PDF", "T2612-02_drawings.PDF"),
        ("Plans&More", "https://other.example/Plans&More.pdf", "Plans_More.pdf"),
    ], key=repr)


def test_index(spark):
    pages = spark.createDataFrame([(1, 0, "SHEET E-101", 1.0, 1.0), (1, 1, "A-2 none", 1.0, 1.0), (1, 2, "ED-201", 1.0, 1.0), (2, 0, None, 1.0, 1.0)], "ref_id int, page int, text string, width_pt double, height_pt double")
    records = plansets.page_records(pages)
    assert rows(records, "sheet_no", "discipline_letter", "discipline") == sorted([("E-101", "E", "electrical"), (None, None, None), ("ED-201", "ED", "electrical"), (None, None, None)], key=repr)
    refs = spark.createDataFrame([(1,), (2,), (3,)], "ref_id int")
    assert [(r.ref_id, r.n_pages, r.by_discipline) for r in plansets.set_records(refs, records).orderBy("ref_id").collect()] == [(1, 3, {"E": 1, "ED": 1}), (2, 1, None), (3, 0, None)]
    indexed = spark.createDataFrame([(p, k, 0, "E-1", "E") for k, p in enumerate("aaabbcdef")], "project string, ref_id int, page int, sheet_no string, discipline_letter string")
    assert [r.project for r in plansets.round_robin(indexed, letter="E", count=8).collect()] == list("abcdefab")
    with pytest.raises(ValueError):
        plansets.round_robin(indexed, letter="A", count=8)
    assert plansets.capped(indexed, cap=2).count() == 2
