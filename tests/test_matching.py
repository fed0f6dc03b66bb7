"""Matching and metrics against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.functions import geometry as G
from quillspan.operators import matching, metrics
from tests.conftest import rows

BOX = "struct<x_min:double,y_min:double,x_max:double,y_max:double>"
JUDGED = f"doc string, ord bigint, entity_id string, entity_type string, label string, conf double, box {BOX}, geometry {G.GEOMETRY}, attributes string, text_spans array<struct<text:string>>, dimensions array<struct<value_mm:double>>"


def item(doc, k, label, b, conf=0.9, kind="symbol", shape=None, attributes=None, texts=(), dims=()):
    return (doc, k, f"{doc}{k}", kind, label, conf, b, shape, attributes, [(t,) for t in texts], [(d,) for d in dims])


def frame(spark, items):
    return spark.createDataFrame(items, JUDGED)


def value(df):
    return df.first().value


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    area = lambda q: max(q[2] - q[0], 0) * max(q[3] - q[1], 0)
    union = area(a) + area(b) - both
    return both / union if union > 0 else 0


def greedy(left, right, t, by_conf, latest):
    used, out = set(), []
    for p in sorted(left, key=(lambda p: (-p[5], p[1])) if by_conf else (lambda p: p[1])):
        best, at = (t if latest else 0.0), None
        for g in sorted(right, key=lambda g: g[1]):
            if (g[0], g[1]) in used or g[0] != p[0] or g[4] != p[4]:
                continue
            v = iou(p[6], g[6])
            if v >= best if latest else v > best:
                best, at = v, g
        if at is not None and best >= t:
            used.add((at[0], at[1]))
            out.append((p[0], p[4], p[1], at[1]))
    return sorted(out, key=repr)


def crowd(rng, n, spread):
    out = []
    for k in range(n):
        x, y, s = rng.randrange(spread) / 20, rng.randrange(spread) / 20, rng.choice([0.1, 0.1, 0.15, 0.3])
        out.append(item(rng.choice("ab"), k, rng.choice(["u", "v"]), (x, y, x + s, y + rng.choice([0.1, s])), rng.choice([0.5, 0.7, 0.9])))
    return out


@pytest.mark.parametrize(("by_conf", "latest", "t"), [(True, False, 0.5), (False, False, 0.5), (True, True, 0.5), (True, False, 0.25)])
def test_greedy_match(spark, by_conf, latest, t):
    rng = random.Random(f"{by_conf}{latest}{t}")
    left, right = crowd(rng, 120, 12), crowd(rng, 120, 12)
    got = matching.greedy_match(frame(spark, left), frame(spark, right), ["doc", "label"], threshold=t, by_confidence=by_conf, latest=latest)
    assert rows(got, "doc", "label", "left_ord", "right_ord") == greedy(left, right, t, by_conf, latest)


def test_grid_finds_all_pairs(spark):
    rng = random.Random(1)
    far = lambda k: item("a", k, "u", (x := rng.uniform(-3, 3), y := rng.uniform(-3, 3), x + rng.uniform(0.01, 2), y + rng.uniform(0.01, 2)))
    left, right = [far(k) for k in range(80)], [far(k) for k in range(80)]
    for t in (0.1, 0.5, 0.9):
        got = matching.overlapping(frame(spark, left), frame(spark, right), ["doc"], t)
        assert rows(got, "left_ord", "right_ord") == sorted(((p[1], g[1]) for p in left for g in right if iou(p[6], g[6]) >= t), key=repr)


def voc(scored, n_true):
    scored = sorted(scored, key=lambda s: -s[0])
    tp = np.cumsum([h for _, h in scored])
    if not n_true or not len(scored):
        return 0.0
    precision = tp / np.arange(1, len(tp) + 1)
    envelope = np.maximum.accumulate(precision[::-1])[::-1]
    return float(sum(e for e, (_, h) in zip(envelope, scored) if h) / n_true)


def test_detection_map_and_panoptic(spark):
    rng = random.Random(5)
    pred, true = crowd(rng, 150, 12), crowd(rng, 120, 12)
    hits = set(greedy(pred, true, 0.5, True, False))
    aps = []
    for label in ("u", "v"):
        own = [(p[5], any(h[:3] == (p[0], label, p[1]) for h in hits)) for p in sorted(pred, key=lambda p: (p[0], p[1])) if p[4] == label]
        aps.append(voc(own, sum(g[4] == label for g in true)))
    p, t = frame(spark, pred), frame(spark, true)
    assert value(metrics.detection_map(p, t)) == pytest.approx(np.mean(aps), abs=1e-12)
    order = greedy(pred, true, 0.5, False, False)
    s = sum(iou(next(p[6] for p in pred if (p[0], p[1]) == (d, a)), next(g[6] for g in true if (g[0], g[1]) == (d, b))) for d, _, a, b in order)
    assert value(metrics.panoptic_quality(p, t)) == pytest.approx(s / (len(order) + (len(pred) + len(true) - 2 * len(order)) / 2))
    assert value(metrics.detection_map(t, t)) == 1
    assert value(metrics.detection_map(p.where("false"), t)) == value(metrics.detection_map(p, t.where("false"))) == 0
    one = [item("a", 0, "x", (0.0, 0.0, 0.1, 0.1)), item("a", 1, "x", (0.5, 0.5, 0.6, 0.6))]
    assert value(metrics.detection_map(frame(spark, one[:1]), frame(spark, one))) == 0.5


def test_counts_texts_and_dimensions(spark):
    b = (0.0, 0.0, 0.1, 0.1)
    true = frame(spark, [item("a", k, "x", b) for k in range(3)] + [item("a", 9, "q", b, attributes='{"quantity": 5}'), item("a", 10, "s", b, attributes='{"quantity": "5"}'), item("a", 11, "t", b, attributes='{"quantity": true}')])
    pred = frame(spark, [item("a", 0, "x", b)])
    assert rows(metrics.class_counts(true)) == [("a", "q", 5), ("a", "s", 1), ("a", "t", 1), ("a", "x", 3)]
    assert value(metrics.counting_mape(pred, true.where("label = 'x'"))) == pytest.approx(200 / 3)
    assert value(metrics.counting_exact_match(pred, true.where("label = 'x'"))) == 0
    texts = frame(spark, [item("a", 0, "x", b, texts=("A  b", "a b", "c"), dims=(10.0, 10.5, None, 99.0))])
    assert value(metrics.ocr_exact_match(texts, texts)) == value(metrics.dimension_accuracy(texts, texts)) == 1
    fewer = frame(spark, [item("a", 0, "x", b, texts=("a b",), dims=(11.2, 10.9))])
    assert value(metrics.ocr_exact_match(fewer, texts)) == pytest.approx(1 / 3)
    assert value(metrics.dimension_accuracy(fewer, texts)) == pytest.approx(2 / 3)
    assert value(metrics.dimension_accuracy(fewer, texts.where("false"))) == 0


def shape(*points):
    return ("polygon", list(points), None, None, None)


def test_walls_points_and_loops(spark):
    b = (0.0, 0.0, 1.0, 1.0)
    square = lambda a, c: shape((a, a), (c, a), (c, c), (a, c))
    true = frame(spark, [item("a", 0, "x", b, kind="wall", shape=square(0.0, 0.5)), item("b", 1, "Room 1", b, shape=square(0.0, 1.0)), item("c", 2, "x", b, shape=square(0.0, 1.0))])
    pred = frame(spark, [item("a", 0, "x", b, kind="wall", shape=square(0.0, 0.25)), item("a", 1, "wall", b, shape=square(0.0, 0.125))])
    assert value(metrics.external_wall_iou(true, true)) == 1
    assert value(metrics.external_wall_iou(pred, true)) == pytest.approx((0.25 + 0) / 2)
    assert value(metrics.chamfer_distance(true, true)) == 0
    moved = frame(spark, [item("a", 0, "x", b, shape=shape((0.0, 0.1), (0.5, 0.1)))])
    p, g = np.array([(0, 0.1), (0.5, 0.1)]), np.array([(0, 0), (0.5, 0), (0.5, 0.5), (0, 0.5)])
    d = np.hypot(*(p[:, None] - g[None]).transpose(2, 0, 1))
    assert value(metrics.chamfer_distance(moved, true)) == pytest.approx(d.min(1).mean() + d.min(0).mean())
    loops = frame(spark, [item("a", 0, "x", b, shape=shape((0.0, 0.0), (1.0, 0.0), (0.0, 1.0))), item("a", 1, "x", b, shape=shape((0.0, 0.0), (1.0, 1.0), (2.0, 2.0))), item("a", 2, "x", b, shape=shape((0.0, 0.0)))])
    assert value(metrics.loop_closure_validity(loops)) == pytest.approx(1 / 3)


EDGE = "doc string, ord bigint, source_id string, target_id string, directed boolean, conf double"


@pytest.mark.parametrize(("directed", "turned", "expected"), [(False, True, 1), (True, False, 1), (True, True, 0)])
def test_edges(spark, directed, turned, expected):
    nodes = frame(spark, [item("a", 0, "x", (0.0, 0.0, 0.1, 0.1)), item("a", 1, "x", (0.5, 0.5, 0.6, 0.6))])
    true = spark.createDataFrame([("a", 0, "a0", "a1", directed, None)], EDGE)
    pred = spark.createDataFrame([("a", 0, *(("a1", "a0") if turned else ("a0", "a1")), True, None)], EDGE)
    assert value(metrics.graph_edge_ap(nodes, pred, nodes, true)) == expected


def test_edges_are_used_once(spark):
    nodes = frame(spark, [item("a", k, "x", (k / 5, 0.0, k / 5 + 0.1, 0.1)) for k in range(3)])
    true = spark.createDataFrame([("a", 0, "a0", "a1", True, None), ("a", 1, "a1", "a0", False, None)], EDGE)
    pred = spark.createDataFrame([("a", k, "a0", "a1", True, 0.9 - k / 10) for k in range(3)] + [("a", 9, "a0", "lost", True, 0.1)], EDGE)
    got = metrics.edge_scores(nodes, pred, nodes, true)
    assert rows(got, "ord", "hit") == [(0, 1), (1, 1), (2, 0), (9, 0)]


def test_answers_and_requests(spark):
    doc = lambda *m: spark.createDataFrame([("a", x) for x in m], "doc string, metadata string")
    true = doc('{"qa_pairs": [{"q_id": 1, "answer": "Two "}, {"q_id": "2", "answer": "x"}]}')
    pred = doc('{"qa_pairs": [{"q_id": "1", "answer": "no"}, {"q_id": 1, "answer": "two"}]}')
    assert value(metrics.qa_accuracy(pred, true)) == 0.5
    full = '{"rfi": {"cited_clause": "c", "evidence": ["e"], "conflict": "x", "question": "q"}}'
    half = '{"rfi": {"cited_clause": "", "evidence": [], "conflict": "x", "question": true}}'
    assert [value(metrics.rfi_reward(doc(m))) for m in (full, half, "{}")] == [1, 0.5, 0]


def test_suppression(spark):
    rng = random.Random(3)
    found = [("s", rng.choice("uv"), k, rng.choice([0.5, 0.7, 0.9]), f"t{rng.randrange(3)}", x := rng.randrange(6) / 20, y := rng.randrange(6) / 20, x + 0.1, y + 0.1) for k in range(80)]
    schema = "sheet string, label string, ord bigint, conf double, tile_id string, x_min double, y_min double, x_max double, y_max double"
    want = []
    for label in "uv":
        kept = []
        for f in sorted((f for f in found if f[1] == label), key=lambda f: (-f[3], f[2])):
            twin = next((k for k in kept if iou(k[0][5:], f[5:]) >= 0.3), None)
            if twin is None:
                kept.append((f, [f[4]]))
            elif f[4] not in twin[1]:
                twin[1].append(f[4])
        want += [(label, f[2], tiles) for f, tiles in kept]
    got = matching.suppress(spark.createDataFrame(found, schema), ["sheet", "label"], threshold=0.3)
    assert rows(got, "label", "ord", "tiles") == sorted(want, key=repr)
    assert rows(got.select(F.col("tiles"))) != []


def test_precision_over_many_ranges_of_one_confidence(spark, monkeypatch):
    """All predictions of one label and confidence: their order is that of documents, in however many ranges."""
    monkeypatch.setattr(metrics, "ROWS_PER_RANGE", 7)
    rng = random.Random(3)
    rows_ = [("x", f"d{k // 9:02}", k % 9, 1.0 if k < 70 else 0.5, int(rng.random() < 0.4)) for k in range(100)]
    n = sum(h for *_, h in rows_) + 5
    hits, best, total = 0, [], 0.0
    for k, r in enumerate(sorted(rows_, key=lambda r: (-r[3], r[1], r[2])), 1):
        hits += r[4]
        best.append((hits / k, r[4]))
    for k, (_, hit) in enumerate(best):
        total += hit * max(p for p, _ in best[k:])
    df = spark.createDataFrame(rows_, "label string, doc string, ord int, conf double, hit int").repartition(3)
    got = metrics.average_precision(df, spark.createDataFrame([("x", n), ("y", 2)], "label string, n_true bigint"))
    assert {r.label: r.ap for r in got.collect()} == pytest.approx({"x": total / n, "y": 0.0})


def test_nearest_points_far_apart_and_dense(spark):
    rng = random.Random(9)
    points = lambda n, at, size: [(at + rng.random() * size, at + rng.random() * size) for _ in range(n)]
    sides = {"p": points(40, 0, 1) + points(3, 50, 1) + [(0.5, 0.5)] * 4, "t": points(60, 0, 0.1) + points(2, -30, 1)}
    frame = lambda k: spark.createDataFrame([("d", i, ("polyline", [p])) for i, p in enumerate(sides[k])], "doc string, ord int, geometry struct<type:string,points:array<struct<x:double,y:double>>>")
    way = lambda a, b: np.mean([min(np.hypot(x - u, y - v) for u, v in b) for x, y in a])
    want = way(sides["p"], sides["t"]) + way(sides["t"], sides["p"])
    assert metrics.chamfer_distance(frame("p"), frame("t")).first().value == pytest.approx(want)
    assert metrics.chamfer_distance(frame("p"), frame("t").where("false")).first().value == 0
