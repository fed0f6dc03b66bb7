import math

import pytest
from pyspark.sql import functions as F

from quillspan.functions import geometry as G
from quillspan.functions import text as X
from quillspan.operators import boards


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def of(spark, f, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r.v for r in df.select(f(F.col("t")).alias("v")).collect()]


def test_scales(spark):
    a, b, c, d, e = of(spark, X.parse_scale, "1/4\" = 1'-0\"", "1\" = 20'", "1 : 50", "1 1/2\" = 1'-0\"", "SCALE 3/32\" = 1'-6\"")
    assert (a.ratio, a.real_world_unit, a.confidence) == (0.25 / 12, "ft", 0.99)
    assert b.ratio == pytest.approx(1 / 240) and d.ratio == pytest.approx(1.5 / 12) and e.ratio == pytest.approx(3 / 32 / 18)
    assert (c.ratio, c.real_world_unit, c.raw) == (0.02, "m", "1 : 50")
    assert of(spark, X.parse_scale, "NTS", "1:50 not to scale", "just some words", "", None, "1:0") == [None] * 6
    assert value(spark, X.px_per_unit(F.lit(0.25 / 12), F.lit("ft"), F.lit(300.0))) == 75
    assert of(spark, X.extract_scale, "1:20 SCALE: 1:50")[0].ratio == 0.02


def test_sheet_numbers_and_callouts(spark):
    assert of(spark, X.parse_sheet_number, "SHEET A-101", "E201 POWER PLAN", "S-1\nA-100 x\nsheet M-200b", "none", "") == ["A-101", "E-201", "M-200b", None, None]
    assert of(spark, X.cross_references, "see detail 3/A-501 and section A/S-101, 3/A-501") == [[("3", "A-501"), ("A", "S-101")]]
    assert of(spark, X.discipline_for_letter, "E", "e", "Z", None) == ["electrical", "electrical", None, None]
    assert tuple(of(spark, X.title_block, "SHEET E-201 SCALE: 1:50")[0]) == ("E-201", "electrical", "1:50")


def test_names_versions_and_lengths(spark):
    names = ["T2612-01 Final Bid Plans.pdf", "Drawings.pdf", "Project Spec plans.pdf", "IFB.pdf", "Addendum 1 drawings.pdf", "Inspection plan.pdf"]
    assert of(spark, X.is_drawing_set, *names) == [True, True, False, False, False, False]
    assert of(spark, X.project_code, names[0], "Drawings.final.pdf", ".pdf") == ["T2612-01", "Drawings.final", ".pdf"]
    assert of(spark, X.sanitized, "a%20b (1)+c.pdf", "__x__") == ["a_b_1_c.pdf", "x"]
    assert of(spark, X.readable_version, "0.2.0", "99.0.0", "0.2", "x", None) == [True, False, False, False, False]
    assert tuple(value(spark, X.feet_inches(F.lit(10.5)))) == ("10'-6\"", 126 * 25.4)
    assert of(spark, X.norm_text, "  A  b\n", "") == ["a b", ""]
    assert of(spark, X.singular, "doors", "gas", "bus") == ["door", "gas", "bus"]
    assert of(spark, X.json_within, 'so: {"a": 1} ok', "{a", "") == ['{"a": 1}', None, None]
    line = lambda m, v, c: value(spark, X.format_value(F.lit(m), F.lit(v), F.lit(c)))
    assert (line("detection_map", 0.5, 0.0), line("counting_mape", 5.0, 1.0), line("chamfer_distance", 0.1, 0.0)) == ("50.0%", "5.0% +/-1.0", "0.1000")


def test_geometry(spark):
    box = lambda a, b, c, d: G.box(*[F.lit(float(v)) for v in (a, b, c, d)])
    assert value(spark, G.iou(box(0, 0, 2, 2), box(1, 1, 3, 3))) == pytest.approx(1 / 7)
    assert value(spark, G.iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0
    assert value(spark, G.area(box(1, 0, 0, 1))) == 0
    p = lambda *xy: F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in xy])
    assert value(spark, G.shoelace(p((0, 0), (1, 0), (0, 1)))) == 0.5
    circle = G.shape("circle", p((1, 1)), F.lit(-0.5))
    assert tuple(value(spark, G.bounds(circle))) == (0.5, 0.5, 1.5, 1.5)
    assert tuple(value(spark, G.bounds(G.shape("circle", p((1, 1)))))) == (1, 1, 1, 1)
    assert value(spark, G.bounds(G.shape("polygon", F.array().cast("array<struct<x:double,y:double>>")))) is None
    assert tuple(value(spark, G.normalized(F.lit(0.0), F.lit(20.0), box(0, 0, 10, 20), flip_y=True))) == (0, 0)
    arc = value(spark, G.arc_points(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(270.0), F.lit(90.0)))
    assert len(arc) == 24 and arc[-1].y == pytest.approx(1) and min(q.x for q in arc) == pytest.approx(0, abs=1e-9)
    assert len(value(spark, G.circle_points(F.lit(0.0), F.lit(0.0), F.lit(1.0)))) == 32
    assert [tuple(q) for q in value(spark, G.without_repeats(p((0, 0), (0, 0), (1, 1), (0, 0))))] == [(0, 0), (1, 1), (0, 0)]
    tile = box(0.2, 0.2, 0.6, 0.4)
    assert tuple(value(spark, G.to_tile(tile, G.to_sheet(tile, box(0.1, 0.2, 0.3, 0.4))))) == pytest.approx((0.1, 0.2, 0.3, 0.4))
    grid = value(spark, G.centred_grid(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(5)))
    assert len(grid) == 5 and (grid[0].x, grid[0].y) == (0.25, pytest.approx(1 / 3))
    assert value(spark, G.contains(box(0, 0, 1, 1), F.lit(1.0), F.lit(0.0)))
    assert value(spark, G.distance(G.point(F.lit(0), F.lit(0)), G.point(F.lit(3), F.lit(4)))) == 5


def test_seeds(spark):
    df = spark.createDataFrame([("m", 0.8), ("m", 0.9), ("m", 1.0), ("one", 0.5)], "k string, value double")
    got = {r.k: r for r in boards.over_seeds(df, ["k"]).collect()}
    assert got["m"].ci95 == pytest.approx(4.303 * 0.1 / math.sqrt(3)) and got["m"].n == 3
    assert (got["one"].std, got["one"].ci95) == (0, 0)


def test_addresses_and_pixels(spark):
    urls = ["http://localhost:8000/x", "https://127.0.0.1", "http://[::1]:9/", "http://127.0.0.1.example", "http://example/?u=http://localhost", "http://localhost@example/", "localhost", None]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "k int, u string")
    assert [r.b for r in df.orderBy("k").select(X.is_loopback(F.col("u")).alias("b")).collect()] == [True, True, True, False, False, False, False, False]
    b = spark.createDataFrame([((0.019, -0.2, 0.125, 1.7),), ((0.5, 0.5, 0.5, 0.5),)], "b struct<x_min:double,y_min:double,x_max:double,y_max:double>")
    assert [tuple(r.p) for r in b.select(G.pixel_box(F.col("b"), F.lit(100), F.lit(50)).alias("p")).collect()] == [(1, 0, 12, 50), (50, 25, 50, 25)]
    assert [r.v for r in b.select(G.extent_is_valid(F.col("b")).alias("v")).collect()] == [True, False]
