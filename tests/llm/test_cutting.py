import random

import pytest

from quillspan.llm import cutting as C
from tests.conftest import rows

SHEET = "tiling_id bigint, full_width int, full_height int, tile_size int, overlap int, x_breaks array<int>, y_breaks array<int>, axis string, length string"


def sheets(spark, items):
    return spark.createDataFrame([(*i, "z", "z") for i in items], SHEET)


def natural(length, tile, overlap, breaks):
    """Can the axis be covered? Every end of a piece is tried."""
    ends, seen = {b for b in breaks or [] if b is not None and 0 < b < length}, set()
    todo = [0]
    while todo:
        start = todo.pop()
        if length - start <= tile and length - start > overlap:
            return True
        for e in ends:
            if overlap < e - start <= tile and e - overlap not in seen and e - overlap >= 0:
                seen.add(e - overlap)
                todo.append(e - overlap)
    return False


def cases(rng, n):
    out = []
    for k in range(n):
        tile = rng.choice([None, 0, -5, 10, 20, 40])
        breaks = lambda: rng.choice([None, [], [rng.randrange(-5, 130) for _ in range(rng.randrange(30))] + [None]])
        out.append((k, rng.choice([None, 0, -3, 5, 20, 60, 120]), rng.choice([1, 30, 100]), tile, rng.choice([None, 0, 3, 9, 10, -1, 25]), breaks(), breaks()))
    return out


@pytest.mark.parametrize("size", [1, 2, C.RANGE_STEPS, 1000])
def test_fit_and_pieces(spark, size):
    items = cases(random.Random(7), 300)
    df = sheets(spark, items + items[:50])
    want, axes = [], {}
    for k, w, h, t, o, xs, ys in items:
        o = o or 0
        for axis, length, breaks in (("x", w, xs), ("y", h, ys)):
            if length and t and length > t > 0 and 0 <= o < t:
                want.append((k, axis, "natural" if natural(length, t, o, breaks) else "forced"))
                axes[k, axis] = (length, t, o, {b for b in breaks or [] if b is not None})
    assert rows(C.axis_fits(df, range_steps=size)) == sorted(want, key=repr)
    got = {}
    for p in C.axis_pieces(df, range_steps=size).orderBy("tiling_id", "axis", "piece").collect():
        got.setdefault((p.tiling_id, p.axis), []).append(p)
    assert set(got) == set(axes)
    for key, pieces in got.items():
        length, tile, overlap, breaks = axes[key]
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        assert pieces[0].px_start == 0 and pieces[-1].px_end == length
        assert all(a.px_end - b.px_start == overlap for a, b in zip(pieces, pieces[1:]))
        assert all(overlap < p.px_end - p.px_start <= tile for p in pieces)
        # Each piece goes on to the farthest boundary in reach, whatever the ranges are.
        for p in pieces:
            reach = [b for b in {*breaks, length} if overlap < b <= length and p.px_start + overlap < b <= p.px_start + tile]
            assert p.px_end == (max(reach) if reach else p.px_start + tile)
        assert all((p.ends_at == "gutter") == (p.px_end in breaks) for p in pieces[:-1] if p.ends_at == "gutter") and pieces[-1].ends_at == "end"
        assert all(p.px_end - p.px_start == tile for p in pieces if p.ends_at == "limit")


def test_grid_of_both_axes(spark):
    df = sheets(spark, [(1, 25, 8, 10, 2, [9, 17], None), (2, 10, 10, 10, 0, [], []), (3, 25, None, 10, 0, [], [])])
    got = rows(C.sheet_pieces(df))
    assert got == [(1, 0, 0, 0, 0, 9, 8), (1, 0, 1, 7, 0, 10, 8), (1, 0, 2, 15, 0, 10, 8)]
    assert C.sheet_pieces(df.where("false")).count() == C.axis_fits(df.where("false")).count() == 0
    assert [r[0] for r in rows(C.axis_pieces(df), "tiling_id")].count(3) == 3


def test_axes_of_several_requests_and_of_no_id(spark):
    """Requests of one id or none have their own grids, not each other's."""
    items = [(12, 5, 10, 0, None, [7]), (5, 12, 10, 0, [7], None), (12, 5, 10, 0, [7], None), (12, 5, 10, 0, [7], None)]
    wanted = [(0, 0, 0, 0, 10, 5), (0, 1, 10, 0, 2, 5), (0, 0, 0, 0, 5, 10), (1, 0, 0, 10, 5, 2), (0, 0, 0, 0, 7, 5), (0, 1, 7, 0, 5, 5)]
    for key in (None, 1):
        got = rows(C.sheet_pieces(sheets(spark, [(key, *i) for i in items])))
        assert got == sorted(((key, *w) for w in wanted), key=repr)


def test_giant_axis(spark):
    """Far more ranges than one: pieces still follow each other without a gap."""
    length, breaks = 2_000_000_000, [k * 7_919_003 for k in range(1, 253)]
    df = sheets(spark, [(1, length, 1, 10_000_000, 1000, breaks, None)])
    pieces = C.axis_pieces(df, range_steps=6).orderBy("piece").collect()
    assert pieces[-1].px_end == length and all(p.ends_at == "gutter" for p in pieces[:-1])
    assert rows(C.axis_fits(df)) == [(1, "x", "natural")]


def test_a_giant_axis_has_no_giant_row(spark):
    """An axis of many ranges, with a gap of a hundred thousand forced cuts and gutters on either side of it."""
    breaks = [*range(700, 50_000, 700), *range(90_000_000, 90_050_000, 900)]
    df = sheets(spark, [(1, 90_100_000, 10, 1000, 100, breaks, None)])
    axes = C._identified(df, whole=False)
    ranges = C._ranges(axes, C.RANGE_STEPS)
    assert ranges.count() > 25 and ranges.selectExpr("max(size(bounds) + size(halo)) AS n").first().n <= 10
    runs = C._runs(axes, C.RANGE_STEPS)
    assert runs.where("n > 1000").count() == 1
    got = C.axis_pieces(df).selectExpr("count(*) AS n", "count(DISTINCT piece) AS k", "max(piece) AS last", "max(px_end - px_start) AS longest", "count_if(ends_at = 'limit') AS forced").first()
    assert got.n == got.k == got.last + 1 > 99_000 and got.longest == 1000 and got.forced > 99_000
