"""Splitting oversized items at natural boundaries, by ranges of offsets.

An axis of an item is covered by ranges of a few full steps each. A range has the boundaries found in it and, as its
halo, those within a step behind it; from each boundary by which it may be entered it finds where it is left again.
The tables of entries and exits, which hold what is within a step of a range's beginning and nothing else, are
stitched in the order of ranges. Each range then emits its cuts from its own entry, and running sums of the ranges'
numbers of cuts give the pieces their numbers. Where no boundary is in reach, cuts are made a full step apart; such a
run is one row (begin, count) until it is emitted, and the boundary before it is a cut in any case, so the range
behind it knows its entry alone. No task needs a whole item, and the cuts don't depend on the size of the ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.common import cut

RANGE_STEPS = 4  # full steps a range

_KEY = ["tiling_id", "axis", "length", "tile", "overlap", "request"]


def _axes(sheets: DataFrame, *, whole: bool, paired: bool = False) -> DataFrame:
    """Valid axes, one row each: those above the limit, and if ``whole`` also those that fit.

    ``request`` tells apart axes of equal key but other breaks; if ``paired`` it is one hash for both axes of a sheet.
    """
    axis = lambda name, length, breaks: F.struct(F.lit(name).alias("axis"), F.col(length).cast("long").alias("length"), F.col(breaks).alias("breaks"))
    rows = sheets.select(
        "tiling_id",
        F.col("tile_size").cast("long").alias("tile"),
        F.coalesce(F.col("overlap"), F.lit(0)).cast("long").alias("overlap"),
        F.explode(F.array(axis("x", "full_width", "x_breaks"), axis("y", "full_height", "y_breaks"))).alias("a"),
        F.xxhash64(F.to_json(F.struct("full_width", "full_height", "tile_size", "overlap", "x_breaks", "y_breaks"))).alias("sheet"),
    ).select("tiling_id", "a.axis", "a.length", "tile", "overlap", "a.breaks", "sheet")
    rows = rows.where((F.col("tile") > 0) & (F.col("overlap") >= 0) & (F.col("overlap") < F.col("tile")) & (F.col("length") > 0))
    if not whole:
        rows = rows.where(F.col("length") > F.col("tile"))
    inside = F.filter(F.coalesce(F.col("breaks"), F.array().cast("array<int>")), lambda b: (b > F.col("overlap")) & (b < F.col("length")))
    inside = F.array_sort(F.array_distinct(F.transform(inside, lambda b: b.cast("long"))))
    return rows.withColumn("breaks", inside).withColumn("request", F.col("sheet") if paired else F.xxhash64("breaks")).drop("sheet").distinct()


_ID = "id string, range bigint"
_TABLE = f"{_ID}, known boolean, entries array<bigint>, exits array<bigint>, lasts array<bigint>"
_ENTRY = f"{_ID}, entry bigint, came_from bigint"
_RUNS = f"{_ID}, nth bigint, prev bigint, at bigint, n bigint, natural boolean"


def _ranges(axes: DataFrame, range_steps: int) -> DataFrame:
    """(id, range, step, first range?, bounds, halo, before) of each range that has a boundary.

    The end of the axis is a boundary, and so is where the first piece's reach begins (the overlap). ``before`` is the
    last boundary of the ranges before.
    """
    step = F.col("tile") - F.col("overlap")
    at = F.explode(F.concat(F.array("overlap"), "breaks", F.array("length")))
    found = axes.where(F.col("length") > F.col("tile")).select("id", step.alias("step"), "overlap", at.alias("at"))
    size = F.col("step") * range_steps
    own = F.floor((F.col("at") - F.col("overlap")) / size)
    # A boundary within a step of its range's beginning is of the halo of the range before as well.
    near = (F.col("at") - F.col("overlap")) - own * size <= F.col("step")
    each = found.withColumn("own", own).withColumn("range", F.explode(F.when(near & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))))
    is_own = F.col("range") == F.col("own")
    rows = each.groupBy("id", "range").agg(
        F.first("step").alias("step"), F.array_sort(F.collect_list(F.when(is_own, F.col("at")))).alias("bounds"), F.array_sort(F.collect_list(F.when(~is_own, F.col("at")))).alias("halo")
    ).where(F.size("bounds") > 0)
    order = Window.partitionBy("id").orderBy("range")
    last = rows.select("id", "range", F.lag(F.element_at("bounds", -1)).over(order).alias("before"))
    return cut(rows.join(last, ["id", "range"]))


def _enter(marks: np.ndarray, before: int | None, step: int) -> tuple[int, int, int] | None:
    """Index of the first cut, the begin and the count of the forced run before it, of a range behind a gap."""
    n = -(-(int(marks[0]) - before) // step) - 1
    return (int(np.searchsorted(marks, before + n * step + step, side="right")) - 1, before, n) if n > 0 else None


def _follow(marks: np.ndarray, own: int, step: int, k: int) -> tuple[list[tuple[int, int, int]], int | None]:
    """Cuts from the own boundary ``k`` on, and the index of the halo's boundary that is cut next.

    A cut is (index, begin of the forced run before it, its count). None if the range ends at a gap or the axis ends.
    """
    cuts = [(k, 0, 0)]
    while True:
        after = int(np.searchsorted(marks, marks[k] + step, side="right")) - 1
        run = (0, 0)
        if after == k:  # none in reach
            if k + 1 >= own:
                return cuts, None
            n = -(-int(marks[k + 1] - marks[k]) // step) - 1
            run = (int(marks[k]), n)
            after = int(np.searchsorted(marks, marks[k] + n * step + step, side="right")) - 1
        if after >= own:
            # Behind a gap the halo's boundary is cut from a forced cut in this range.
            return cuts + ([(-1, *run)] if run[1] else []), after
        cuts.append((after, *run))
        k = after


def _ranged(batch: pa.RecordBatch) -> Iterator[tuple]:
    get = {n: batch.column(n).to_pylist() for n in batch.schema.names}
    for k in range(batch.num_rows):
        marks = np.array(get["bounds"][k] + get["halo"][k], dtype=np.int64)
        yield {n: v[k] for n, v in get.items()}, marks, len(get["bounds"][k]), get["step"][k]


def _last_cut(marks: np.ndarray, cuts: list[tuple[int, int, int]], step: int) -> int:
    k, begin, n = cuts[-1]
    return int(marks[k]) if k >= 0 else begin + n * step


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where a range is left, and its last cut, for each boundary by which it may be entered."""
    for batch in batches:
        out = []
        for row, marks, own, step in _ranged(batch):
            start = row["before"] is None
            gap = None if start else _enter(marks, row["before"], step)
            known = start or gap is not None
            entries = [gap[0]] if gap else [0] if start else range(int(np.searchsorted(marks[:own], row["before"] + step, side="right")))
            exits, lasts = [], []
            for e in entries:
                if e >= own:  # cut by its forced run only
                    exits.append(int(marks[e]))
                    lasts.append(gap[1] + gap[2] * step)
                    continue
                cuts, after = _follow(marks, own, step, e)
                exits.append(None if after is None else int(marks[after]))
                lasts.append(_last_cut(marks, cuts, step))
            out.append((row["id"], row["range"], known, [int(marks[e]) for e in entries], exits, lasts))
        yield _batch(out, _TABLE)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of the ranges of each axis, which come in order: a range is entered where the one before was left."""
    axis = entry = came = None
    for batch in batches:
        out = []
        for i, r, known, entries, exits, lasts in zip(*[c.to_pylist() for c in batch.columns]):
            if i != axis:
                axis, entry = i, None
            k = 0 if known else entries.index(entry)
            if not known:
                out.append((i, r, entry, came))
            entry, came = exits[k], lasts[k]
        yield _batch(out, _ENTRY)


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cuts of each range from its entry, forced runs as one row."""
    for batch in batches:
        out = []
        for row, marks, own, step in _ranged(batch):
            start = row["before"] is None
            gap = None if start else _enter(marks, row["before"], step)
            nth, prev = 0, row["came_from"]
            if gap:
                e, prev = gap[0], gap[1] + gap[2] * step
                out.append((row["id"], row["range"], 0, gap[1], gap[1] + step, gap[2], False))
                nth = gap[2]
            else:
                e = 0 if start else int(np.searchsorted(marks[:own], row["entry"]))
            cuts = _follow(marks, own, step, e)[0] if e < own else []
            for k, begin, n in cuts:
                if n:
                    out.append((row["id"], row["range"], nth, begin, begin + step, n, False))
                    nth, prev = nth + n, begin + n * step
                if k >= 0:
                    if not (start and k == 0):
                        out.append((row["id"], row["range"], nth, prev, int(marks[k]), 1, True))
                        nth += 1
                    prev = int(marks[k])
        yield _batch(out, _RUNS)


def _runs(axes: DataFrame, range_steps: int) -> DataFrame:
    """(id, range, nth, prev, at, n, natural): cuts of the axes above their limit, numbered within their range."""
    ranges = _ranges(axes, range_steps)
    tables = ranges.select("id", "range", "step", "bounds", "halo", "before").mapInArrow(_tables, _TABLE)
    entries = tables.repartition("id").sortWithinPartitions("id", "range").mapInArrow(_stitch, _ENTRY)
    return ranges.join(entries, ["id", "range"], "left").select("id", "range", "step", "bounds", "halo", "before", "entry", "came_from").mapInArrow(_emit, _RUNS)


def _identified(sheets: DataFrame, **options) -> DataFrame:
    """Axes with an ``id``: a hash of all that tells them apart, by which ranges are shuffled."""
    return _axes(sheets, **options).withColumn("id", F.md5(F.to_json(F.struct(*_KEY))))


def axis_fits(sheets: DataFrame, *, range_steps: int = RANGE_STEPS) -> DataFrame:
    """(tiling_id, axis, fit) of every axis above its limit: ``natural`` if no cut had to be made between boundaries.

    No case: null or non-positive lengths or limits, negative overlaps or overlaps not below the limit. A null overlap
    is 0. Boundaries that are null, repeated, out of order or out of range are put in order or left out. Rows
    delivered twice count once; an empty table gives an empty result; further columns are ignored.
    """
    axes = cut(_identified(sheets, whole=False))
    fits = _runs(axes, range_steps).groupBy("id").agg(F.when(F.bool_and("natural"), "natural").otherwise("forced").alias("fit"))
    return axes.join(fits, "id").select("tiling_id", "axis", "fit").distinct()


def axis_pieces(sheets: DataFrame, *, range_steps: int = RANGE_STEPS, whole: bool = False) -> DataFrame:
    """(tiling_id, axis, length, tile, overlap, piece, px_start, px_end, ends_at) of every axis above its limit.

    Pieces are numbered from 0 and follow each other; each is at most the limit, consecutive ones share exactly the
    overlap, and each goes on to the farthest boundary in reach. ``ends_at`` is ``gutter``, ``limit`` (no gutter in
    reach) or ``end``. With ``whole`` also axes that fit, as one piece. The same cases as in ``axis_fits`` are left out.
    """
    return _pieces(sheets, range_steps, whole=whole).drop("request")


def _pieces(sheets: DataFrame, range_steps: int, *, whole: bool, paired: bool = False) -> DataFrame:
    axes = cut(_identified(sheets, whole=whole, paired=paired))
    runs = cut(_runs(axes, range_steps))
    order = Window.partitionBy("id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.groupBy("id", "range").agg(F.sum("n").alias("n")).select("id", "range", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("start"))
    each = runs.join(starts, ["id", "range"]).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    step = (F.col("tile") - F.col("overlap")) * F.col("j")
    end = F.col("at") + step
    cuts = axes.drop("breaks").join(each, "id").select(
        *_KEY,
        (F.col("start") + F.col("nth") + F.col("j")).cast("int").alias("piece"),
        (F.col("prev") + step - F.col("overlap")).cast("int").alias("px_start"),
        end.cast("int").alias("px_end"),
        F.when(end == F.col("length"), "end").when(F.col("natural"), "gutter").otherwise("limit").alias("ends_at"),
    )
    if not whole:
        return cuts
    one = axes.where(F.col("length") <= F.col("tile"))
    return cuts.unionByName(one.select(*_KEY, F.lit(0).alias("piece"), F.lit(0).alias("px_start"), F.col("length").cast("int").alias("px_end"), F.lit("end").alias("ends_at")))


def sheet_pieces(sheets: DataFrame, *, range_steps: int = RANGE_STEPS) -> DataFrame:
    """(tiling_id, row, col, px_x, px_y, px_w, px_h) of every sheet above its limit on at least one axis.

    Sheets of which one axis has no valid length have no area and give no pieces here (``axis_pieces`` has the other).
    Axes are those of one request, also where several have one id, or none: pieces without an id are kept under null.
    """
    one = _pieces(sheets, range_steps, whole=True, paired=True)
    side = lambda a, n, at, size: one.where(F.col("axis") == a).select("tiling_id", F.coalesce("tiling_id", F.lit(0)).alias("id"), F.col("tiling_id").isNull().alias("no_id"), "request", "tile", "overlap", F.col("length").alias(f"full_{a}"), F.col("piece").alias(n), F.col("px_start").alias(at), (F.col("px_end") - F.col("px_start")).alias(size))
    both = side("x", "col", "px_x", "px_w").join(side("y", "row", "px_y", "px_h").drop("tiling_id"), ["id", "no_id", "request", "tile", "overlap"])
    large = (F.col("full_x") > F.col("tile")) | (F.col("full_y") > F.col("tile"))
    return both.where(large).select("tiling_id", "row", "col", "px_x", "px_y", "px_w", "px_h").distinct()
