"""Tiles of a fixed step over a sheet, and what falls into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.geometry import area, bounds, box, center, height, to_tile, width
from quillspan.operators.grounding import class_index
from quillspan.operators.matching import suppress


def tile_count(total: Column, size: Column, step: Column) -> Column:
    """Tiles that cover an axis; the last one is cut off at the end, and none begins beyond it."""
    return F.when(total <= size, F.lit(1)).otherwise(F.ceil((total - size) / step).cast("int") + 1).cast("int")


def tiles(sheets: DataFrame) -> DataFrame:
    """Tiles of sheets (sheet_id, full_width, full_height, tile_size, overlap): pixels, region and core.

    The core is the tile without half the overlap on its inner sides, or all of it if nothing would be left. Sheets
    without positive sizes give no tiles; an overlap of the tile's size or more makes steps of one pixel.
    """
    ok = sheets.where((F.col("full_width") > 0) & (F.col("full_height") > 0) & (F.col("tile_size") > 0))
    step = F.greatest(F.lit(1), F.col("tile_size") - F.col("overlap"))
    grid = ok.withColumns({"n_cols": tile_count(F.col("full_width"), F.col("tile_size"), step), "n_rows": tile_count(F.col("full_height"), F.col("tile_size"), step)})
    each = grid.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)))
    each = each.withColumns({"px_x": (F.col("col") * step).cast("int"), "px_y": (F.col("row") * step).cast("int")})
    each = each.withColumns({"x2": F.least(F.col("px_x") + F.col("tile_size"), "full_width"), "y2": F.least(F.col("px_y") + F.col("tile_size"), "full_height")})
    half = F.floor(F.col("overlap") / 2).cast("int")
    inner = lambda c, edge: F.when(F.col(c) == edge, 0).otherwise(half)
    x0, x1 = F.col("px_x") + inner("col", 0), F.col("x2") - inner("col", F.col("n_cols") - 1)
    y0, y1 = F.col("px_y") + inner("row", 0), F.col("y2") - inner("row", F.col("n_rows") - 1)
    none = (x1 <= x0) | (y1 <= y0)
    core = lambda v, full: F.when(none, F.col(full)).otherwise(v).cast("int")
    each = each.withColumns({"core_x0": core(x0, "px_x"), "core_y0": core(y0, "px_y"), "core_x1": core(x1, "x2"), "core_y1": core(y1, "y2")})
    of = lambda a, b, c, d: box(F.col(a) / F.col("full_width"), F.col(b) / F.col("full_height"), F.col(c) / F.col("full_width"), F.col(d) / F.col("full_height"))
    return each.select(
        F.concat(F.col("sheet_id"), F.lit(":r"), F.col("row").cast("string"), F.lit("c"), F.col("col").cast("string")).alias("tile_id"), "sheet_id", "row", "col", "full_width", "full_height", "px_x", "px_y",
        (F.col("x2") - F.col("px_x")).alias("px_w"), (F.col("y2") - F.col("px_y")).alias("px_h"), of("px_x", "px_y", "x2", "y2").alias("region"), of("core_x0", "core_y0", "core_x1", "core_y1").alias("core"),
    )


def plain_tiles(sheets: DataFrame) -> DataFrame:
    """The other tiler: one tile if the sheet fits, else a tile at every step to the end, slivers included."""
    step = F.greatest(F.lit(1), F.col("tile_size") - F.col("overlap"))
    ok = sheets.where((F.col("full_width") > 0) & (F.col("full_height") > 0) & (F.col("tile_size") > 0))
    fits = (F.col("full_width") <= F.col("tile_size")) & (F.col("full_height") <= F.col("tile_size"))
    starts = lambda full: F.explode(F.sequence(F.lit(0), F.when(fits, 0).otherwise(F.col(full) - 1), step))
    each = ok.withColumn("px_y", starts("full_height")).withColumn("px_x", starts("full_width"))
    return each.select("sheet_id", "px_x", "px_y", (F.least(F.col("px_x") + F.col("tile_size"), "full_width") - F.col("px_x")).alias("px_w"), (F.least(F.col("px_y") + F.col("tile_size"), "full_height") - F.col("px_y")).alias("px_h"))


def assign(targets: DataFrame, *, tile_size: int = 1536, overlap: int = 192) -> DataFrame:
    """Targets (box in fractions, full_width, full_height) with each tile whose region holds their centre.

    The step is fixed, so the tiles follow from the centre: no join, however many tiles there are.
    """
    step = max(1, tile_size - overlap)

    def holding(axis: str, full: str, out: str, df: DataFrame) -> DataFrame:
        at, size = center(F.col("box"))[axis] * F.col(full), F.col(full)
        n = tile_count(size, F.lit(tile_size), F.lit(step))
        first, last = F.greatest(F.ceil((at - tile_size) / step), F.lit(0)).cast("int"), F.least(F.floor(at / step), n - 1).cast("int")
        return df.withColumn(out, F.explode(F.when((at >= 0) & (at <= size) & (first <= last), F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))

    rows = holding("y", "full_height", "row", holding("x", "full_width", "col", targets.where((F.col("full_width") > 0) & (F.col("full_height") > 0))))
    side = lambda k, full: [F.col(k) * step / F.col(full), F.least(F.col(k) * step + tile_size, F.col(full)) / F.col(full)]
    (x0, x1), (y0, y1) = side("col", "full_width"), side("row", "full_height")
    return rows.withColumn("region", box(x0, y0, x1, y1))


def label_lines(assigned: DataFrame, *, min_area: float = 0.0) -> DataFrame:
    """Detector labels of targets on tiles: class and box in fractions of the tile, clipped to it; unknown classes and
    boxes without the least area are left out."""
    inside = to_tile(F.col("region"), F.col("box"))
    clip = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    rows = assigned.withColumn("t", box(*[clip(inside[c]) for c in ("x_min", "y_min", "x_max", "y_max")])).withColumn("class_index", class_index(F.col("label")))
    w, h = width(F.col("t")), height(F.col("t"))
    rows = rows.where(F.col("class_index").isNotNull() & (w > 0) & (h > 0) & (w * h >= min_area))
    return rows.select("set_id", "sheet_ord", "row", "col", "entity_id", "class_index", (F.col("t.x_min") + w / 2).alias("cx"), (F.col("t.y_min") + h / 2).alias("cy"), w.alias("w"), h.alias("h"))


def dataset_tiles(tiles_: DataFrame, lines: DataFrame, key: list[str]) -> DataFrame:
    """Every tile with its label text and the number of its labels: tiles without any stay as negatives.

    ``lines`` has the key, entity_id, class_index, cx, cy, w, h; a tile's lines follow each other by class, then id.
    """
    text = F.format_string("%d %.6f %.6f %.6f %.6f", "class_index", "cx", "cy", "w", "h")
    each = lines.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("class_index", "entity_id", text.alias("text")))).alias("l"))  # of one tile
    return tiles_.join(each, key, "left").select(*tiles_.columns, F.coalesce(F.size("l"), F.lit(0)).alias("n_labels"), F.coalesce(F.array_join(F.transform("l", lambda x: x["text"]), "\n"), F.lit("")).alias("text"))


def write_dataset(dataset: DataFrame, folder: str, *, labels: tuple[str, ...]) -> DataFrame:
    """Label texts as a table partitioned by ``split``, and the description a trainer reads; gives tiles and labels of
    each split."""
    dataset.write.mode("overwrite").partitionBy("split").parquet(f"{folder}/labels")
    names = "\n".join(["path: .", "train: labels/split=train", "val: labels/split=val", "names:", *[f"  {k}: {name}" for k, name in enumerate(labels)]])
    spark = dataset.sparkSession
    spark.createDataFrame([(names,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/description")
    return spark.read.parquet(f"{folder}/labels").groupBy("split").agg(F.count("*").alias("n_tiles"), F.sum("n_labels").alias("n_labels"))


def compose(found: DataFrame, tiles_: DataFrame) -> DataFrame:
    """Detections in fractions of their tile (tile_id, label, bbox, score) in fractions of the sheet."""
    region = tiles_.select("tile_id", "sheet_id", "region")
    r, b = F.col("region"), F.col("bbox")
    x = lambda v: r["x_min"] + v * width(r)
    y = lambda v: r["y_min"] + v * height(r)
    return found.join(region, "tile_id").select("sheet_id", "label", "score", "tile_id", x(b["x_min"]).alias("x_min"), y(b["y_min"]).alias("y_min"), x(b["x_max"]).alias("x_max"), y(b["y_max"]).alias("y_max"), *[c for c in found.columns if c == "ord"])


def sheet_detections(found: DataFrame, tiles_: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """Detections of all tiles of a sheet, each symbol once, with the tiles it was seen in."""
    return suppress(compose(found, tiles_).withColumnRenamed("score", "conf"), ["sheet_id", "label"], threshold=threshold)


def targets_of(entities: DataFrame, *, labels: tuple[str, ...]) -> DataFrame:
    """Entities of known labels with a box of positive area."""
    return entities.where(F.col("label").isin(*labels)).withColumn("box", bounds(F.col("geometry"))).where(area(F.col("box")) > 0)
