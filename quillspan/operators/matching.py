"""One-to-one matching of boxes in a fixed order, and suppression of overlapping boxes.

Candidates are found by a grid join: an overlap of at least ``t`` bounds how far apart centres are and how much sides
differ, so only boxes of like size in neighbouring cells meet. Pairs that nothing else competes with are matches as
they are; only contested boxes, usually few, go through the ordered kernel, a cluster of contending boxes at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.common import cut
from quillspan.functions.geometry import center, height, iou, width
from quillspan.operators.clusters import clusters


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """All pairs with an IoU of at least ``threshold`` (above 0): keys, left_ord, left_conf, right_ord, iou.

    Both sides have the keys, ``ord``, ``conf`` and ``box``. Boxes without area overlap nothing.
    """
    reach = max(1, math.ceil(math.log2(1 / threshold))) if threshold < 1 else 1
    side = F.greatest(width(F.col("box")), height(F.col("box")))
    level = F.floor(F.log2(side)).cast("int")
    # Centres of a pair differ by less than (1 - t) / t of the left box's longer side, on either axis.
    cell = F.pow(F.lit(2.0), F.col("level") + 1) * max((1 - threshold) / threshold, 1e-3)
    at = lambda axis: F.floor(center(F.col("box"))[axis] / cell).cast("long")
    sized = lambda df: df.where((width(F.col("box")) > 0) & (height(F.col("box")) > 0))
    near = F.explode(F.expr("array(-1, 0, 1)"))
    a = sized(left).select(*keys, F.col("ord").alias("left_ord"), F.col("conf").alias("left_conf"), "box", level.alias("level"))
    a = a.withColumn("dx", near).withColumn("dy", near).select(*keys, "left_ord", "left_conf", F.col("box").alias("left_box"), "level", (at("x") + F.col("dx")).alias("cx"), (at("y") + F.col("dy")).alias("cy"))
    b = sized(right).select(*keys, F.col("ord").alias("right_ord"), "box", level.alias("own"))
    b = b.withColumn("level", F.explode(F.sequence(F.col("own") - reach, F.col("own") + reach))).select(*keys, "right_ord", F.col("box").alias("right_box"), "level", at("x").alias("cx"), at("y").alias("cy"))
    pairs = a.join(b, [*keys, "level", "cx", "cy"]).withColumn("iou", iou(F.col("left_box"), F.col("right_box")))
    return pairs.where(F.col("iou") >= threshold).select(*keys, "left_ord", "left_conf", "right_ord", "iou")


def _greedy(rows: pa.Table, *, by_confidence: bool, latest: bool) -> pa.Table:
    order = ([("left_conf", "descending")] if by_confidence else []) + [("left_ord", "ascending"), ("right_ord", "ascending")]
    rows = rows.sort_by(order)
    lefts, rights, overlaps = (rows.column(c).to_pylist() for c in ("left_ord", "right_ord", "iou"))
    used, out, k = set(), [], 0
    while k < len(lefts):
        best, at, left = 0.0, None, lefts[k]
        while k < len(lefts) and lefts[k] == left:
            if rights[k] not in used and (overlaps[k] >= best if latest else overlaps[k] > best):
                best, at = overlaps[k], k
            k += 1
        if at is not None:
            used.add(rights[at])
            out.append(at)
    return rows.take(pa.array(out, pa.int64()))


def greedy_match(left: DataFrame, right: DataFrame, keys: list[str], *, threshold: float = 0.5, by_confidence: bool = True, latest: bool = False) -> DataFrame:
    """Matches (keys, left_ord, right_ord, iou): in order of confidence, or of the document, each left box takes the
    free right box that it overlaps most, the earliest of equal ones (or the latest).

    ``ord`` is the order in the document and unique within the keys; equal confidences keep it.
    """
    pairs = cut(overlapping(left, right, keys, threshold))  # read more than once below
    left_node, right_node = F.xxhash64(*keys, F.lit("left"), "left_ord"), F.xxhash64(*keys, F.lit("right"), "right_ord")
    one = lambda side, n: pairs.groupBy(*keys, side).agg(F.count("*").alias(n))
    rated = cut(pairs.join(one("left_ord", "n_left"), [*keys, "left_ord"]).join(one("right_ord", "n_right"), [*keys, "right_ord"]))
    alone = (F.col("n_left") == 1) & (F.col("n_right") == 1)
    columns = [*keys, "left_ord", "left_conf", "right_ord", "iou"]
    # Choices depend on each other within a cluster of contending boxes only. Nodes are hashes: should two be equal,
    # two clusters are one group, and the keys still part them.
    contested = rated.where(~alone).select(*columns, left_node.alias("a"), right_node.alias("b"))
    of = clusters(contested).select(F.col("node").alias("a"), F.col("label").alias("cluster"))
    grouped = contested.join(of, "a").drop("a", "b")
    solved = grouped.groupBy(*keys, "cluster").applyInArrow(lambda rows: _greedy(rows.drop(["cluster"]), by_confidence=by_confidence, latest=latest), rated.select(*columns).schema)
    return rated.where(alone).select(*columns).unionByName(solved).drop("left_conf")


def _suppress(rows: pa.Table, threshold: float) -> pa.Table:
    """Of one cluster, best first: what is left takes along whatever overlaps it, as long as anything is left."""
    rows = rows.sort_by([("conf", "descending"), ("ord", "ascending"), ("tile_id", "ascending")])
    box = np.column_stack([rows.column(c).to_numpy() for c in ("x_min", "y_min", "x_max", "y_max")])
    size = np.prod((box[:, 2:] - box[:, :2]).clip(min=0), axis=1)
    tile_ids = rows.column("tile_id").to_pylist()
    left = np.arange(len(box))
    kept, tiles = [], []
    while len(left):
        best = left[0]
        both = np.prod((np.minimum(box[left, 2:], box[best, 2:]) - np.maximum(box[left, :2], box[best, :2])).clip(min=0), axis=1)
        union = size[left] + size[best] - both
        taken = np.divide(both, union, out=np.zeros(len(left)), where=union > 0) >= threshold
        taken[0] = True
        kept.append(best)
        tiles.append(list(dict.fromkeys(tile_ids[k] for k in left[taken])))
        left = left[~taken]
    return rows.drop(["tile_id"]).take(pa.array(kept)).append_column("tiles", pa.array(tiles, pa.list_(pa.string())))


def suppress(detections: DataFrame, keys: list[str], *, threshold: float = 0.5) -> DataFrame:
    """Detections of one label and sheet (``keys``) of which none overlaps a better one; ``tiles`` has all tiles it was
    seen in, in order. Columns besides the keys: ord, conf, tile_id, x_min, y_min, x_max, y_max."""
    rows = cut(detections.select(*keys, "ord", "conf", "tile_id", "x_min", "y_min", "x_max", "y_max"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "tile_id")
    # A detection that overlaps no other one is kept as it is; the kernel sees clusters of overlapping ones only.
    boxes = rows.select(*keys, F.struct("conf", "ord", "tile_id").alias("ord"), "conf", F.struct("x_min", "y_min", "x_max", "y_max").alias("box"))
    node = lambda c: F.xxhash64(*keys, f"{c}.conf", f"{c}.ord", f"{c}.tile_id")
    of = clusters(overlapping(boxes, boxes, keys, threshold).where("left_ord < right_ord").select(node("left_ord").alias("a"), node("right_ord").alias("b"))).withColumnRenamed("label", "cluster")
    named = rows.withColumn("node", F.xxhash64(*keys, "conf", "ord", "tile_id")).join(of, "node", "left").drop("node")
    crowded = named.where("cluster IS NOT NULL").groupBy(*keys, "cluster").applyInArrow(lambda r: _suppress(r.drop(["cluster"]), threshold), kinds + ", tiles array<string>")
    return named.where("cluster IS NULL").drop("cluster").withColumn("tiles", F.array("tile_id")).drop("tile_id").unionByName(crowded)


def suppress_plain(detections: DataFrame, keys: list[str], *, threshold: float = 0.5) -> DataFrame:
    """The other suppression: what overlaps a better one is dropped, and tiles with it."""
    return suppress(detections, keys, threshold=threshold).drop("tiles")


def edge_key(source: Column, target: Column, directed: Column) -> Column:
    """Directed edges keep their ends' order, undirected ones have them sorted."""
    way = F.coalesce(directed, F.lit(True))
    return F.when(way, F.struct(F.lit("d").alias("way"), source.alias("a"), target.alias("b"))).otherwise(F.struct(F.lit("u").alias("way"), F.least(source, target).alias("a"), F.greatest(source, target).alias("b")))
