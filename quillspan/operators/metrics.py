"""Evaluation of predicted entities against true ones.

Frames of entities have ``doc``, ``ord`` (order in the document), ``label`` (that they are matched by), ``conf`` and
``box``. Each metric is a plan that ends in one row with one column ``value``; without anything to judge it is 0.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.common import cut, partitions
from quillspan.functions.geometry import area, bounds, shoelace
from quillspan.functions.text import norm_text
from quillspan.operators.grounding import matched_label
from quillspan.operators.matching import edge_key, greedy_match

ROWS_PER_RANGE = 200_000


def judged(entities: DataFrame, *, doc: str = "set_id", order: str = "doc_ord") -> DataFrame:
    """Entities as metrics take them."""
    label = matched_label(F.col("label"), F.col("ifc_class"), F.col("entity_type"))
    return entities.withColumns({"doc": F.col(doc), "ord": F.col(order), "label": label, "conf": F.col("confidence"), "box": bounds(F.col("geometry"))})


def detections(rows: DataFrame) -> DataFrame:
    return rows.where(area(F.col("box")) > 0).select("doc", "ord", "label", "conf", "box")


def _one(df: DataFrame, value: Column) -> DataFrame:
    return df.agg(F.coalesce(value.cast("double"), F.lit(0.0)).alias("value"))


def scored(pred: DataFrame, true: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """(label, doc, ord, conf, hit) of every prediction: matched within its document and label by confidence."""
    p, t = detections(pred), detections(true)
    hits = greedy_match(p, t, ["doc", "label"], threshold=threshold).select("doc", "label", F.col("left_ord").alias("ord"), F.lit(1).alias("hit"))
    return p.join(hits, ["doc", "label", "ord"], "left").select("label", "doc", "ord", "conf", F.coalesce("hit", F.lit(0)).alias("hit"))


def average_precision(rows: DataFrame, n_true: DataFrame) -> DataFrame:
    """(label, ap): all-point average precision of scored predictions (label, doc, ord, conf, hit).

    Predictions are range-partitioned by label, confidence and document, so equal confidences, in whatever number,
    keep the order of documents and still are in many ranges. Running counts and the precision envelope are windows
    within ranges, joined by windows over the ranges of a label (a row each).
    """
    rows = cut(rows)
    n = partitions(rows.sparkSession, rows.count(), ROWS_PER_RANGE)
    rows = cut(rows.repartitionByRange(n, "label", F.desc("conf"), "doc", "ord")).withColumn("bucket", F.spark_partition_id())
    sums = rows.groupBy("label", "bucket").agg(F.sum("hit").alias("h"), F.count("*").alias("k"))
    over = Window.partitionBy("label").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("label", "bucket", F.coalesce(F.sum("h").over(over), F.lit(0)).alias("h0"), F.coalesce(F.sum("k").over(over), F.lit(0)).alias("k0"))
    within = Window.partitionBy("label", "bucket").orderBy(F.desc("conf"), "doc", "ord")
    run = within.rowsBetween(Window.unboundedPreceding, 0)
    curve = rows.join(starts, ["label", "bucket"]).withColumn("p", (F.col("h0") + F.sum("hit").over(run)) / (F.col("k0") + F.row_number().over(within)))
    best = curve.groupBy("label", "bucket").agg(F.max("p").alias("best"))
    later = Window.partitionBy("label").orderBy("bucket").rowsBetween(1, Window.unboundedFollowing)
    best = best.select("label", "bucket", F.max("best").over(later).alias("later"))
    envelope = F.greatest(F.max("p").over(within.rowsBetween(0, Window.unboundedFollowing)), "later")
    gained = curve.join(best, ["label", "bucket"]).withColumn("env", envelope).where("hit = 1").groupBy("label").agg(F.sum("env").alias("s"))
    both = n_true.select("label", F.col("n_true").cast("double").alias("n"), F.lit(0.0).alias("s")).unionByName(gained.select("label", F.lit(0.0).alias("n"), "s"))
    return both.groupBy("label").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).where("n > 0").select("label", (F.col("s") / F.col("n")).alias("ap"))


def per_class_ap(pred: DataFrame, true: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    n_true = detections(true).groupBy("label").agg(F.count("*").alias("n_true"))
    return average_precision(scored(pred, true, threshold=threshold), n_true)


def detection_map(pred: DataFrame, true: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """Mean over the true classes of their average precision; classes only predicted don't count."""
    return _one(per_class_ap(pred, true, threshold=threshold), F.avg("ap"))


def class_counts(rows: DataFrame) -> DataFrame:
    """Entities per document and label; a whole number (or a true value, as 1) in ``quantity`` counts for so many."""
    raw = F.get_json_object("attributes", "$.quantity")
    typed = F.regexp_extract(F.col("attributes"), r'"quantity"\s*:\s*(-?\d+|true|false)\s*[,}]', 1)
    n = F.when(typed == "true", 1).when(typed == "false", 0).when((typed != "") & raw.isNotNull(), typed.try_cast("long")).otherwise(1)
    return rows.groupBy("doc", "label").agg(F.sum(n).cast("long").alias("n"))


def _counted(pred: DataFrame, true: DataFrame) -> DataFrame:
    got = class_counts(pred).withColumnRenamed("n", "n_pred")
    return class_counts(true).join(got, ["doc", "label"], "left").withColumn("n_pred", F.coalesce("n_pred", F.lit(0)))


def counting_mape(pred: DataFrame, true: DataFrame) -> DataFrame:
    """Mean relative error in per cent of the counts per document and true class."""
    return _one(_counted(pred, true).where("n > 0"), F.avg(F.abs(F.col("n_pred") - F.col("n")) / F.col("n")) * 100)


def counting_exact_match(pred: DataFrame, true: DataFrame) -> DataFrame:
    return _one(_counted(pred, true), F.avg((F.col("n_pred") == F.col("n")).cast("int")))


def ocr_exact_match(pred: DataFrame, true: DataFrame) -> DataFrame:
    """Share of true texts, each as often as it occurs, that are among the predicted ones."""
    spans = lambda df, n: df.select("doc", F.explode("text_spans.text").alias("t")).groupBy("doc", norm_text(F.col("t")).alias("t")).agg(F.count("*").alias(n))
    both = spans(true, "n").join(spans(pred, "m"), ["doc", "t"], "left")
    return _one(both, F.sum(F.least("n", F.coalesce("m", F.lit(0)))) / F.sum("n"))


def _first_fit(rows: pd.DataFrame, tolerance: float) -> pd.DataFrame:
    rows = rows.sort_values(["side", "ord", "k"], kind="stable")
    true, pred = (rows.loc[rows["side"] == s, "value"].to_numpy() for s in (0, 1))
    free, hits = np.ones(len(pred), dtype=bool), 0
    for v in true:
        at = np.nonzero(free & (np.abs(pred - v) <= tolerance))[0]
        if len(at):
            free[at[0]] = False
            hits += 1
    return pd.DataFrame({"hits": [hits], "total": [len(true)]})


def dimension_accuracy(pred: DataFrame, true: DataFrame, *, tolerance_mm: float = 1.0) -> DataFrame:
    """Share of true dimensions that find, in document order, a predicted one of their document not taken before.

    Values further apart than the tolerance never meet, so a document's values fall into clusters with gaps between
    them. Where all values of a cluster are within the tolerance of each other any pairing is as good, and counts are
    enough, however often a value occurs; only the others are paired in order.
    """
    side = lambda df, s: df.select("doc", "ord", F.posexplode("dimensions.value_mm").alias("k", "value")).where("value IS NOT NULL").withColumn("side", F.lit(s))
    # Neighbouring cells, and those one further for values at the very limit, are of one cluster.
    rows = cut(side(true, 0).unionByName(side(pred, 1)).withColumn("cell", F.floor(F.col("value") / max(tolerance_mm, 1e-9))))
    cells = rows.groupBy("doc", "cell").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count_if(F.col("side") == 0).alias("t"), F.count_if(F.col("side") == 1).alias("p"))
    order = Window.partitionBy("doc").orderBy("cell")
    apart = F.coalesce(F.col("cell") - F.lag("cell").over(order) > 2, F.lit(False)).cast("int")
    cells = cut(cells.withColumn("apart", apart).withColumn("cluster", F.sum("apart").over(order)))
    sums = cells.groupBy("doc", "cluster").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), (F.max("high") - F.min("low")).alias("spread"))
    counted = sums.where(F.col("spread") <= tolerance_mm).select(F.least("t", "p").alias("hits"), F.col("t").alias("total"))
    wide = sums.where(F.col("spread") > tolerance_mm)
    alone = wide.where("t = 0 OR p = 0").select(F.lit(0).cast("long").alias("hits"), F.col("t").alias("total"))
    paired = rows.join(cells.select("doc", "cell", "cluster").join(wide.where("t > 0 AND p > 0"), ["doc", "cluster"]).select("doc", "cell", "cluster"), ["doc", "cell"])
    each = paired.groupBy("doc", "cluster").applyInPandas(lambda r: _first_fit(r, tolerance_mm), "hits long, total long")
    return _one(counted.unionByName(alone).unionByName(each), F.sum("hits") / F.nullif(F.sum("total"), F.lit(0)))


def panoptic_quality(pred: DataFrame, true: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """Overlap of the matches, in document order, over matches and half of what either side has left."""
    p, t = detections(pred), detections(true)
    hits = greedy_match(p, t, ["doc", "label"], threshold=threshold, by_confidence=False)
    # A match is worth its overlap; matches and half of the rest of both sides are half of all boxes.
    boxes = p.unionByName(t).select(F.lit(0.0).alias("iou"), F.lit(0.5).alias("half"))
    both = hits.select("iou", F.lit(0.0).alias("half")).unionByName(boxes)
    return _one(both, F.sum("iou") / F.nullif(F.sum("half"), F.lit(0.0)))


def wall_polygons(rows: DataFrame) -> DataFrame:
    """Polygons of walls, by type or by a label that speaks of walls or rooms."""
    return rows.where((F.col("geometry.type") == "polygon") & ((F.col("entity_type") == "wall") | F.lower("label").rlike("wall|room"))).select("doc", "geometry.points")


def _raster(polygons: DataFrame, size: int) -> DataFrame:
    """(doc, row, word, bits) of the pixels whose centres are inside a polygon, 64 of them a word.

    Every edge gives the places where it crosses the rows' centre lines (its upper end included, its lower one not);
    a polygon's places of a row, in order, are where its spans begin and end. The union of all is an aggregate of bits.
    """
    at = lambda p, axis: p[axis] * size
    after = F.concat(F.slice("points", 2, F.size("points")), F.slice("points", 1, 1))
    ends = F.explode(F.arrays_zip(F.col("points").alias("p"), after.alias("q")))
    edges = polygons.where(F.size("points") >= 3).withColumn("polygon", F.monotonically_increasing_id()).select("doc", "polygon", ends.alias("e"))
    p, q = F.col("e.p"), F.col("e.q")
    edges = edges.select("doc", "polygon", at(p, "x").alias("x1"), at(p, "y").alias("y1"), at(q, "x").alias("x2"), at(q, "y").alias("y2"))
    first = F.greatest(F.ceil(F.least("y1", "y2") - 0.5), F.lit(0)).cast("int")
    last = F.least(F.ceil(F.greatest("y1", "y2") - 0.5) - 1, F.lit(size - 1)).cast("int")
    crossed = edges.where(first <= last).withColumn("row", F.explode(F.sequence(first, last)))
    x = F.col("x1") + (F.col("row") + 0.5 - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    rows = crossed.groupBy("doc", "polygon", "row").agg(F.array_sort(F.collect_list(x)).alias("xs"))
    pair = F.explode(F.expr("transform(sequence(0, size(xs) div 2 - 1), k -> struct(xs[2 * k] AS a, xs[2 * k + 1] AS b))"))
    spans = rows.where(F.size("xs") >= 2).select("doc", "row", pair.alias("s"))
    spans = spans.select("doc", "row", F.greatest(F.ceil(F.col("s.a") - 0.5), F.lit(0)).alias("first"), F.least(F.floor(F.col("s.b") - 0.5), F.lit(size - 1)).alias("last")).where("first <= last")
    words = spans.withColumn("word", F.explode(F.sequence(F.floor(F.col("first") / 64), F.floor(F.col("last") / 64))))
    bits = F.expr("shiftleft(-1L, CAST(greatest(first - 64 * word, 0) AS INT)) & shiftrightunsigned(-1L, CAST(63 - least(last - 64 * word, 63) AS INT))")
    return words.groupBy("doc", "row", "word").agg(F.bit_or(bits).alias("bits"))


def external_wall_iou(pred: DataFrame, true: DataFrame, *, size: int = 256) -> DataFrame:
    """Mean over documents with true wall polygons of the overlap of the filled areas."""
    docs = wall_polygons(true).select("doc").distinct()
    p, t = (_raster(wall_polygons(df), size).withColumnRenamed("bits", n) for df, n in ((pred, "p"), (true, "t")))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    both = t.join(p, ["doc", "row", "word"], "full").groupBy("doc").agg(F.sum(F.bit_count(zero(F.col("p")).bitwiseAND(zero(F.col("t"))))).alias("i"), F.sum(F.bit_count(zero(F.col("p")).bitwiseOR(zero(F.col("t"))))).alias("u"))
    return _one(docs.join(both, "doc", "left"), F.avg(F.coalesce(F.col("i") / F.nullif(F.col("u"), F.lit(0)), F.lit(0.0))))


def vector_points(rows: DataFrame) -> DataFrame:
    points = rows.where(F.col("geometry.type").isin("polyline", "polygon")).select("doc", "ord", F.posexplode("geometry.points").alias("k", "p"))
    return points.select("doc", "ord", "k", "p.x", "p.y")


def _one_way(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc, mean distance to the nearest point of the other side), in a grid whose cells grow.

    Cells are at first as large as a document has room for each point. A point looks into its own cell and those around
    it; what it finds there no farther than a cell is its nearest. The others, few in most drawings, look again in
    cells four times as large. Equal points are looked up once.
    """
    wanted = a.where("x IS NOT NULL AND y IS NOT NULL").groupBy("doc", "x", "y").agg(F.count("*").alias("n"))
    there = cut(b.where("x IS NOT NULL AND y IS NOT NULL").select(F.col("doc").alias("doc"), F.col("x").alias("bx"), F.col("y").alias("by")).distinct())
    extent = F.greatest(F.max("bx") - F.min("bx"), F.max("by") - F.min("by"), F.lit(1e-6))
    sizes = there.groupBy("doc").agg((extent / F.sqrt(F.count("*"))).alias("size"))
    there = there.join(sizes, "doc")
    todo = cut(wanted.join(sizes, "doc"))
    near = F.explode(F.expr("array(-1, 0, 1)"))
    done, scale = None, 1.0
    while not todo.isEmpty():
        cell = lambda c: F.floor(F.col(c) / (F.col("size") * scale))  # noqa: E731, B023
        around = todo.withColumn("dx", near).withColumn("dy", near).withColumns({"cx": cell("x") + F.col("dx"), "cy": cell("y") + F.col("dy")}).drop("dx", "dy")
        met = around.join(there.select("doc", "bx", "by", cell("bx").alias("cx"), cell("by").alias("cy")), ["doc", "cx", "cy"], "left")
        best = cut(met.groupBy("doc", "x", "y", "n", "size").agg(F.min(F.hypot(F.col("bx") - F.col("x"), F.col("by") - F.col("y"))).alias("d")))
        sure = F.coalesce(F.col("d") <= F.col("size") * scale, F.lit(False))
        found = best.where(sure).select("doc", "n", "d")
        done = found if done is None else done.unionByName(found)
        todo, scale = best.where(~sure).drop("d"), scale * 4
    if done is None:
        return todo.select("doc", F.lit(0.0).alias("d"))
    return done.groupBy("doc").agg((F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("d"))


def chamfer(pred: DataFrame, true: DataFrame) -> DataFrame:
    """(doc, distance): both ways' mean distances to the nearest point, of documents with points on both sides."""
    p, t = vector_points(pred), vector_points(true)
    return _one_way(p, t).join(_one_way(t, p).withColumnRenamed("d", "e"), "doc").select("doc", (F.col("d") + F.col("e")).alias("distance"))


def chamfer_distance(pred: DataFrame, true: DataFrame) -> DataFrame:
    return _one(chamfer(pred, true), F.avg("distance"))


def loop_closure_validity(pred: DataFrame, true: DataFrame | None = None) -> DataFrame:
    """Share of predicted polygons of three points or more that enclose an area."""
    points = F.col("geometry.points")
    valid = (F.size(points) >= 3) & (shoelace(points) > 1e-9)
    return _one(pred.where("geometry.type = 'polygon'"), F.avg(F.coalesce(valid, F.lit(False)).cast("int")))


def match_nodes(pred: DataFrame, true: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """(doc, pred_id, true_id) by confidence; of equal overlaps the latest true node wins. Boxes without area match nothing."""
    p, t = (df.select("doc", "ord", "label", "conf", "box", "entity_id") for df in (pred, true))
    pairs = greedy_match(p, t, ["doc", "label"], threshold=threshold, latest=True)
    named = pairs.join(p.select("doc", "label", F.col("ord").alias("left_ord"), F.col("entity_id").alias("pred_id")), ["doc", "label", "left_ord"])
    return named.join(t.select("doc", "label", F.col("ord").alias("right_ord"), F.col("entity_id").alias("true_id")), ["doc", "label", "right_ord"]).select("doc", "pred_id", "true_id")


def edge_scores(pred_nodes: DataFrame, pred_edges: DataFrame, true_nodes: DataFrame, true_edges: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """(doc, ord, conf, hit) of predicted edges (doc, ord, source_id, target_id, conf) whose ends are matched first.

    A directed true edge is met by the same orientation only, an undirected one by either; each once, in document
    order (``ord`` is unique in a document).
    """
    names = cut(match_nodes(pred_nodes, true_nodes, threshold=threshold))
    end = lambda side: names.select("doc", F.col("pred_id").alias(f"{side}_id"), F.col("true_id").alias(side))
    mapped = pred_edges.join(end("source"), ["doc", "source_id"], "left").join(end("target"), ["doc", "target_id"], "left").select("doc", "ord", F.coalesce("conf", F.lit(1.0)).alias("conf"), "source", "target")
    lost = mapped.where("source IS NULL OR target IS NULL").select("doc", "ord", "conf", F.lit(0).alias("hit"))
    ends = mapped.where("source IS NOT NULL AND target IS NOT NULL").select("doc", "ord", "conf", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), (F.col("source") > F.col("target")).cast("int").alias("way"))
    key = F.coalesce("directed", F.lit(True))
    way = (F.col("source_id") > F.col("target_id")).cast("int")
    has = lambda c: F.max(c.cast("int"))
    true = true_edges.groupBy("doc", F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).agg(has(key & (way == 0)).alias("has_d0"), has(key & (way == 1)).alias("has_d1"), has(~key).alias("has_u0"))
    met = ends.join(true, ["doc", "a", "b"], "left").fillna(0, ["has_d0", "has_d1", "has_u0"])
    met = cut(met.withColumn("directed", F.when(F.col("way") == 0, F.col("has_d0")).otherwise(F.col("has_d1")) == 1))
    # The first of an orientation takes the directed edge; of all others the first takes the undirected one.
    straight = met.where("directed").groupBy("doc", "a", "b", "way").agg(F.min("ord").alias("ord"))
    rest = met.where("has_u0 = 1").join(straight.select("doc", "ord"), ["doc", "ord"], "left_anti")
    either = rest.groupBy("doc", "a", "b").agg(F.min("ord").alias("ord"))
    hits = straight.select("doc", "ord").unionByName(either.select("doc", "ord")).withColumn("hit", F.lit(1))
    return lost.unionByName(met.join(hits, ["doc", "ord"], "left").select("doc", "ord", "conf", F.coalesce("hit", F.lit(0)).alias("hit")))


def graph_edge_ap(pred_nodes: DataFrame, pred_edges: DataFrame, true_nodes: DataFrame, true_edges: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """Average precision of edges over all documents; equal true edges count once."""
    rows = edge_scores(pred_nodes, pred_edges, true_nodes, true_edges, threshold=threshold).withColumn("label", F.lit("edge"))
    n_true = true_edges.select("doc", edge_key(F.col("source_id"), F.col("target_id"), F.col("directed")).alias("k")).distinct().agg(F.count("*").alias("n_true")).withColumn("label", F.lit("edge"))
    return _one(average_precision(rows, n_true), F.max("ap"))


def _qa(sets: DataFrame) -> DataFrame:
    """(doc, q_id, answer): the last of equal ids holds; answers are normalised."""
    pairs = F.from_json(F.get_json_object("metadata", "$.qa_pairs"), "array<struct<q_id:string,answer:string>>")
    rows = sets.select("doc", F.posexplode(pairs).alias("k", "qa")).where("qa.q_id IS NOT NULL")
    return rows.groupBy("doc", F.col("qa.q_id").alias("q_id")).agg(F.max_by(norm_text(F.coalesce("qa.answer", F.lit(""))), "k").alias("answer"))


def qa_accuracy(pred: DataFrame, true: DataFrame) -> DataFrame:
    """Share of true answers (sets with doc and metadata) that the prediction gives under the same id."""
    both = _qa(true).join(_qa(pred).withColumnRenamed("answer", "given"), ["doc", "q_id"], "left")
    return _one(both, F.avg(F.coalesce(F.col("given") == F.col("answer"), F.lit(False)).cast("int")))


def rfi_reward(pred: DataFrame, true: DataFrame | None = None) -> DataFrame:
    """Mean share of four parts that drafted requests (sets with metadata) have: clause, evidence, conflict, question."""
    part = lambda n: F.get_json_object("metadata", f"$.rfi.{n}")
    # Empty strings, lists, objects, zeros and false are no parts.
    has = lambda n: F.coalesce(~part(n).isin("", "[]", "{}", "0", "0.0", "false"), F.lit(False)).cast("int")
    return _one(pred, F.avg((has("cited_clause") + has("evidence") + has("conflict") + has("question")) / 4))


METRICS: dict[str, Callable[..., DataFrame]] = {
    "detection_map": detection_map,
    "counting_mape": counting_mape,
    "counting_exact_match": counting_exact_match,
    "ocr_exact_match": ocr_exact_match,
    "dimension_accuracy": dimension_accuracy,
    "panoptic_quality": panoptic_quality,
    "external_wall_iou": external_wall_iou,
    "chamfer_distance": chamfer_distance,
    "loop_closure_validity": loop_closure_validity,
    "graph_node_ap": detection_map,
    "graph_edge_ap": graph_edge_ap,
    "qa_accuracy": qa_accuracy,
    "rfi_reward": rfi_reward,
}
LOWER_IS_BETTER = ("counting_mape", "chamfer_distance")
