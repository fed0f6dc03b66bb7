"""Candidate edges between symbols of a view, their features and labels, and edge classification."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.common import cut
from quillspan.functions import fixed
from quillspan.functions.geometry import bounds, center
from quillspan.operators.grounding import LABELS, class_index

VIEW = ["set_id", "sheet_ord", "view_ord"]


def nodes(entities: DataFrame) -> DataFrame:
    """Symbols of known classes with their centre."""
    b = bounds(F.col("geometry"))
    rows = entities.where(F.col("label").isin(*LABELS) & b.isNotNull())
    return rows.select(*VIEW, F.col("entity_ord").alias("ord"), "entity_id", "label", center(b)["x"].alias("x"), center(b)["y"].alias("y"))


def _nearest(rows: DataFrame, k: int) -> DataFrame:
    """(view, a, b): each node ``a`` with its ``k`` nearest of the view, the earlier ones of equally near.

    Nodes look into their own and the surrounding cells of a grid. What is no farther than a cell is nearest for sure;
    nodes with fewer than ``k`` of those, unless all of the view was seen, look again in cells twice as large.
    """
    x, y = F.col("node.x"), F.col("node.y")
    extent = F.greatest(F.max(x) - F.min(x), F.max(y) - F.min(y), F.lit(1e-6))
    sizes = rows.groupBy(*VIEW).agg(F.count("*").alias("n"), extent.alias("extent"))
    # A few nodes are one block; of many about k are expected within a cell's length.
    size = F.col("extent") * F.when(F.col("n") <= 4 * k, 1.0).otherwise(F.sqrt(k / F.col("n")))
    there = cut(rows.join(sizes.select(*VIEW, "n", size.alias("size")), VIEW))
    near = F.explode(F.expr("array(-1, 0, 1)"))
    todo, found, scale = there.select(*VIEW, F.col("node").alias("a"), "n", "size"), None, 1.0
    while True:
        cell = lambda c: F.floor(c / (F.col("size") * scale))  # noqa: E731, B023
        a, b = F.col("a"), F.col("b")
        around = todo.withColumn("dx", near).withColumn("dy", near).withColumns({"cx": cell(a["x"]) + F.col("dx"), "cy": cell(a["y"]) + F.col("dy")}).drop("dx", "dy")
        met = around.join(there.select(*VIEW, F.col("node").alias("b"), cell(x).alias("cx"), cell(y).alias("cy")), [*VIEW, "cx", "cy"]).where(a["ord"] != b["ord"])
        met = met.withColumn("d", F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
        of = Window.partitionBy(*VIEW, "a.ord")
        rank = F.row_number().over(of.orderBy("d", "b.ord"))
        sure = (F.count("*").over(of) == F.col("n") - 1) | (F.count_if(F.col("d") <= F.col("size") * scale).over(of) >= k)
        best = cut(met.withColumns({"rank": rank, "sure": sure}).where((F.col("rank") <= k)).select(*VIEW, "a", "b", "n", "size", "sure"))
        pairs = best.where("sure").select(*VIEW, "a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        # Whoever is not sure, or met nobody at all, looks again; alone in a view there is nobody to meet.
        done = best.where("sure").select(*VIEW, F.col("a.ord").alias("ord")).distinct()
        todo = cut(todo.where("n > 1").withColumn("ord", F.col("a.ord")).join(done, [*VIEW, "ord"], "left_anti").select(*VIEW, "a", "n", "size"))
        if todo.isEmpty():
            return found
        scale *= 2


def candidates(nodes_: DataFrame, *, k: int = 8) -> DataFrame:
    """Unordered pairs, the earlier node first: each node with its ``k`` nearest of the view, and panels with all.

    ``ord`` is unique in a view. The pairs of a panel are as many as the view has nodes.
    """
    rows = cut(nodes_.select(*VIEW, F.struct("ord", "entity_id", "label", "x", "y").alias("node")))
    panels = rows.where(F.col("node.label") == fixed.PANEL).select(*VIEW, F.col("node").alias("a"))
    hubs = panels.join(rows.select(*VIEW, F.col("node").alias("b")), VIEW).where("a.ord <> b.ord").select(*VIEW, "a", "b")
    pairs = _nearest(rows, k).unionByName(hubs).select(*VIEW, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.select(*VIEW, *[F.col(f"{e}.{c}").alias(f"{c}_{n}") for c in ("entity_id", "label", "x", "y") for e, n in (("a", 1), ("b", 2))])


def pair_features(pairs: DataFrame) -> DataFrame:
    """Pairs with 23 features: dx, dy, distance, and the classes of the left and the right node as ones of ten.

    The nodes are put in the order of (x, y), so it doesn't matter which comes first.
    """
    swap = (F.col("x_2") < F.col("x_1")) | ((F.col("x_2") == F.col("x_1")) & (F.col("y_2") < F.col("y_1")))
    of = lambda c, n: F.when(swap, F.col(f"{c}_{3 - n}")).otherwise(F.col(f"{c}_{n}"))
    dx, dy = of("x", 2) - of("x", 1), of("y", 2) - of("y", 1)
    one_hot = lambda label: F.transform(F.sequence(F.lit(0), F.lit(len(LABELS) - 1)), lambda k: F.when(k == class_index(label), 1.0).otherwise(0.0))
    return pairs.withColumn("features", F.concat(F.array(dx, dy, F.hypot(dx, dy)), one_hot(of("label", 1)), one_hot(of("label", 2))))


def labelled(pairs: DataFrame, connections: DataFrame) -> DataFrame:
    """Pairs with the type of the true edge between them in either direction, the last of several; else ``none``."""
    known = connections.where(F.col("connection_type").isin(*fixed.EDGE_TYPES[1:]))
    edges = known.groupBy(*VIEW, F.least("source_id", "target_id").alias("_a"), F.greatest("source_id", "target_id").alias("_b")).agg(F.max_by("connection_type", "conn_ord").alias("edge_type"))
    keyed = pairs.withColumns({"_a": F.least("entity_id_1", "entity_id_2"), "_b": F.greatest("entity_id_1", "entity_id_2")})
    return keyed.join(edges, [*VIEW, "_a", "_b"], "left").drop("_a", "_b").withColumn("edge_type", F.coalesce("edge_type", F.lit("none")))


def oriented(edge_type: Column) -> dict[str, Column]:
    """Source and target of a pair: to the panel, from the switch, else from left to right."""
    forward = (
        F.when(edge_type == "home_run", F.col("label_2") == fixed.PANEL)
        .when(edge_type == "switch_leg", F.col("label_1").isin(*fixed.SWITCHES))
        .otherwise((F.col("x_1") < F.col("x_2")) | ((F.col("x_1") == F.col("x_2")) & (F.col("y_1") <= F.col("y_2"))))
    )
    pick = lambda a, b: F.when(forward, F.col(f"entity_id_{a}")).otherwise(F.col(f"entity_id_{b}"))
    return {"source_id": pick(1, 2), "target_id": pick(2, 1)}


def class_weights(rows: DataFrame) -> DataFrame:
    """(edge_type, weight): all pairs over the pairs of the type; types that don't occur count as one pair."""
    spark = rows.sparkSession
    kinds = spark.createDataFrame([(k,) for k in fixed.EDGE_TYPES], "edge_type string")
    counts = rows.groupBy("edge_type").agg(F.count("*").alias("n"))
    total = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy(F.lit(1)))  # a row per type
    return kinds.join(counts, "edge_type", "left").select("edge_type", (total / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))).alias("weight"))


def fit_edges(rows: DataFrame, *, iterations: int = 50):
    """A weighted multinomial classifier on labelled pairs with features: (model, edge types in index order)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    kinds = F.array(*[F.lit(k) for k in fixed.EDGE_TYPES])
    data = rows.join(F.broadcast(class_weights(rows)), "edge_type").select(array_to_vector("features").alias("features"), (F.array_position(kinds, F.col("edge_type")) - 1).cast("double").alias("label"), "weight")
    return LogisticRegression(family="multinomial", weightCol="weight", maxIter=iterations).fit(data), fixed.EDGE_TYPES


def predicted_edges(rows: DataFrame, probabilities: Column, *, threshold: float = 0.5) -> DataFrame:
    """The most likely type of each pair if it isn't ``none`` and likely enough, with its direction and confidence."""
    best = F.array_max(probabilities)
    kind = F.element_at(F.array(*[F.lit(k) for k in fixed.EDGE_TYPES]), F.array_position(probabilities, best).cast("int"))
    rows = rows.withColumns({"edge_type": kind, "confidence": best}).where((F.col("edge_type") != "none") & (F.col("confidence") >= threshold))
    return rows.withColumns(oriented(F.col("edge_type")))


def edge_scores(rows: DataFrame) -> DataFrame:
    """F1 of each edge type from (edge_type, predicted), and the F1 of there being any edge."""
    f1 = lambda t, p: F.coalesce(2 * F.count_if(t & p) / F.nullif(F.count_if(t) + F.count_if(p), F.lit(0)), F.lit(0.0))
    kinds = [f1(F.col("edge_type") == k, F.col("predicted") == k).alias(f"f1_{k}") for k in fixed.EDGE_TYPES[1:]]
    return rows.agg(*kinds, f1(F.col("edge_type") != "none", F.col("predicted") != "none").alias("f1_any")).withColumn("macro_f1", sum(F.col(f"f1_{k}") for k in fixed.EDGE_TYPES[1:]) / (len(fixed.EDGE_TYPES) - 1))


def detect(tiles: DataFrame, predict, schema: str) -> DataFrame:
    """Plug a model in: ``predict`` takes and gives pandas frames, a batch of tiles at a time."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield predict(part)

    return tiles.mapInPandas(run, schema)
