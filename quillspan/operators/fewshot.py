"""Few-shot classification of vectors by class prototypes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; written out, it would be computed at each use inside a lambda."""
    return F.transform(F.array(value), body)[0]


def unit(v: Column) -> Column:
    """A vector of length one; one of zeros stays as it is."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return let(length, lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def prototypes(exemplars: DataFrame) -> DataFrame:
    """(label, prototype, ord) of exemplars (label, vector, ord): the normalised mean of the normalised vectors.

    Means are aggregates per label and dimension, so a label of any size is summed in parts.
    """
    each = exemplars.where("label IS NOT NULL AND vector IS NOT NULL").select("label", "ord", F.posexplode(unit(F.col("vector"))).alias("d", "x"))
    means = each.groupBy("label", "d").agg(F.avg("x").alias("x"), F.min("ord").alias("ord"))
    return means.groupBy("label").agg(unit(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda p: p["x"])).alias("prototype"), F.min("ord").alias("ord"))


_BLOCK = 2048  # prototypes that travel with the plan at once


def classify(queries: DataFrame, protos: DataFrame, *, floor: float = 0.55) -> DataFrame:
    """(vec_id, label, similarity): the nearest prototype, the first one of equals; below the floor the label is null.

    Prototypes are folded into an array of one row that is broadcast, so queries are never shuffled. Their number is
    counted first: beyond ``_BLOCK`` there is a pass over the queries for each block, and the best of all blocks holds.
    """
    n_blocks = max(1, -(-protos.count() // _BLOCK))
    if n_blocks == 1:
        best = _nearest(queries, protos)
    else:
        blocks = [_nearest(queries, protos.where(F.pmod(F.xxhash64("label"), F.lit(n_blocks)) == k)) for k in range(n_blocks)]
        every = blocks[0]
        for b in blocks[1:]:
            every = every.unionByName(b)
        best = every.groupBy("vec_id").agg(F.max_by(F.struct("s", "ord", "label"), F.struct("s", -F.col("ord"))).alias("b")).select("vec_id", "b.s", "b.ord", "b.label")
    return best.select("vec_id", F.when(F.col("s") >= floor, F.col("label")).alias("label"), F.col("s").alias("similarity"))


def _nearest(queries: DataFrame, protos: DataFrame) -> DataFrame:
    table = protos.agg(F.array_sort(F.collect_list(F.struct("ord", "label", "prototype"))).alias("protos"))
    none = F.struct(F.lit(-1.0).alias("s"), F.lit(None).cast("long").alias("ord"), F.lit(None).cast("string").alias("label"))

    def nearest(q: Column) -> Column:
        sims = F.transform(F.col("protos"), lambda p: F.struct(dot(q, p["prototype"]).alias("s"), p["ord"].cast("long").alias("ord"), p["label"].cast("string").alias("label")))
        return F.aggregate(sims, none, lambda b, x: F.when(x["s"] > b["s"], x).otherwise(b))

    return queries.join(F.broadcast(table)).withColumn("b", let(unit(F.col("vector")), nearest)).select("vec_id", "b.s", "b.ord", "b.label")
