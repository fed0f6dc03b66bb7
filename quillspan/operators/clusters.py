"""Connected components of many small clusters, such as boxes that contend for each other.

Each partition joins its own edges first, which leaves one label a partition and cluster. Nodes met in several
partitions tie these labels together: the ties are the edges of a smaller graph. There every node goes to the neighbour
(or itself) of the least hash, which leaves a fraction of the nodes, and so on until no ties are left: the number of
levels grows with the logarithm of the graph's size, not with the length of its paths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.common import cut


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of one partition's edges (a, b): the label is the least node of the cluster."""
    got = list(batches)
    rows = pa.Table.from_batches(got) if got else None
    if rows is None or not rows.num_rows:
        return
    coded = pa.chunked_array([*rows.column(0).chunks, *rows.column(1).chunks]).combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    ends = rank[coded.indices.to_numpy()]
    a, b = ends[: rows.num_rows], ends[rows.num_rows :]
    label = np.arange(len(order))
    while True:
        # The least label of either end goes to both ends and to what they were labelled with, and paths are halved.
        least = np.minimum(label[a], label[b])
        before = label.copy()
        for at in (a, b, before[a], before[b]):
            np.minimum.at(label, at, least)
        label = label[label]
        if (label == before).all():
            break
    nodes = coded.dictionary.take(pa.array(order))
    table = pa.table({"node": nodes, "label": nodes.take(pa.array(label))})
    yield from table.to_batches(max_chunksize=100_000)


def clusters(edges: DataFrame, *, level: int = 0) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b: bigint or string): equal labels are one cluster.

    Repeated edges and loops do no harm; without edges there are no rows. Nulls are no nodes.
    """
    kind = edges.schema["a"].dataType.simpleString()
    parts = cut(edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").mapInArrow(_joined, f"node {kind}, label {kind}"))
    least = parts.groupBy("node").agg(F.min("label").alias("label"), F.count("*").alias("n"))
    several = least.where("n > 1").select("node", F.col("label").alias("b"))
    ties = cut(parts.join(several, "node").where("label <> b").select(F.col("label").alias("a"), "b").distinct())
    one = least.select("node", "label")
    if ties.isEmpty():
        return one
    h = lambda c: F.xxhash64(F.lit(level), c)
    both = ties.unionByName(ties.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("a").agg(F.min(F.struct(h(F.col("b")).alias("h"), F.col("b").alias("to"))).alias("best"))
    hooked = cut(near.select(F.col("a").alias("label"), F.least(F.col("best"), F.struct(h(F.col("a")).alias("h"), F.col("a").alias("to")))["to"].alias("hook")))
    end = lambda c: hooked.select(F.col("label").alias(c), F.col("hook").alias(f"{c}_hook"))
    left = ties.join(end("a"), "a").join(end("b"), "b").where("a_hook <> b_hook").select(F.col("a_hook").alias("a"), F.col("b_hook").alias("b"))
    roots = clusters(left, level=level + 1).select(F.col("node").alias("hook"), F.col("label").alias("root"))
    found = cut(hooked.join(roots, "hook", "left").select("label", F.coalesce("root", "hook").alias("root")))
    return one.join(found, "label", "left").select("node", F.coalesce("root", "label").alias("label"))
