import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspan.operators.clusters import _joined, clusters
from tests.conftest import rows


def naive(edges):
    of = {}
    for a, b in edges:
        x, y = of.setdefault(a, {a}), of.setdefault(b, {b})
        if x is not y:
            x |= y
            for n in y:
                of[n] = x
    return {frozenset(v) for v in of.values()}


def found(df):
    out = {}
    for node, label in rows(df):
        assert node not in out.get(label, set())
        out.setdefault(label, set()).add(node)
    return {frozenset(v) for v in out.values()}


def test_edges_over_many_partitions(spark):
    rng = random.Random(5)
    path = [(k, k + 1) for k in range(60)]
    edges = path + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(25)] + [(7, 7), (500, 501), (500, 501)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    assert found(clusters(df.repartition(1))) == naive(edges)
    # Edges that are apart and stay apart have to be tied level by level.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        text = df.repartition(16).select(F.concat(F.lit("n"), "a").alias("a"), F.concat(F.lit("n"), "b").alias("b"))
        assert found(clusters(text)) == naive([(f"n{a}", f"n{b}") for a, b in edges])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert clusters(df.where("false")).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcdefgh"), st.sampled_from("abcdefgh")), max_size=20))
def test_edges_of_one_partition(edges):
    batch = pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in edges], pa.string()), "b": pa.array([b for _, b in edges], pa.string())})
    got = {}
    for part in _joined(iter([batch])):
        for node, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            got.setdefault(label, set()).add(node)
    assert {frozenset(v) for v in got.values()} == naive(edges)
    assert all(label == min(own) for label, own in got.items())
