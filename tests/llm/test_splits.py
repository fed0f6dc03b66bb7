import random

import pytest
from pyspark.sql import functions as F

from quillspan.llm import splits as S
from tests.conftest import rows

REFS = "ref_id bigint, source string, project string, url string, component string, label string"
PAGES = "ref_id bigint, page int, sheet_no string, node string"


def refs(spark, items):
    return spark.createDataFrame([(r, s, p, "u", "x", "y") for r, s, p in items], REFS)


def pages(spark, items):
    return spark.createDataFrame([(r, k, n, "z") for k, (r, n) in enumerate(items)], PAGES)


def merged(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    groups = {}
    for x in parent:
        groups.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize(("shape", "heavy"), [("chain", 100_000), ("star", 7), ("random", 2), ("loops", 1)])
def test_components(spark, shape, heavy):
    rng = random.Random(shape)
    edges = {
        "chain": [(f"n{k:03}", f"n{k + 1:03}") for k in range(40)],
        "star": [("hub", f"n{k}") for k in range(60)] * 2,
        "random": [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(40)],
        "loops": [("a", "a"), ("b", "c"), ("c", "b"), ("d", "d")],
    }[shape]
    got = {}
    for node, label in rows(S.components(spark.createDataFrame(edges, "a string, b string"), heavy=heavy)):
        got.setdefault(label, []).append(node)
    assert sorted(map(sorted, got.values())) == merged(edges)


def test_codes_and_sources(spark):
    texts = ["x1234-56", "Project X 1234 56", "X-1234-56_Plans", "x1234.56", "X1234–56", "X123456/E-403", "C-312 (X1234_56)", " X1234 56 and Y9999-01 ", "AX1234-56", "X1234-567", "E-411", "", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r.c for r in df.orderBy("k").select(S.project_codes(F.col("t")).alias("c")).collect()]
    assert got[:7] == [["X1234-56"]] * 7 and got[7] == ["X1234-56", "Y9999-01"] and got[8:] == [[], [], [], [], None]
    names = ["City-Parks", "CITY_PARKS ", "city parks\t", "n/a", "N/A", "Unknown", " ", "-", None, "not applicable"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(names)], "k int, t string")
    assert [r.c for r in df.orderBy("k").select(S.source_name(F.col("t")).alias("c")).collect()] == ["cityparks"] * 3 + [None] * 7


def test_groups(spark):
    items = [(1, "A b", "x1000-01"), (2, "a-B", None), (3, None, "plans"), (4, "unknown", "Y2000-02"), (5, "c", None), (6, "n/a", "none"), (7, None, "Z3000-03"), (1, "A b", "x1000-01"), (None, "c", None)]
    sheets = [(3, "E-1 (Y2000 02)"), (5, "X1000-01/A-1"), (5, None), (99, "Z3000-03")]
    got = rows(S.related(refs(spark, items), pages(spark, sheets)))
    assert got == [(1, "X1000-01"), (2, "X1000-01"), (3, "Y2000-02"), (4, "Y2000-02"), (5, "X1000-01")]
    every = rows(S.grouped(refs(spark, items), pages(spark, sheets)), "ref_id")
    assert every == [(k,) for k in range(1, 8)]


def test_empty(spark):
    assert S.related(refs(spark, []), pages(spark, [])).count() == 0
    assert S.split(S.grouped(refs(spark, []), pages(spark, [])), [("train", 1.0)]).count() == 0


def test_shares_are_met_and_nothing_is_parted(spark):
    rng = random.Random(4)
    labels = ["hot"] * 3000 + [f"c{rng.randrange(900)}" for _ in range(6000)]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(labels)], "ref_id int, component string")
    got = S.split(df, [("train", 0.8), ("validation", 0.1), ("test", 0.1), ("none", None), ("zero", 0.0)])
    n = {r.split_name: r["count"] for r in got.groupBy("split_name").count().collect()}
    assert sum(n.values()) == 9000 and n == pytest.approx({"train": 7200, "validation": 900, "test": 900}, abs=30)
    assert got.groupBy("component").agg(F.countDistinct("split_name").alias("n")).where("n > 1").count() == 0
    assert rows(got) == rows(S.split(df.repartition(7), [("train", 0.8), ("validation", 0.1), ("test", 0.1)]))
