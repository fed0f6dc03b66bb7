"""Splits that keep related records together.

Records and what they name (sources, projects) form a graph whose components must not be parted. Components are found
by breadth-first search from many seeds at once over hash-partitioned adjacency lists; the lists of nodes of high
degree are in several parts. Where the regions of two seeds meet, their labels collide; the collisions are the edges of
a smaller graph, whose labels are merged. Components are then dealt to the splits in the order of a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.common import cut
from quillspan.operators.clusters import clusters

SEED_ONE_IN = 4
ROUNDS = 3
HEAVY = 100_000  # neighbours in one part of an adjacency list
LARGE_SHARE = 0.001  # components above this share of the records, at most 1 / LARGE_SHARE of them, are dealt one by one

# Words that name no source, without blanks, hyphens and underscores.
NO_SOURCE = ("unknown", "unk", "n/a", "na", "n.a.", "none", "null", "nil", "nan", "notapplicable", "notavailable", "notknown", "notspecified", "unspecified", "undefined", "tbd", "tba")
_GAP = r"[\s_.\-‐-―]*"
_CODE = rf"(?i)(?<![a-z0-9])[a-z]{_GAP}\d{{4}}{_GAP}\d{{2}}(?!\d)"


def project_codes(c: Column) -> Column:
    """All project codes in a text, canonically ``L9999-99``."""
    plain = lambda x: F.upper(F.regexp_replace(x, r"(?i)[^a-z0-9]", ""))
    return F.transform(F.regexp_extract_all(c, F.lit(_CODE), 0), lambda x: F.concat(F.substring(plain(x), 1, 5), F.lit("-"), F.substring(plain(x), 6, 2)))


def source_name(c: Column) -> Column:
    """A source irrespective of letter case, blanks, hyphens and underscores; null if it names none."""
    word = F.regexp_replace(F.lower(c), r"(?U)[\s_\-‐-―]+", "")
    return F.when(word.rlike(r"[\p{L}\p{N}]") & ~word.isin(*NO_SOURCE), word)


def named_by(refs: DataFrame, pages: DataFrame) -> DataFrame:
    """Distinct (ref_id, node): the sources ``s:...`` and project codes ``p:...`` that a ref or a page of it names."""
    own = refs.select("ref_id", F.explode(F.concat(F.array(F.concat(F.lit("s:"), source_name(F.col("source")))), F.transform(project_codes(F.coalesce(F.col("project"), F.lit(""))), lambda x: F.concat(F.lit("p:"), x)))).alias("node"))
    paged = pages.where(F.col("sheet_no").rlike(_CODE)).select("ref_id", F.explode(project_codes(F.col("sheet_no"))).alias("code")).select("ref_id", F.concat(F.lit("p:"), "code").alias("node"))
    known = refs.select("ref_id").distinct()
    return own.unionByName(paged.join(known, "ref_id", "left_semi")).where("node IS NOT NULL AND ref_id IS NOT NULL").distinct()


def components(edges: DataFrame, *, rounds: int = ROUNDS, heavy: int = HEAVY) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b strings): equal labels are one component.

    Nodes chosen by a hash, one in ``SEED_ONE_IN``, are seeds and expand for ``rounds`` rounds; a node takes the least
    label that reaches it first, and nodes not reached keep themselves. Labels that collide are merged in the smaller
    graph of collisions, in the same way whatever its size.
    """
    apart = edges.where("a <> b")
    both = cut(apart.select("a", "b").unionByName(apart.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    nodes = both.groupBy("a").agg(F.count("*").alias("n")).select(F.col("a").alias("node"), F.ceil(F.col("n") / heavy).cast("int").alias("parts"))
    nodes = cut(nodes.unionByName(edges.where("a = b").select(F.col("a").alias("node"), F.lit(1).alias("parts"))).groupBy("node").agg(F.max("parts").alias("parts")))
    # One row for each ``heavy`` neighbours and more, so few that the engine may broadcast them if it finds them small.
    crowded = nodes.where("parts > 1").select(F.col("node").alias("a"), "parts")
    part = F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")
    adjacency = cut(both.join(crowded, "a", "left").select("a", part, "b").repartition("a", "part"))
    labels = cut(nodes.where(F.pmod(F.xxhash64("node"), F.lit(SEED_ONE_IN)) == 0).select("node", "parts", F.col("node").alias("label"), F.lit(0).alias("round")))
    for k in range(rounds):
        frontier = labels.where(F.col("round") == k).select(F.col("node").alias("a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "label")
        reached = adjacency.join(frontier, ["a", "part"]).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("label"))
        fresh = reached.join(labels.select("node"), "node", "left_anti").join(nodes, "node").select("node", "parts", "label", F.lit(k + 1).alias("round"))
        labels = cut(labels.unionByName(fresh))
    labels = cut(nodes.select("node").join(labels.select("node", "label"), "node", "left").select("node", F.coalesce("label", "node").alias("label")))
    left, right = labels.select(F.col("node").alias("a"), F.col("label").alias("x")), labels.select(F.col("node").alias("b"), F.col("label").alias("y"))
    collided = both.where("a < b").join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    merged = clusters(collided).select(F.col("node").alias("label"), F.col("label").alias("root"))
    return cut(labels.join(merged, "label", "left").select("node", F.coalesce("root", "label").alias("label")))


def grouped(refs: DataFrame, pages: DataFrame, **options) -> DataFrame:
    """(ref_id, component, code): every ref once, with its component and the least project code in it (or null).

    A component is called by its least code, without one by its least source (``s:``), and a ref that names nothing is
    a component of its own (``r:`` and its id). Nulls: a null ref_id names no record and is left out; null,
    blank and meaningless sources and projects without a code name nothing. Pages of refs that aren't there count for
    nothing. Rows delivered twice count once.
    """
    names = cut(named_by(refs, pages))
    hub = names.groupBy("ref_id").agg(F.min("node").alias("hub"))
    edges = names.join(hub, "ref_id").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    labels = components(cut(edges), **options)
    code = labels.groupBy("label").agg(F.min(F.when(F.col("node").startswith("p:"), F.substring("node", 3, 8))).alias("code"), F.min("node").alias("least"))
    of = hub.join(labels, F.col("hub") == F.col("node")).select("ref_id", "label")
    known = refs.where("ref_id IS NOT NULL").select("ref_id").distinct()
    return known.join(of, "ref_id", "left").join(code, "label", "left").select("ref_id", F.coalesce("code", "least", F.concat(F.lit("r:"), F.col("ref_id").cast("string"))).alias("component"), "code")


def related(refs: DataFrame, pages: DataFrame, **options) -> DataFrame:
    """(ref_id, group_key) of every ref that is tied to another one; the key is the least code in the group."""
    rows = cut(grouped(refs, pages, **options))
    many = rows.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(many, "component", "left_semi").select("ref_id", F.coalesce("code", "component").alias("group_key"))


def split(rows: DataFrame, shares: list[tuple[str, float]], *, seed: int = 0) -> DataFrame:
    """(ref_id, component, split_name) for ``rows`` (ref_id, component): whole components, at the given shares of rows.

    Components are dealt in the order of a hash of their names. Those above ``LARGE_SHARE`` of all rows are measured
    against what each split still lacks and go where most is missing; the others, in the same order, fill what is left
    missing after that. Shares are met to about one small component each, unless a component is larger than a split.
    Null and non-positive shares get nothing; shares need not add up to 1.
    """
    spark = rows.sparkSession
    shares = sorted(((s, float(w)) for s, w in shares if s is not None and w is not None and w > 0), key=lambda x: (-x[1], x[0]))
    sizes = cut(rows.groupBy("component").agg(F.count("*").alias("n")).withColumn("h", F.sha1(F.concat(F.lit(f"{seed}:"), "component"))))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    if not shares or not total:
        return rows.select("ref_id", "component", F.lit(None).cast("string").alias("split_name"))
    whole = sum(w for _, w in shares)
    missing = {s: w / whole * total for s, w in shares}
    large = sizes.where(F.col("n") > LARGE_SHARE * total)
    chosen = []  # at most 1 / LARGE_SHARE rows, whatever the data's size
    for r in sorted(large.collect(), key=lambda r: (r.h, r.component)):
        to = max(missing, key=lambda s: missing[s])
        missing[to] -= r.n
        chosen.append((r.component, to))
    dealt = F.broadcast(spark.createDataFrame(chosen, "component string, split_name string"))
    small = sizes.where(F.col("n") <= LARGE_SHARE * total).select("component", "n", "h", F.substring("h", 1, 3).alias("bucket"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = small.groupBy("bucket").agg(F.sum("n").alias("s"))  # 4096 rows
    starts = sums.select("bucket", F.coalesce(F.sum("s").over(before(Window.partitionBy(F.lit(1)).orderBy("bucket"))), F.lit(0)).alias("start"))
    at = F.col("start") + F.coalesce(F.sum("n").over(before(Window.partitionBy("bucket").orderBy("h", "component"))), F.lit(0)) + F.col("n") / 2
    left = float(small.agg(F.sum("n")).first()[0] or 0)
    wanted = [(s, max(m, 0.0)) for s, m in missing.items()]
    scale = left / (sum(m for _, m in wanted) or 1.0)
    ends, end = [], 0.0
    for s, m in wanted:
        end += m * scale
        ends.append((s, end))
    name = F.lit(max(wanted, key=lambda x: x[1])[0])
    for s, end in reversed(ends):
        name = F.when(F.col("at") < end, s).otherwise(name)
    few = small.join(F.broadcast(starts), "bucket").withColumn("at", at).select("component", name.alias("split_name"))
    return rows.join(few.unionByName(dealt), "component").select("ref_id", "component", "split_name")
