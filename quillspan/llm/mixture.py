"""Mixing sources to target weights by Pfair scheduling.

The mixture is a sequence of slots of one block of tokens each. Block j of a source of weight w is released at slot
floor(j / w) and due at ceil((j + 1) / w); of the released blocks the one due first gets the slot. Weights are whole
multiples of a quantum, so the schedule repeats after a fixed number of slots: it is made once, whatever the size of
the mixture, and every document finds its slot by arithmetic on its offset in its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUANTA = 10_000  # slots in a period; shares are met to one part in as many
BLOCK_TOKENS = 8192
_BUCKETS = 1024


def canonical(c: Column) -> Column:
    """A source in whatever spelling: letter case, blanks, hyphens and underscores don't matter."""
    return F.regexp_replace(F.lower(c), r"(?U)[\s_\-]+", "")


def quantised(shares: list[float], quanta: int = QUANTA) -> list[int]:
    """Whole numbers of quanta by largest remainders; they add up to ``quanta``."""
    total = sum(shares)
    exact = [s / total * quanta for s in shares]
    whole = [int(x) for x in exact]
    for k in sorted(range(len(exact)), key=lambda k: (whole[k] - exact[k], k))[: quanta - sum(whole)]:
        whole[k] += 1
    return whole


def schedule(weights: list[int]) -> list[int]:
    """The source of each slot of one period: earliest deadline first among the released blocks."""
    period = sum(weights)
    given, out = [0] * len(weights), []
    for slot in range(period):
        ready = [(-(-(given[k] + 1) * period // w), k) for k, w in enumerate(weights) if w and given[k] < w and given[k] * period // w <= slot]
        _, k = min(ready)
        given[k] += 1
        out.append(k)
    return out


def mixture(sizes: DataFrame, targets: list[tuple[str, float, int]], *, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(slot, source, doc_id, use, offset, n_tokens) of every use of a document; order by slot, offset for the mixture.

    ``sizes`` has doc_id, source (canonical) and n_tokens, ``targets`` source, share and the most uses of a document.
    The mixture is the largest in which every source reaches its share: sources that are too small for it are
    repeated, none above its cap. Within a source documents come in the order of a hash of their ids, all of them
    once before any again; the use that crosses the end of a source's part is taken if most of it is within, so a share
    is met to half a document. Sources without targets and documents without tokens stay out; a target source without
    tokens, or of share 0, gets nothing, and the others keep their proportions. Equal rows are documents of their own.
    """
    spark = sizes.sparkSession
    sizes = sizes.where("n_tokens > 0").select("doc_id", "source", "n_tokens", F.xxhash64("doc_id").alias("h"))
    sizes = sizes.where(F.col("source").isin(*[s for s, _, _ in targets]))
    # As many rows as there are targets.
    have = {r.source: r.n for r in sizes.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    used = [(s, share, cap) for s, share, cap in targets if have.get(s) and share and share > 0 and cap and cap > 0]
    if not used:
        return sizes.select(F.lit(0).cast("bigint").alias("slot"), "source", "doc_id", F.lit(0).alias("use"), F.lit(0).cast("bigint").alias("offset"), "n_tokens").where("false")
    whole = sum(share for _, share, _ in used)
    total = min(have[s] * cap * whole / share for s, share, cap in used)
    weights = quantised([share for _, share, _ in used])
    plan = [(s, have[s], int(total * share / whole), cap, w) for (s, share, cap), w in zip(used, weights)]
    dims = F.broadcast(spark.createDataFrame(plan, "source string, available bigint, quota bigint, cap int, weight bigint"))  # a row per target
    given: dict[int, int] = {}
    slots = []
    for slot, k in enumerate(schedule(weights)):
        slots.append((used[k][0], given.get(k, 0), slot))
        given[k] = given.get(k, 0) + 1
    period = F.broadcast(spark.createDataFrame(slots, "source string, nth bigint, slot_in_period bigint"))  # QUANTA rows

    bucket = F.shiftrightunsigned("h", 54).cast("int")
    rows = sizes.withColumn("bucket", bucket)
    sums = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "bucket", F.coalesce(F.sum("n").over(before("source").orderBy("bucket")), F.lit(0)).alias("start"))
    within = F.coalesce(F.sum("n_tokens").over(before("source", "bucket").orderBy(F.expr("h & 18014398509481983"), "doc_id")), F.lit(0))
    placed = rows.withColumn("within", within).join(F.broadcast(starts), ["source", "bucket"])  # at most _BUCKETS rows a target
    placed = placed.join(dims, "source").withColumn("begin", F.col("start") + F.col("within"))
    # The use that crosses the quota is taken if that is nearer to it than leaving it out.
    uses = F.least(F.ceil((F.col("quota") - F.col("begin") - F.col("n_tokens") / 2) / F.col("available")), F.col("cap").cast("bigint"))
    each = placed.where(uses > 0).withColumn("use", F.explode(F.sequence(F.lit(0), (uses - 1).cast("int"))))
    each = each.withColumn("offset", F.col("begin") + F.col("use") * F.col("available"))
    block = F.floor(F.col("offset") / block_tokens)
    each = each.withColumn("nth", block % F.greatest(F.col("weight"), F.lit(1))).withColumn("turn", F.floor(block / F.greatest(F.col("weight"), F.lit(1))))
    # A share below half a quantum has no block in the period; its blocks go to the period's end.
    return each.join(period, ["source", "nth"], "left").select(
        (F.col("turn") * QUANTA + F.coalesce("slot_in_period", F.lit(QUANTA - 1))).cast("bigint").alias("slot"), "source", "doc_id", "use", "offset", "n_tokens"
    )


def shares(mixed: DataFrame, targets: list[tuple[str, float, int]]) -> DataFrame:
    """(source, target_share, share, n_tokens, n_uses, n_docs, max_uses, max_repeats) of each target source."""
    spark = mixed.sparkSession
    dims = spark.createDataFrame([(s, float(share or 0), cap) for s, share, cap in targets], "source string, target_share double, max_repeats int")
    # First by document, so that a source's distinct documents are counted without bringing it together.
    by_doc = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.sum("n_tokens").alias("n"))
    got = by_doc.groupBy("source").agg(F.sum("n").alias("n_tokens"), F.sum("uses").alias("n_uses"), F.count("*").alias("n_docs"), F.max("uses").alias("max_uses"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    all_tokens = F.sum("n_tokens").over(Window.partitionBy(F.lit(1)))  # a row per target
    return dims.join(got, "source", "left").select("source", "target_share", F.coalesce(F.col("n_tokens") / all_tokens, F.lit(0.0)).alias("share"), zero("n_tokens"), zero("n_uses"), zero("n_docs"), zero("max_uses"), "max_repeats")


def violations(mixed: DataFrame, sizes: DataFrame, targets: list[tuple[str, float, int]]) -> DataFrame:
    """(source, item, problem) of uses that break a rule; ``item`` is the document, or null for a whole source.

    No document is used more often than its cap, none again before all of its source were used once, and a source's
    share is off by no more than half the largest documents, its own and in proportion those of all, and a quantum.
    """
    spark = mixed.sparkSession
    dims = F.broadcast(spark.createDataFrame([(s, float(w or 0), cap) for s, w, cap in targets], "source string, target_share double, cap int"))  # a row per target
    by_doc = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.countDistinct("use").alias("turns"), F.max("use").alias("last"), F.sum("n_tokens").alias("n"))
    by_doc = by_doc.join(dims, "source")
    largest = sizes.groupBy("source").agg(F.max("n_tokens").alias("largest"))
    over = by_doc.where("uses > cap OR uses <> turns OR uses <> last + 1").select("source", F.col("doc_id").alias("item"), F.lit("uses").alias("problem"))
    totals = by_doc.groupBy("source", "target_share").agg(F.sum("n").alias("n"), F.min("uses").alias("least"), F.max("uses").alias("most")).join(largest, "source")
    whole = F.sum("n").over(Window.partitionBy(F.lit(1)))  # a row per target
    share = totals.withColumns({"off": F.abs(F.col("n") / whole - F.col("target_share") / F.sum("target_share").over(Window.partitionBy(F.lit(1)))), "slack": (F.col("largest") + F.col("target_share") * F.sum("largest").over(Window.partitionBy(F.lit(1)))) / 2 / whole + 1 / QUANTA})
    far = share.where("off > slack").select("source", F.lit(None).cast("bigint").alias("item"), F.lit("share").alias("problem"))
    early = share.where("most - least > 1").select("source", F.lit(None).cast("bigint").alias("item"), F.lit("order").alias("problem"))
    return over.unionByName(far).unionByName(early)
