"""References to records that do not exist (any more, or yet).

Keys of parents and references are range-partitioned together by (key, time). Each range holds its parents as
a sorted array and probes its references against it by binary search. A range knows the last parent before it
and the first parent after it, so a key that spans several ranges (one key may hold any share of the rows) is
answered without bringing it together in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.common import cut, partitions

ROWS_PER_RANGE = 400_000
_LIVE, _DELETED, _REFERENCE = 0, 1, 2
_MIN, _MAX = -(2**63), 2**63 - 1
_BLOCK = 1000  # ranges whose ends are handed on together
_PROBED = "range int, code int, row_key binary, t bigint, reason string, key binary, asks_before boolean, asks_after boolean"


@dataclass(frozen=True)
class References:
    """Columns of ``frame`` that refer to parents: each of ``fields`` is one reference of the row ``row_key``."""

    table_name: str
    frame: DataFrame
    row_key: str
    fields: tuple[str, ...]
    scope: str
    at: str


def normalized_id(c: Column) -> Column:
    """Ids are compared without regard to case, hyphens and blanks."""
    return F.lower(F.regexp_replace(c, r"(?U)[\s\-‐-―]+", ""))


def _packed(c: Column) -> Column:
    """Bytes that stand for one string only and follow each other unambiguously; 32 hex digits take 17 bytes."""
    raw = F.concat(F.unhex(F.lit("00")), F.encode(c, "utf-8"), F.unhex(F.lit("FF")))
    return F.when(c.rlike("^[0-9a-f]{32}$"), F.concat(F.unhex(F.lit("01")), F.unhex(c))).otherwise(raw)


def _unpacked(c: Column) -> Column:
    return F.when(F.hex(F.substring(c, 1, 1)) == "01", F.lower(F.hex(F.expr("substring(row_key, 2)")))).otherwise(
        F.decode(F.expr("substring(row_key, 2, length(row_key) - 2)"), "utf-8")
    )


def _micros(c: Column, missing: int) -> Column:
    return F.coalesce(F.unix_micros(c.cast("timestamp")), F.lit(missing))


def orphans(parents: DataFrame, references: list[References], *, key: str, scope: str, at: str, deleted: str) -> DataFrame:
    """One row (table_name, row_key, ref_field, reason, at) per reference without a live parent at its time.

    ``reason`` is ``missing`` (the scope has no row of that id at all), ``late`` (only rows recorded after the
    reference) or ``deleted`` (a newest row recorded at or before the reference is a withdrawal).

    Nulls: a null or blank reference is none; a reference with a null scope is ``missing``; without a time it is
    judged against the final state. Parents with a null id or scope match nothing; without a time they count as
    always recorded; a null ``deleted`` is false. Of several newest parent rows with equal times, a withdrawal
    wins. Rows delivered repeatedly give one result row. Empty inputs give an empty result.
    """
    names = [(r.table_name, f) for r in references for f in r.fields]
    null_scope = F.unhex(F.lit("02"))
    parent_rows = parents.select(
        F.concat(_packed(normalized_id(F.col(key))), _packed(F.col(scope))).alias("key"),
        _micros(F.col(at), _MIN).alias("t"),
        F.when(F.col(deleted), _DELETED).otherwise(_LIVE).alias("kind"),
        F.lit(-1).alias("code"),
        F.lit(None).cast("binary").alias("row_key"),
    ).where(F.col("key").isNotNull())
    rows = parent_rows
    for r in references:
        each = F.explode(F.array(*[F.struct(F.lit(names.index((r.table_name, f))).alias("code"), F.col(f).cast("string").alias("id")) for f in r.fields]))
        rows = rows.unionByName(
            r.frame.select(F.col(r.scope).alias("scope"), F.col(r.row_key).cast("string").alias("rk"), F.col(r.at).alias("at"), each.alias("ref"))
            .where(~F.col("ref.id").rlike(r"(?U)^\s*$"))
            .select(
                F.concat(_packed(normalized_id(F.col("ref.id"))), F.coalesce(_packed(F.col("scope")), null_scope)).alias("key"),
                _micros(F.col("at"), _MAX).alias("t"),
                F.lit(_REFERENCE).alias("kind"),
                F.col("ref.code").alias("code"),
                _packed(F.coalesce(F.col("rk"), F.lit(""))).alias("row_key"),
            )
        )
    spark = parents.sparkSession
    total = parents.count() + sum(r.frame.count() * len(r.fields) for r in references)  # from the files' footers
    n = partitions(spark, total, ROWS_PER_RANGE)
    # The row's key is part of the range, so that references of one key and time may be in several ranges as well.
    order = ("key", "t", "kind", "row_key")
    ranged = cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order)).withColumn("range", F.spark_partition_id())
    found = ranged.mapInArrow(_probe, _PROBED)
    # What a range can't know alone: whether its first key has parents in earlier ranges, its last one in later ones.
    asked = found.where("asks_before OR asks_after").join(_neighbours(ranged), "range", "left")
    before, after = F.coalesce(F.col("asks_before") & (F.col("key") == F.col("key_before")), F.lit(False)), F.coalesce(F.col("asks_after") & (F.col("key") == F.col("key_after")), F.lit(False))
    gone = F.col("kind_before") == _DELETED
    reason = F.when(before & gone, "deleted").when(before, None).when(after | (F.col("reason") == "late"), "late").otherwise("missing")
    every = found.where("NOT (asks_before OR asks_after)").select("code", "row_key", "t", "reason").unionByName(asked.select("code", "row_key", "t", reason.alias("reason"))).where("reason IS NOT NULL")
    pairs = F.array(*[F.struct(F.lit(t).alias("table_name"), F.lit(f).alias("ref_field")) for t, f in names])
    return every.select(
        F.element_at(pairs, F.col("code") + 1).alias("n"),
        _unpacked(F.col("row_key")).alias("row_key"),
        "reason",
        F.when(F.col("t") != _MAX, F.timestamp_micros("t")).alias("at"),
    ).select("n.table_name", "row_key", "n.ref_field", "reason", "at").distinct()


def _neighbours(ranged: DataFrame) -> DataFrame:
    """Of each range the key and kind of the last parent in earlier ranges, and the key of the first in later ones.

    One row a range, so one for ``ROWS_PER_RANGE`` rows. They are handed on within blocks of ranges and between blocks,
    so no task has more of them than a block, or there are blocks.
    """
    parent = F.col("kind") < _REFERENCE
    edges = ranged.groupBy("range").agg(F.min(F.when(parent, F.col("key"))).alias("first"), F.max(F.when(parent, F.struct("key", "t", "kind"))).alias("last"))
    edges = edges.withColumn("block", F.floor(F.col("range") / _BLOCK))
    known = lambda f, c, w: f(c, ignorenulls=True).over(w)
    earlier = lambda *by, at: Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    later = lambda *by, at: Window.partitionBy(*by).orderBy(at).rowsBetween(1, Window.unboundedFollowing)
    own = edges.select("range", "block", known(F.last, "last", earlier("block", at="range")).alias("b"), known(F.first, "first", later("block", at="range")).alias("a"))
    whole = edges.groupBy("block").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    one = F.lit(1)
    between = whole.select("block", known(F.last, "last", earlier(one, at="block")).alias("bb"), known(F.first, "first", later(one, at="block")).alias("aa"))
    both = own.join(between, "block").select("range", F.coalesce("b", "bb").alias("b"), F.coalesce("a", "aa").alias("key_after"))
    return both.select("range", F.col("b.key").alias("key_before"), F.col("b.kind").alias("kind_before"), "key_after")


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """References of one range without a live parent in it, by binary search in its sorted parents."""
    got = list(batches)
    if not got:
        return
    rows = pa.Table.from_batches(got).combine_chunks()
    if not rows.num_rows:
        return
    keys = rows.column("key").chunk(0)
    kind = rows.column("kind").to_numpy()
    new = np.zeros(len(keys), dtype=np.int64)
    new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
    group = np.cumsum(new)
    parents, refs = np.nonzero(kind < _REFERENCE)[0], np.nonzero(kind == _REFERENCE)[0]
    if not len(refs):
        return
    at = np.searchsorted(parents, refs)  # parents[:at] are recorded at or before the reference, or of lesser keys
    ref_group = group[refs]

    def same(index):
        inside = (index >= 0) & (index < len(parents))
        hit = np.zeros(len(refs), dtype=bool)
        hit[inside] = group[parents[index[inside]]] == ref_group[inside]
        return hit

    earlier, later = same(at - 1), same(at)
    deleted = np.zeros(len(refs), dtype=bool)
    deleted[earlier] = kind[parents[at[earlier] - 1]] == _DELETED
    asks_before = ~earlier & (ref_group == 0)
    asks_after = ~earlier & ~later & (ref_group == group[-1])
    orphan = ~earlier | deleted
    reason = np.where(earlier, 2, np.where(later, 1, 0))[orphan]
    out = rows.take(pa.array(refs[orphan]))
    names = pa.array(["missing", "late", "deleted"]).take(pa.array(reason))
    asks = asks_before[orphan], asks_after[orphan]
    key = pc.if_else(pa.array(asks[0] | asks[1]), out.column("key"), None)  # the others need it no more
    table = pa.table({"range": out.column("range"), "code": out.column("code"), "row_key": out.column("row_key"), "t": out.column("t"), "reason": names, "key": key, "asks_before": pa.array(asks[0]), "asks_after": pa.array(asks[1])})
    yield from table.to_batches(max_chunksize=50_000)


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphan references per table, field, reason and month of the referring row (null month: it has no time)."""
    return found.groupBy("table_name", "ref_field", "reason", F.date_format("at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n_orphans"))
