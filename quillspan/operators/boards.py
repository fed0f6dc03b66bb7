"""Results of evaluations: aggregation over seeds, ranking, splits by hash and validation of expected contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import fixed
from quillspan.functions.geometry import bounds, center
from quillspan.operators.metrics import LOWER_IS_BETTER


def t95(df: Column) -> Column:
    table = F.array(*[F.lit(v) for v in fixed.T95])
    return F.when(df <= 0, 0.0).when(df > len(fixed.T95), 1.96).otherwise(F.try_element_at(table, df.cast("int")))


def over_seeds(results: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean, sample deviation, half-width and ends of the 95 % interval and number of values; one value has no spread."""
    out = results.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.count(value).alias("n"))
    out = out.withColumn("ci95", F.when(F.col("n") > 1, t95(F.col("n") - 1) * F.col("std") / F.sqrt("n")).otherwise(0.0))
    return out.withColumns({"low": F.col("mean") - F.col("ci95"), "high": F.col("mean") + F.col("ci95")})


def ranked(results: DataFrame) -> DataFrame:
    """Ranks within metric and drawing type, best first in the metric's direction, earlier rows (ord) first of equals."""
    key = F.when(F.col("metric").isin(*LOWER_IS_BETTER), F.col("value")).otherwise(-F.col("value"))
    return results.withColumn("rank", F.row_number().over(Window.partitionBy("metric", "drawing_type").orderBy(key, "ord")))


def query_results(results: DataFrame, *, metric: str | None = None, drawing_type: str | None = None) -> DataFrame:
    for column, value in (("metric", metric), ("drawing_type", drawing_type)):
        if value is not None:
            results = results.where(F.col(column) == value)
    return results


def hash_split(names: DataFrame, name: Column, *, val_fraction: float, seed: int) -> DataFrame:
    """Names with ``split``: val if the first 60 bits of a SHA-1 of seed and name are below the fraction."""
    bits = F.conv(F.substring(F.sha1(F.concat(F.lit(f"{seed}:"), name)), 1, 15), 16, 10).cast("decimal(20,0)").cast("double")
    return names.withColumn("split", F.when(bits / float(1 << 60) < val_fraction, "val").otherwise("train"))


def count_issues(expected: DataFrame, actual: DataFrame, *, kind: str = "entity") -> DataFrame:
    """(set_id, sheet_number, code, label, expected, got): expected counts (set_id, sheet_number, label, n) not met.

    Sheets that aren't there are ``missing_sheet``; on the others each expected label is compared, and so is the
    total, which shows what is there beyond the expected.
    """
    key = ["set_id", "sheet_number"]
    there = actual.select(*key).distinct().withColumn("there", F.lit(True))
    e = expected.join(there, key, "left")
    null_text, null_n = F.lit(None).cast("string"), F.lit(None).cast("long")
    row = lambda code, label, want, got: [*key, F.lit(code).alias("code"), label.alias("label"), want.alias("expected"), got.alias("got")]
    missing = e.where("there IS NULL").select(*key).distinct().select(*row("missing_sheet", null_text, null_n, null_n))
    present = e.where("there")
    got = present.join(actual.withColumnRenamed("n", "got"), [*key, "label"], "left").withColumn("got", F.coalesce("got", F.lit(0).cast("long")))
    wrong = got.where("got <> n").select(*row(f"{kind}_count", F.col("label"), F.col("n").cast("long"), F.col("got")))
    total = present.groupBy(*key).agg(F.sum("n").alias("want")).join(actual.groupBy(*key).agg(F.sum("n").alias("have")), key)
    totals = total.where("want <> have").select(*row(f"{kind}_total", null_text, F.col("want"), F.col("have")))
    return missing.unionByName(wrong).unionByName(totals)


def placement_issues(expected: DataFrame, entities: DataFrame, *, tolerance: float = 1e-6) -> DataFrame:
    """Expected symbols (set_id, sheet_number, label, x, y) without an entity of the label centred there.

    Both sides meet in cells of twice the tolerance; an expected place looks into the neighbouring ones as well.
    """
    cell = lambda v: F.floor(v / (2 * tolerance))
    c = center(bounds(F.col("geometry")))
    have = entities.select("set_id", "sheet_number", "label", c["x"].alias("hx"), c["y"].alias("hy")).where("hx IS NOT NULL").withColumns({"cx": cell(F.col("hx")), "cy": cell(F.col("hy"))})
    near = F.explode(F.expr("array(-1, 0, 1)"))
    want = expected.withColumn("dx", near).withColumn("dy", near).withColumns({"cx": cell(F.col("x")) + F.col("dx"), "cy": cell(F.col("y")) + F.col("dy")})
    met = want.join(have, ["set_id", "sheet_number", "label", "cx", "cy"]).where((F.abs(F.col("hx") - F.col("x")) <= tolerance) & (F.abs(F.col("hy") - F.col("y")) <= tolerance))
    return expected.join(met.select("set_id", "sheet_number", "label", "x", "y").distinct(), ["set_id", "sheet_number", "label", "x", "y"], "left_anti")
