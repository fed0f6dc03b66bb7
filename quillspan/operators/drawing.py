"""The frames that other operators take: current entities and connections, and the sheets they are on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def current(df: DataFrame, *key: str, at: str = "recorded_at", deleted: str | None = "is_deleted") -> DataFrame:
    """The newest row of each key, without keys whose newest row is a withdrawal; equal rows count once.

    A window with a limit of one row: rows that aren't the newest are dropped before the shuffle as well.
    """
    order = [F.col(at).desc_nulls_last(), *([F.col(deleted).desc_nulls_last()] if deleted else [])]
    newest = df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
    return newest.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else newest


def sheets_of(plan_sets: DataFrame, plan_pages: DataFrame) -> DataFrame:
    """(set_id, sheet_ord, sheet_number, discipline, width_pt, height_pt): the pages of the sets that were parsed."""
    refs = plan_sets.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("ref_id").alias("ref_id"))
    pages = plan_pages.groupBy("ref_id", "page").agg(*[F.max(c).alias(c) for c in ("sheet_no", "discipline", "width_pt", "height_pt")])
    return refs.join(pages, "ref_id").select("set_id", F.col("page").alias("sheet_ord"), F.col("sheet_no").alias("sheet_number"), F.lower("discipline").alias("discipline"), "width_pt", "height_pt")


def on_sheets(entities: DataFrame, sheets: DataFrame) -> DataFrame:
    """Entities with the discipline (``unknown`` if their sheet has none) and number of their sheet."""
    sides = sheets.select("set_id", "sheet_ord", "discipline", "sheet_number")
    return entities.join(sides, ["set_id", "sheet_ord"], "left").withColumn("discipline", F.coalesce("discipline", F.lit("unknown"))).withColumn("sheet_number", F.coalesce("sheet_number", F.concat(F.lit("#"), F.col("sheet_ord").cast("string"))))


def plan_sheets(sheets: DataFrame, views: DataFrame, key: list[str]) -> DataFrame:
    """(key, sheet_ord): of each document the first sheet that has a plan view, or its first sheet if none has."""
    plans = views.where(F.lower("view_type") == "plan").select(*key, "sheet_ord", F.lit(0).alias("rank"))
    every = plans.unionByName(sheets.select(*key, "sheet_ord", F.lit(1).alias("rank")))
    return every.groupBy(*key).agg(F.min(F.struct("rank", "sheet_ord")).alias("best")).select(*key, "best.sheet_ord")


def detection_projection(entities: DataFrame, plans: DataFrame, key: list[str], *, labels: tuple[str, ...]) -> DataFrame:
    """What a detector can find: entities of its labels with a geometry, on the plan sheet."""
    return entities.where(F.col("label").isin(*labels) & F.col("geometry").isNotNull()).join(plans, [*key, "sheet_ord"], "left_semi")


def graph_projection(entities: DataFrame, connections: DataFrame, plans: DataFrame, key: list[str], *, labels: tuple[str, ...]) -> DataFrame:
    """Connections of the plan sheet's first view whose both ends are among the entities a detector can find."""
    kept = detection_projection(entities, plans, key, labels=labels).select(*key, "id").where("id IS NOT NULL").distinct()
    first = connections.where("view_ord = 0").join(plans, [*key, "sheet_ord"], "left_semi")
    for end in ("source_id", "target_id"):
        first = first.join(kept.withColumnRenamed("id", end), [*key, end], "left_semi")
    return first


def summaries(sheets: DataFrame, entities: DataFrame, connections: DataFrame) -> DataFrame:
    """(set_id, n_sheets, n_entities, n_connections) of each set that has any of them."""
    one = lambda df, n: df.select("set_id", *[F.lit(int(c == n)).cast("long").alias(c) for c in ("n_sheets", "n_entities", "n_connections")])
    every = one(sheets, "n_sheets").unionByName(one(entities, "n_entities")).unionByName(one(connections, "n_connections"))
    return every.groupBy("set_id").agg(*[F.sum(c).alias(c) for c in ("n_sheets", "n_entities", "n_connections")])
