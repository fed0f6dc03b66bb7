"""Licences and lanes: invariants as queries for the rows that break them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import fixed


def commercial_safe(license_: Column) -> Column:
    return F.coalesce(license_.isin(*fixed.COMMERCIAL_SAFE), F.lit(False))


def lane_violations(records: DataFrame) -> DataFrame:
    """Records in the commercial lane whose licence doesn't allow it."""
    return records.where((F.col("data_lane") == "commercial") & ~commercial_safe(F.col("license_provenance")))


def set_violations(sets: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities in commercial sets that are of the research lane or of an unsafe licence."""
    commercial = sets.where("data_lane = 'commercial'").select("set_id")
    return entities.join(commercial, "set_id", "left_semi").where((F.coalesce("data_lane", F.lit("")) != "commercial") | ~commercial_safe(F.col("license_provenance")))


def offenders(entities: DataFrame) -> DataFrame:
    """Of each set whether all its licences are safe, how many entities aren't, and the unsafe licences in order."""
    bad = F.when(~commercial_safe(F.col("license_provenance")), F.col("license_provenance"))
    return entities.groupBy("set_id").agg(F.bool_and(commercial_safe(F.col("license_provenance"))).alias("is_safe"), F.count(bad).alias("n_unsafe"), F.array_join(F.array_sort(F.collect_set(bad)), ",").alias("unsafe"))


def licenses_present(entities: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Entity count and all licences of each set, the set's own included; a licence has few values, so has each list."""
    own = entities.select("set_id", "license_provenance", F.lit(1).alias("n"))
    if sets is not None:
        own = own.unionByName(sets.select("set_id", "license_provenance", F.lit(0).alias("n")))
    return own.groupBy("set_id").agg(F.sum("n").alias("n_entities"), F.array_join(F.array_sort(F.collect_set("license_provenance")), ",").alias("licenses"))


def audit(records: DataFrame) -> DataFrame:
    """Counts per lane and licence: records, and those that break the lane's rule."""
    broken = (F.col("data_lane") == "commercial") & ~commercial_safe(F.col("license_provenance"))
    return records.groupBy("data_lane", "license_provenance").agg(F.count("*").alias("n"), F.count_if(broken).alias("n_broken"))


def not_owned(records: DataFrame) -> DataFrame:
    """Records that aren't both synthetic-owned and commercial: what a generator must never write."""
    return records.where((F.coalesce("license_provenance", F.lit("")) != "synthetic-owned") | (F.coalesce("data_lane", F.lit("")) != "commercial"))


def unknown_values(entities: DataFrame) -> DataFrame:
    """(field, value, n): values that are in none of the enumerations; nulls are no values."""
    known = {"entity_type": fixed.ENTITY_TYPES, "license_provenance": fixed.COMMERCIAL_SAFE + fixed.RESEARCH_ONLY, "data_lane": fixed.LANES}
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.when(~F.col(c).isin(*values), F.col(c)).alias("value")) for c, values in known.items()]))
    return entities.select(each.alias("v")).select("v.*").where("value IS NOT NULL").groupBy("field", "value").agg(F.count("*").alias("n"))
