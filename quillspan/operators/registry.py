"""The register of datasets, audits of it and of prepared documents, and runs of preparers with their manifest."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators.licensing import commercial_safe, lane_violations

# Fixed value: the members of a record of the register.
RECORD = (
    "name string, source_url string, paper_url string, size string, modality string, content_types array<string>, annotation_format string, tasks array<string>, "
    "has_preparer boolean, license_provenance string, data_lane string, verified boolean, notes string"
)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Records of a register: JSON (a list, or an object with ``datasets``), or YAML of the same form if its library is
    there. A register is a small file, read by the driver."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    if PurePosixPath(path).suffix.lower() in (".yaml", ".yml"):
        import yaml

        raw = yaml.safe_load(text) or {}
    else:
        raw = json.loads(text)
    rows = raw.get("datasets", []) if isinstance(raw, dict) else raw
    names = [f.split(" ")[0] for f in RECORD.split(", ")]
    unknown = {k for r in rows for k in r} - set(names)
    if unknown:
        raise ValueError(f"unknown members: {', '.join(sorted(unknown))}")
    default = {"content_types": [], "tasks": [], "has_preparer": False, "verified": False}
    return spark.createDataFrame([tuple(r.get(n, default.get(n)) for n in names) for r in rows], RECORD)


def named(registry: DataFrame, name: str) -> DataFrame:
    """The record of a name in any case; an unknown name is an error."""
    found = registry.where(F.lower("name") == name.lower())
    if found.isEmpty():
        raise KeyError(f"no dataset {name!r}")
    return found


def in_lane(registry: DataFrame, lane: str) -> DataFrame:
    return registry.where(F.col("data_lane") == lane)


def audit_registry(registry: DataFrame) -> DataFrame:
    """Records in the commercial lane whose licence doesn't allow it."""
    return lane_violations(registry).select("name", "license_provenance")


def audit_documents(sets: DataFrame, entities: DataFrame, unreadable: DataFrame) -> DataFrame:
    """(set_key, problem, detail): prepared documents that break the rules; a document that can't be read is one of them.

    ``sets`` and ``entities`` are tables of nested records. A set in the commercial lane has a safe licence itself, and
    so has everything in it.
    """
    broken = unreadable.select("set_key", F.lit("unreadable").alias("problem"), F.col("reason").alias("detail"))
    key = ["set_key", "record"]
    commercial = sets.where("data_lane = 'commercial'")
    own = commercial.where(~commercial_safe(F.col("license_provenance"))).select("set_key", F.lit("licence of the set").alias("problem"), F.col("license_provenance").alias("detail"))
    inside = entities.join(commercial.select(*key).distinct(), key, "left_semi")
    bad = inside.where(~commercial_safe(F.col("license_provenance")) | (F.coalesce("data_lane", F.lit("")) != "commercial"))
    each = bad.groupBy("set_key").agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("license_provenance", F.lit("none")))), ",").alias("detail"))  # licences are few
    return broken.unionByName(own).unionByName(each.select("set_key", F.lit("licence of entities").alias("problem"), "detail")).distinct()


def audit_counts(sets: DataFrame, unreadable: DataFrame) -> DataFrame:
    """One row: documents read, those in the commercial lane, and those that can't be read."""
    read = sets.agg(F.count("*").alias("n_scanned"), F.count_if(F.col("data_lane") == "commercial").alias("n_commercial"), F.lit(0).cast("long").alias("n_unreadable"))
    lost = unreadable.agg(F.lit(0).cast("long").alias("n_scanned"), F.lit(0).cast("long").alias("n_commercial"), F.count("*").alias("n_unreadable"))
    return read.unionByName(lost).agg(*[F.sum(c).alias(c) for c in ("n_scanned", "n_commercial", "n_unreadable")])


def prepare(converted: DataFrame, folder: str, *, limit: int | None = None, order: str = "name") -> DataFrame:
    """Write converted documents (name, payload, license_provenance, data_lane) in place of those of an earlier run;
    gives the manifest: documents per lane and licence. ``limit`` keeps the first of an order."""
    chosen = converted if limit is None else converted.orderBy(order).limit(limit)
    chosen.write.mode("overwrite").parquet(folder)
    back = converted.sparkSession.read.schema(converted.schema).parquet(folder)
    return back.groupBy("data_lane", "license_provenance").agg(F.count("*").alias("n_documents"))
