"""Ontology grounding, label crosswalks and the label that entities are matched by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import fixed
from quillspan.functions.text import norm_label

# Fixed value: the detector's classes in the order of their indices: label, IFC class, MasterFormat, size, load in VA.
DETECTOR_CLASSES = (
    ("Duplex Receptacle", "IfcOutlet", "26 27 26", 0.022, 180),
    ("Quad Receptacle", "IfcOutlet", "26 27 26", 0.026, 360),
    ("GFCI Receptacle", "IfcOutlet", "26 27 26", 0.024, 180),
    ("Light Fixture", "IfcLightFixture", "26 51 13", 0.030, 100),
    ("Recessed Downlight", "IfcLightFixture", "26 51 13", 0.024, 60),
    ("Wall Light", "IfcLightFixture", "26 51 13", 0.022, 75),
    ("Single-Pole Switch", "IfcSwitchingDevice", "26 27 26", 0.020, 0),
    ("Three-Way Switch", "IfcSwitchingDevice", "26 27 26", 0.020, 0),
    ("Junction Box", "IfcJunctionBox", "26 05 33", 0.018, 0),
    ("Panelboard", "IfcElectricDistributionBoard", "26 24 16", None, None),
)
LABELS = tuple(c[0] for c in DETECTOR_CLASSES)


def ontology(spark: SparkSession) -> DataFrame:
    """(key, ifc, masterformat, uniformat): one row per known label, a table of fixed size."""
    rows = [(label.strip().lower(), *codes) for codes, labels in fixed.ONTOLOGY.items() for label in labels]
    return spark.createDataFrame(rows, "key string, ifc string, masterformat string, uniformat string")


def ground(entities: DataFrame) -> DataFrame:
    """Entities with the codes of their label; a known label's codes replace all others, an unknown one's stay.

    ``grounded`` is null for entities without a label.
    """
    dim = F.broadcast(ontology(entities.sparkSession).select("key", F.struct("ifc", "masterformat", "uniformat").alias("_entry")))
    hit = F.col("_entry").isNotNull()
    null = F.lit(None).cast("string")
    codes = F.struct(F.col("_entry.masterformat").alias("masterformat"), F.col("_entry.uniformat").alias("uniformat"), null.alias("omniclass"), null.alias("uniclass"), F.create_map().cast("map<string,string>").alias("extra"))
    joined = entities.join(dim, norm_label(F.col("label")) == F.col("key"), "left")
    return joined.withColumns({"ifc_class": F.when(hit, F.col("_entry.ifc")).otherwise(F.col("ifc_class")), "ontology": F.when(hit, codes).otherwise(F.col("ontology")), "grounded": F.when(F.col("label").isNotNull(), hit)}).drop("key", "_entry")


def coverage(grounded: DataFrame) -> DataFrame:
    """How many labelled entities of each set were grounded."""
    return grounded.groupBy("set_id").agg(F.count_if("grounded").alias("grounded"), F.count("label").alias("total"))


def matched_label(label: Column, ifc_class: Column, entity_type: Column) -> Column:
    """The label, else the IFC class, else the type; empty ones count as missing."""
    return F.coalesce(F.nullif(label, F.lit("")), F.nullif(ifc_class, F.lit("")), entity_type)


def remap(entities: DataFrame, mapping: dict[str, str] = fixed.CROSSWALK) -> DataFrame:
    """Entities of mapped labels under their new label; the others are dropped."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return entities.where(F.col("label").isin(*mapping)).withColumn("label", table[F.col("label")])


def class_index(label: Column) -> Column:
    """The detector's index of a label; null for labels that it doesn't know."""
    return F.when(label.isin(*LABELS), (F.array_position(F.array(*[F.lit(x) for x in LABELS]), label) - 1).cast("int"))


def detectable(entities: DataFrame) -> DataFrame:
    return entities.where(F.col("label").isin(*LABELS))


def from_detections(found: DataFrame) -> DataFrame:
    """Entities of detections (label, box, score): codes of the class if it is known, the score within 0 and 1."""
    k = class_index(F.col("label"))
    of = lambda n: F.element_at(F.array(*[F.lit(c[n]) for c in DETECTOR_CLASSES]), k + 1)
    return found.withColumns({"entity_type": F.when(k.isNotNull(), "symbol").otherwise("other"), "ifc_class": F.when(k.isNotNull(), of(1)), "masterformat": F.when(k.isNotNull(), of(2)), "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))})
