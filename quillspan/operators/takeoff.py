"""Quantity takeoff: counted components with their evidence, runs, walls, rooms and connections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import fixed
from quillspan.functions.geometry import area, bounds, center, distance, height, measured_area, width


def countable(entities: DataFrame, *, skipped: tuple[str, ...] = fixed.NOT_COUNTED, min_confidence: float = 0.0) -> DataFrame:
    """Labelled entities of the types that are counted, at or above the noise floor."""
    kind = F.coalesce("entity_type", F.lit("other"))
    return entities.where(~kind.isin(*skipped) & F.col("label").isNotNull() & (F.col("confidence") >= min_confidence))


def takeoff_lines(entities: DataFrame, *, min_confidence: float = 0.0, review_threshold: float = 0.5) -> DataFrame:
    """One line per set, discipline and label; codes are those of the first entity in the document that has any."""
    mf = F.col("ontology.masterformat")
    coded = (F.coalesce(mf, F.lit("")) != "") | (F.coalesce("ifc_class", F.lit("")) != "")
    first = F.min_by(F.struct(mf.alias("masterformat"), "ifc_class"), F.when(coded, F.col("doc_ord")))
    lines = countable(entities, min_confidence=min_confidence).groupBy("set_id", "discipline", "label").agg(
        F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"), F.count_if(F.col("confidence") < review_threshold).alias("needs_review"), first.alias("codes"), F.max(coded).alias("coded")
    )
    code = lambda c: F.when(F.col("coded"), F.col(f"codes.{c}")).alias(c)
    return lines.select("set_id", "discipline", "label", F.lit("EA").alias("unit"), "n", "avg_confidence", "needs_review", code("masterformat"), code("ifc_class"))


def takeoff_evidence(entities: DataFrame, *, min_confidence: float = 0.0) -> DataFrame:
    """The entities behind each line: a table of its own, so that no line grows with its evidence."""
    b = bounds(F.col("geometry"))
    return countable(entities, min_confidence=min_confidence).select("set_id", "discipline", "label", "sheet_number", "entity_id", "confidence", *[b[c].alias(c) for c in ("x_min", "y_min", "x_max", "y_max")])


def by_sheet(entities: DataFrame, *, min_confidence: float = 0.0) -> DataFrame:
    return countable(entities, min_confidence=min_confidence).groupBy("set_id", "sheet_number", "label").agg(F.count("*").alias("n"))


def totals(lines: DataFrame) -> DataFrame:
    """Totals of each set, of each of its disciplines, and of all."""
    return lines.groupingSets([["set_id", "discipline"], ["set_id"], []], "set_id", "discipline").agg(F.sum("n").alias("n"), F.sum("needs_review").alias("needs_review"))


def connection_type(c: Column, missing: str = "unspecified") -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(missing))


def connection_counts(connections: DataFrame) -> DataFrame:
    return connections.groupBy("set_id", connection_type(F.col("connection_type")).alias("connection_type")).agg(F.count("*").alias("n"))


def scales(sheets: DataFrame) -> DataFrame:
    """Each set's factors of length and area and unit: those of its first sheet with a size and a ratio.

    ``sheets`` has width, height, size_unit, ratio and real_world_unit. The width's factor is used for both axes.
    """
    usable = F.col("width").isNotNull() & F.col("height").isNotNull() & (F.coalesce("ratio", F.lit(0.0)) != 0)
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    of = F.struct((F.col("width") * F.col("ratio")).alias("length"), (F.col("width") * F.col("height") * F.col("ratio") * F.col("ratio")).alias("area"), F.coalesce(text("real_world_unit"), text("size_unit"), F.lit("unit")).alias("unit"))
    return sheets.where(usable).groupBy("set_id").agg(F.min_by(of, "sheet_ord").alias("scale"))


def quantities(entities: DataFrame, connections: DataFrame, scale: DataFrame | None = None) -> DataFrame:
    """Lengths of runs by type and of walls, areas of rooms by label: (set_id, kind, name, unit, n, quantity, scale_known).

    Endpoints are looked up in the whole set; of rows with one id the last in the document holds. Without a scale
    quantities are in fractions of the sheet. The noise floor of counts doesn't apply.
    """
    placed = entities.where(bounds(F.col("geometry")).isNotNull())
    spots = placed.groupBy("set_id", "entity_id").agg(F.max_by(center(bounds(F.col("geometry"))), "doc_ord").alias("at"))
    end = lambda side: spots.select("set_id", F.col("entity_id").alias(f"{side}_id"), F.col("at").alias(side))
    runs = connections.join(end("source"), ["set_id", "source_id"]).join(end("target"), ["set_id", "target_id"])
    runs = runs.select("set_id", F.lit("linear").alias("kind"), connection_type(F.col("connection_type")).alias("name"), F.lit(0).alias("rank"), distance(F.col("source"), F.col("target")).alias("q"))
    labelled = placed.where("label IS NOT NULL")
    b = bounds(F.col("geometry"))
    walls = labelled.where("entity_type = 'wall'").select("set_id", F.lit("linear").alias("kind"), F.lit("Wall").alias("name"), F.lit(1).alias("rank"), F.greatest(width(b), height(b)).alias("q"))
    rooms = labelled.where("entity_type = 'room'").select("set_id", F.lit("area").alias("kind"), F.col("label").alias("name"), F.lit(0).alias("rank"), measured_area(F.col("geometry")).alias("q"))
    sums = runs.unionByName(walls).unionByName(rooms).groupBy("set_id", "kind", "name", "rank").agg(F.count("*").alias("n"), F.sum("q").alias("q"))
    if scale is None:
        sums = sums.withColumn("scale", F.lit(None).cast("struct<length:double,area:double,unit:string>"))
    else:
        sums = sums.join(scale, "set_id", "left")
    linear, known = F.col("kind") == "linear", F.col("scale").isNotNull()
    factor = F.coalesce(F.when(linear, F.col("scale.length")).otherwise(F.col("scale.area")), F.lit(1.0))
    unit = F.concat(F.coalesce("scale.unit", F.lit("norm")), F.when(linear, "").otherwise("²"))
    return sums.select("set_id", "kind", "name", unit.alias("unit"), "n", F.round(F.col("q") * factor, 2).alias("quantity"), known.alias("scale_known"))


def ordered(lines: DataFrame) -> DataFrame:
    """Lines by set and discipline, the most frequent labels first."""
    return lines.orderBy("set_id", "discipline", F.desc("n"), "label")


def write_csv(lines: DataFrame, folder: str) -> None:
    """Lines in order as CSV files with a header; the files follow each other."""
    ordered(lines).write.mode("overwrite").option("header", True).csv(folder)


def to_dict(lines: list, connections: dict[str, int], quantities: list, *, name: str) -> dict:
    """The takeoff of one set as plain values: lines, measured quantities, connections and totals."""
    return {
        "name": name, "lines": [r.asDict() for r in lines], "connections": dict(sorted(connections.items())),
        "linear": [r.asDict() for r in quantities if r["kind"] == "linear"], "areas": [r.asDict() for r in quantities if r["kind"] == "area"],
        "total_count": sum(r["n"] for r in lines), "total_needs_review": sum(r["needs_review"] for r in lines),
    }


def to_markdown(lines: list, connections: dict[str, int], *, name: str, review_threshold: float = 0.5) -> str:
    """The takeoff of one set as text: disciplines in order, in each the most frequent labels first."""
    out = [f"# Quantity takeoff: {name}", ""]
    for discipline in sorted({r["discipline"] for r in lines}):
        own = sorted((r for r in lines if r["discipline"] == discipline), key=lambda r: (-r["n"], r["label"]))
        out += [f"## {discipline.title()}", "", "| Item | Qty | Unit | Avg conf | Review | Code |", "|---|---|---|---|---|---|"]
        out += [f"| {r['label']} | {r['n']} | {r['unit']} | {r['avg_confidence']:.2f} | {r['needs_review'] or ''} | {r['masterformat'] or r['ifc_class'] or ''} |" for r in own]
        out.append("")
    if connections:
        out += ["## Connections", "", *[f"- {k}: {v}" for k, v in sorted(connections.items())], ""]
    total, review = sum(r["n"] for r in lines), sum(r["needs_review"] for r in lines)
    return "\n".join([*out, f"Total: {total} components ({review} below {review_threshold:.0%})"])


def detections(entities: DataFrame) -> DataFrame:
    """Entities with a box of positive area."""
    return entities.withColumn("box", bounds(F.col("geometry"))).where(area(F.col("box")) > 0)
