"""Questions answered from entities, and requests for information drafted from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import fixed
from quillspan.functions.text import singular
from quillspan.operators.takeoff import countable

# Fixed patterns by which a question is routed: the first that is found decides.
ON_SHEET = r"\bon\s+([a-z]{1,3}-?\d[\w.-]*)"
KINDS = (
    ("disciplines", r"disciplin"),
    ("sheets", r"(?s)^(?=.*sheet)(?=.*(list|what))"),
    ("sheet_count", r"(?s)^(?=.*sheet)(?=.*(how many|number of|count))"),
    ("count", r"how many|number of|count|how much"),
    ("list", r"list|what are|which|show"),
)
LEAD = r"^(how many|number of|count( of| the)?|how much|list( the)?|what are( the)?|which|show( me)?( the)?)"
STOP = r"\b(are|is|there|do|does|we|have|the|in|drawing|drawings|set)\b"

HELP = "Known are counts (how many receptacles on E-101), listings (list the panels), and questions for sheets and disciplines."


def routed(question: Column) -> Column:
    """Of a column of questions the kind, the subject and the sheet they are limited to (null: none)."""
    text = F.regexp_replace(F.lower(F.trim(question)), r"\?+$", "")
    sheet = F.nullif(F.regexp_extract(text, ON_SHEET, 1), F.lit(""))
    asked = F.trim(F.regexp_replace(text, rf"(?s){ON_SHEET}.*$", ""))
    kind = F.lit("unknown")
    for name, pattern in reversed(KINDS):
        kind = F.when(asked.rlike(pattern), name).otherwise(kind)
    subject = singular(F.trim(F.regexp_replace(F.regexp_replace(asked, LEAD, ""), STOP, " ")))
    return F.struct(kind.alias("kind"), subject.alias("subject"), sheet.alias("sheet"))


def _asked(entities: DataFrame, text: str):
    return entities.sparkSession.range(1).select(routed(F.lit(text)).alias("q")).first().q


def _answerable(entities: DataFrame, sheet: str | None) -> DataFrame:
    rows = countable(entities, skipped=fixed.NOT_ANSWERED)
    return rows if sheet is None else rows.where(F.lower("sheet_number") == sheet)


def answer(entities: DataFrame, sheets: DataFrame, text: str) -> DataFrame:
    """(set_id, value_text, value_number, ord, note) for each set: a number, or one row per item in order.

    A count is 0 for sets in which nothing matches; a listing has no rows then. Where there is no answer both values
    are null and ``note`` says why: the question isn't known, or a set has no components on the sheet asked for.
    """
    q = _asked(entities, text)
    none = {"value_text": F.lit(None).cast("string"), "value_number": F.lit(None).cast("long"), "ord": F.lit(0).cast("long"), "note": F.lit(None).cast("string")}
    row = lambda df, **given: df.select("set_id", *[given.get(c, v).cast(t).alias(c) for (c, v), t in zip(none.items(), ("string", "long", "long", "string"))])
    by_set = Window.partitionBy("set_id")
    if q.kind == "disciplines":
        rows = sheets.where("discipline IS NOT NULL").select("set_id", "discipline").distinct()
        return row(rows, value_text=F.col("discipline"), ord=F.row_number().over(by_set.orderBy("discipline")))
    if q.kind == "sheets":
        return row(sheets, value_text=F.col("sheet_number"), ord=F.col("sheet_ord"))
    sets = entities.select("set_id").unionByName(sheets.select("set_id")).distinct()
    if q.kind == "sheet_count":
        n = sheets.groupBy("set_id").agg(F.count("*").alias("n"))
        return row(sets.join(n, "set_id", "left"), value_number=F.coalesce("n", F.lit(0)))
    if q.kind == "unknown":
        return row(sets, note=F.lit(HELP))
    there = _answerable(entities, q.sheet).withColumn("hit", F.instr(F.lower("label"), q.subject) > 0 if q.subject else F.lit(True))
    counts = sets.join(there.groupBy("set_id").agg(F.count("*").alias("some"), F.count_if("hit").alias("n")), "set_id", "left")
    lost = F.col("some").isNull() & F.lit(q.sheet is not None)
    note = F.when(lost, F.lit(f"There is no sheet {(q.sheet or '').upper()}, or nothing is counted on it."))
    if q.kind == "count":
        return row(counts, value_number=F.when(~lost, F.coalesce("n", F.lit(0))), note=note)
    by_label = there.where("hit").groupBy("set_id", "label").agg(F.count("*").alias("n"), F.min("doc_ord").alias("first"))
    listed = row(by_label, value_text=F.col("label"), value_number=F.col("n"), ord=F.row_number().over(by_set.orderBy(F.desc("n"), "first")))
    return listed.unionByName(row(counts.where(lost), note=note))


def answer_evidence(entities: DataFrame, text: str) -> DataFrame:
    """(set_id, sheet_number, entity_id) of every entity that a count or a listing is made of."""
    q = _asked(entities, text)
    if q.kind not in ("count", "list"):
        return entities.where("false").select("set_id", "sheet_number", "entity_id")
    there = _answerable(entities, q.sheet)
    return (there.where(F.instr(F.lower("label"), q.subject) > 0) if q.subject else there).select("set_id", "sheet_number", "entity_id")


def requests(entities: DataFrame, connections: DataFrame, *, review_threshold: float = 0.5) -> DataFrame:
    """Drafts (set_id, number, discipline, sheet_number, severity, subject, body, label, n_low, n_total, entity_id),
    numbered in each set.

    ``review``: a label of which some entities of a sheet are below the threshold. ``discrepancy``: a panel that no
    connection of its sheet ends at, on sheets that have connections. On each sheet reviews come first, by label, then
    panels in document order. The entities below the threshold are in ``request_evidence``.
    """
    rows = countable(entities, skipped=fixed.NOT_ANSWERED)
    place = ["set_id", "sheet_ord", "sheet_number", "discipline"]
    low = rows.groupBy(*place, "label").agg(F.count_if(F.col("confidence") < review_threshold).alias("n_low"), F.count("*").alias("n_total")).where("n_low > 0")
    ends = connections.select("set_id", "sheet_ord", F.explode(F.array("source_id", "target_id")).alias("entity_id")).distinct()
    panels = rows.where(F.lower("label").isin(*fixed.PANEL_LABELS))
    # One occurrence of an id on a sheet: the last one's label holds, at the first one's place.
    panels = panels.groupBy(*place, "entity_id").agg(F.max_by("label", "doc_ord").alias("label"), F.min("doc_ord").alias("at"))
    loose = panels.join(ends, ["set_id", "sheet_ord", "entity_id"], "left_anti").join(ends.select("set_id", "sheet_ord").distinct(), ["set_id", "sheet_ord"], "left_semi")
    null = F.lit(None)
    drafts = low.select(*place, F.lit("review").alias("severity"), "label", "n_low", "n_total", null.cast("string").alias("entity_id"), F.lit(0).alias("part"), F.col("label").alias("name"), F.lit(0).cast("long").alias("at"))
    drafts = drafts.unionByName(loose.select(*place, F.lit("discrepancy").alias("severity"), "label", null.cast("long").alias("n_low"), null.cast("long").alias("n_total"), "entity_id", F.lit(1).alias("part"), F.lit("").alias("name"), "at"))
    # A set's drafts are numbered sheet by sheet: the sheets' counts give where each sheet begins.
    counts = drafts.groupBy("set_id", "sheet_ord").agg(F.count("*").alias("k"))
    before = counts.select("set_id", "sheet_ord", F.coalesce(F.sum("k").over(Window.partitionBy("set_id").orderBy("sheet_ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("set_id", "sheet_ord").orderBy("part", "name", "at"))
    each = drafts.withColumn("nth", nth).join(before, ["set_id", "sheet_ord"])
    review = F.col("severity") == "review"
    subject = F.when(review, F.concat_ws(" ", F.lit("Quantity of"), "label", F.lit("to be confirmed on"), "sheet_number")).otherwise(F.concat_ws(" ", F.lit("Panel without circuits on"), "sheet_number"))
    share = f"{review_threshold:.0%}%"  # a per cent sign is written twice in a format
    body = F.when(review, F.format_string(f"%d of %d symbols '%s' are below a confidence of {share}: their number and places are to be confirmed.", "n_low", "n_total", "label"))
    body = body.otherwise("No run in the drawing ends at this panel: circuits may be missing or not drawn, so the schedule is to be compared with the plan.")
    return each.select("set_id", F.format_string("%03d", F.col("before") + F.col("nth")).alias("number"), "discipline", "sheet_number", "severity", subject.alias("subject"), body.alias("body"), "label", "n_low", "n_total", "entity_id")


def request_evidence(entities: DataFrame, *, review_threshold: float = 0.5) -> DataFrame:
    low = countable(entities, skipped=fixed.NOT_ANSWERED).where(F.col("confidence") < review_threshold)
    return low.select("set_id", "sheet_number", "label", "entity_id", "confidence")
