"""Text functions of drawings as column expressions: scales, sheet numbers, callouts, names, versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.functions import fixed


def norm_text(c: Column) -> Column:
    """Lower case, white space trimmed and collapsed."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)\s+", " "), "^ | $", "")


def norm_label(c: Column) -> Column:
    """Lower case without surrounding white space."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def singular(c: Column) -> Column:
    return F.when((F.length(c) > 3) & c.endswith("s"), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)


def parse_number(c: Column) -> Column:
    """An integer, decimal, fraction or mixed number; null for anything else or a zero denominator."""
    c = F.trim(c)
    part = lambda n: F.regexp_extract(c, r"^(?:(\d+)\s+)?(\d+(?:\.\d+)?)(?:/(\d+))?$", n)
    value = part(2).try_cast("double") / F.nullif(F.coalesce(F.nullif(part(3), F.lit("")).try_cast("double"), F.lit(1.0)), F.lit(0.0))
    return F.when(part(2) != "", F.coalesce(part(1).try_cast("double"), F.lit(0.0)) + value)


def parse_scale(c: Column) -> Column:
    """A drawing scale: raw text, units, ratio of paper to real length, confidence; null if there is none.

    Imperial scales (inches to feet and inches) come before metric ones; texts marked as not to scale have none.
    """
    at = lambda p, n: F.regexp_extract(c, p, n)
    paper, feet, inch = parse_number(at(fixed.IMPERIAL, 1)), at(fixed.IMPERIAL, 2).try_cast("double"), parse_number(at(fixed.IMPERIAL, 3))
    real = feet * 12 + F.coalesce(inch, F.lit(0.0))
    a, b = at(fixed.METRIC, 1).try_cast("double"), at(fixed.METRIC, 2).try_cast("double")

    def scale(raw: Column, unit: str, real_unit: str, ratio: Column, confidence: float) -> Column:
        return F.struct(F.trim(raw).alias("raw"), F.lit(unit).alias("drawing_unit"), F.lit(real_unit).alias("real_world_unit"), ratio.alias("ratio"), F.lit(None).cast("double").alias("px_per_real_unit"), F.lit(confidence).alias("confidence"))

    ok = ~F.coalesce(c.rlike(fixed.NOT_TO_SCALE), F.lit(True))
    imperial = (at(fixed.IMPERIAL, 0) != "") & (real > 0)
    metric = (at(fixed.METRIC, 0) != "") & (b > 0)
    return F.when(ok & imperial, scale(at(fixed.IMPERIAL, 0), "in", "ft", paper / F.nullif(real, F.lit(0.0)), 0.99)).when(ok & metric, scale(at(fixed.METRIC, 0), "mm", "m", a / F.nullif(b, F.lit(0.0)), 0.95))


def extract_scale(c: Column) -> Column:
    """The scale after a SCALE label if that parses, else the first anywhere."""
    return F.coalesce(parse_scale(F.nullif(F.regexp_extract(c, fixed.SCALE_LABEL, 1), F.lit(""))), parse_scale(c))


def px_per_unit(ratio: Column, unit: Column, dpi: Column) -> Column:
    """Pixels for one real unit; null for a unit without a known length."""
    inches = F.lit(None).cast("double")
    for name, n in fixed.INCHES.items():
        inches = F.when(unit == name, n).otherwise(inches)
    return ratio * inches * dpi


def parse_sheet_number(c: Column) -> Column:
    """The first sheet number of a line with SHEET, else the first anywhere, as letters-digits; null if none."""
    lines = F.filter(F.split(c, r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"), lambda x: F.upper(x).contains("SHEET") & x.rlike(fixed.SHEET_NUMBER))
    text = F.coalesce(F.try_element_at(lines, F.lit(1)), c)
    at = lambda n: F.regexp_extract(text, fixed.SHEET_NUMBER, n)
    return F.when(text.rlike(fixed.SHEET_NUMBER), F.concat(at(1), F.lit("-"), at(2), at(3)))


def discipline_for_letter(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for letter, name in fixed.DISCIPLINES.items():
        out = F.when(F.upper(c) == letter, name).otherwise(out)
    return out


def cross_references(c: Column) -> Column:
    """Distinct callouts (detail, sheet) in order of first occurrence."""
    each = F.transform(F.regexp_extract_all(c, F.lit(fixed.CALLOUT), 0), lambda x: F.struct(F.regexp_extract(x, fixed.CALLOUT, 1).alias("detail"), F.regexp_extract(x, fixed.CALLOUT, 2).alias("sheet")))
    return F.array_distinct(each)


def title_block(c: Column) -> Column:
    number = parse_sheet_number(c)
    return F.struct(number.alias("sheet_number"), discipline_for_letter(F.substring(number, 1, 1)).alias("discipline"), extract_scale(c)["raw"].alias("scale"))


def is_drawing_set(name: Column) -> Column:
    """Words of other papers beat words of drawings."""
    low = F.lower(name)
    return ~low.rlike("|".join(fixed.OTHER_WORDS)) & low.rlike("|".join(fixed.PLAN_WORDS))


def sanitized(name: Column) -> Column:
    """A name for a file system: decoded, runs of other characters are an underscore, none at the ends."""
    plain = F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)
    return F.regexp_replace(F.regexp_replace(plain, r"(?U)[^\w.\-]+", "_"), "^_+|_+$", "")


def project_code(name: Column) -> Column:
    """The project code in a name, else the name without its extension."""
    code = F.regexp_extract(name, fixed.PROJECT, 1)
    return F.when(code != "", code).otherwise(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def version_parts(c: Column) -> Column:
    """Three numbers of a version; null if it is none."""
    parts = F.split(c, r"\.")
    return F.when(c.rlike(r"^\d+\.\d+\.\d+$"), F.transform(parts, lambda p: p.try_cast("int")))


def readable_version(c: Column, major: int = 0) -> Column:
    return F.coalesce(F.element_at(version_parts(c), 1) == major, F.lit(False))


def feet_inches(feet: Column) -> Column:
    """A length in feet as printed text and millimetres; halves of an inch go to the even one."""
    inches = F.bround(feet * 12, 0).cast("long")
    ft = F.floor(inches / 12)
    return F.struct(F.concat(ft.cast("string"), F.lit("'-"), (inches - ft * 12).cast("string"), F.lit('"')).alias("text"), (inches * F.lit(25.4)).alias("mm"))


def json_within(c: Column) -> Column:
    """The JSON between the first and the last brace of a text, if it is valid; else null."""
    found = F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))
    return F.when(F.try_parse_json(found).isNotNull(), found)


def format_value(metric: Column, value: Column, ci95: Column, *, raw: tuple[str, ...] = ("chamfer_distance",), percent: tuple[str, ...] = ("counting_mape",)) -> Column:
    """A metric's value as text: raw ones with four places, the others in per cent, with the half-width if not 0."""
    with_ci = lambda v, c, places, sign: F.when(ci95 != 0, F.format_string(f"%.{places}f{sign} +/-%.{places}f", v, c)).otherwise(F.format_string(f"%.{places}f{sign}", v))
    return F.when(metric.isin(*raw), with_ci(value, ci95, 4, "")).when(metric.isin(*percent), with_ci(value, ci95, 1, "%%")).otherwise(with_ci(value * 100, ci95 * 100, 1, "%%"))


def is_loopback(url: Column) -> Column:
    """Whether an address is of this machine only; null and broken ones are not."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    return F.coalesce(host.isin("localhost", "[::1]") | host.rlike(r"^127\.\d{1,3}\.\d{1,3}\.\d{1,3}$"), F.lit(False))
