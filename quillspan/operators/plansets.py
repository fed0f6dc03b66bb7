"""Public plan sets: listings to refs, pages to index records, totals and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import text


def _absolute(base: Column, href: Column) -> Column:
    """An address relative to a page's: absolute, of another host, of the same host, or of the same folder."""
    part = lambda p: F.regexp_extract(base, p, 1)
    scheme, root, folder = part(r"^([a-zA-Z][\w+.\-]*:)"), part(r"^([a-zA-Z][\w+.\-]*://[^/?#]*)"), part(r"^([a-zA-Z][\w+.\-]*://[^?#]*/|[a-zA-Z][\w+.\-]*://[^/?#]*)")
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    # Segment by segment: ".." takes the one before it away, "." and doubled slashes go alone.
    path, rest = F.regexp_extract(href, r"^([^?#]*)", 1), F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    steps = F.split(F.concat(F.substring(folder, F.length(root) + 1, F.length(folder)), path), "/")
    walk = lambda s, x: F.when(x == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).when(x.isin("", "."), s).otherwise(F.concat(s, F.array(x)))
    kept = F.aggregate(steps, F.array().cast("array<string>"), walk)
    joined = F.concat(root, F.lit("/"), F.array_join(kept, "/"), rest)
    return (
        F.when(href.rlike(r"^[a-zA-Z][\w+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(root, href))
        .otherwise(joined)
    )


def _unescaped(c: Column) -> Column:
    # The entities that occur in addresses.
    for entity, char in (("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&#38;", "&"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def refs_in(pages: DataFrame, *, source: str = "source") -> DataFrame:
    """(source, project, url, filename) of the drawing sets that pages (source, url, html) link to, each address once.

    Links are ``href`` values in double quotes that end in .pdf. Names that speak of other papers are left out.
    """
    hrefs = F.explode(F.regexp_extract_all("html", F.lit(r'(?i)href="([^"]+\.pdf)"'), 1))
    rows = pages.select(F.col(source).alias("source"), F.col("url").alias("page"), hrefs.alias("href"))
    rows = rows.withColumn("url", _absolute(F.col("page"), _unescaped(F.col("href"))))
    raw = F.substring_index("url", "/", -1)
    name = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    rows = rows.where(text.is_drawing_set(name))
    return rows.select("source", text.project_code(name).alias("project"), "url", text.sanitized(raw).alias("filename")).dropDuplicates(["url"])


def page_records(pages: DataFrame) -> DataFrame:
    """Pages (ref_id, page, text, width_pt, height_pt) with sheet number and discipline read from their text."""
    number = text.parse_sheet_number(F.col("text"))
    letter = F.substring(F.split(number, "-")[0], 1, 2)
    return pages.select("ref_id", "page", number.alias("sheet_no"), letter.alias("discipline_letter"), text.discipline_for_letter(F.substring(letter, 1, 1)).alias("discipline"), "width_pt", "height_pt")


def set_records(refs: DataFrame, pages: DataFrame) -> DataFrame:
    """Refs with their number of pages and pages per discipline letter (a letter or two, so a map of bounded size)."""
    letters = pages.where("discipline_letter IS NOT NULL").groupBy("ref_id", "discipline_letter").agg(F.count("*").cast("int").alias("n"))
    by = letters.groupBy("ref_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("discipline_letter", "n")))).alias("by_discipline"))
    n = pages.groupBy("ref_id").agg(F.count("*").cast("int").alias("n_pages"))
    return refs.join(n, "ref_id", "left").join(by, "ref_id", "left").withColumn("n_pages", F.coalesce("n_pages", F.lit(0)))


def index_totals(sets: DataFrame) -> DataFrame:
    """Sets, sets without an error and projects of each source."""
    firsts = sets.groupBy("source", "project").agg(F.count("*").alias("n"), F.count_if(F.col("error").isNull()).alias("ok"))
    return firsts.groupBy("source").agg(F.sum("n").alias("n_sets"), F.sum("ok").alias("n_sets_ok"), F.count("project").alias("n_projects"))


def discipline_totals(pages: DataFrame) -> DataFrame:
    """Pages per discipline letter, the most frequent first."""
    n = pages.where("discipline_letter IS NOT NULL").groupBy("discipline_letter").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "discipline_letter")))  # a row per letter


def round_robin(pages: DataFrame, *, letter: str, count: int, min_projects: int = 5) -> DataFrame:
    """``count`` sheets of a discipline letter, one of each project in turn, projects in order, sheets as indexed.

    ``pages`` has project, ref_id, page, sheet_no, discipline_letter. Fewer projects than ``min_projects`` is an error.
    """
    rows = pages.where((F.upper(F.substring("discipline_letter", 1, 1)) == letter) & F.col("sheet_no").isNotNull() & F.col("project").isNotNull())
    n = rows.select("project").distinct().count()
    if n < min_projects:
        raise ValueError(f"{n} projects have sheets of {letter}, fewer than {min_projects}")
    # No project gives more than ``count`` sheets, so the window keeps no more than that of any.
    turn = F.row_number().over(Window.partitionBy("project").orderBy("ref_id", "page"))
    return rows.withColumn("turn", turn).where(F.col("turn") <= count).orderBy("turn", "project").limit(count)


def capped(pages: DataFrame, *, letters: tuple[str, ...] = ("E", "A"), cap: int = 40) -> DataFrame:
    """The first ``cap`` pages of each of the letters, in the order of the index."""
    first = F.upper(F.substring("discipline_letter", 1, 1))
    rows = pages.where(first.isin(*letters)).withColumn("letter", first)
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("letter").orderBy("ref_id", "page"))).where(F.col("n") <= cap)
