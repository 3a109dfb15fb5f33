"""Site-relative line frequency.

A line is boilerplate of a site when it stands on more than ``ratio`` of the site's pages and
on at least ``least`` of them.  Pages are not shuffled to find that out: every page counts its
distinct lines by a 128-bit hash under its site, counts are summed on the map side first, and
divided by the site's pages.  As a page adds 1 to each of its lines, a site has at most
(lines of its average page) / ``ratio`` boilerplate lines, whatever its size: they come back
to the pages as one array per site, broadcast when all arrays together are small as counted,
else joined with the pages of large sites spread over salts.

Only DataFrame expressions; every occurrence of a boilerplate line goes, other lines keep
their order.  Defined cases: a null site is the site ''; a null text has no lines and gives an
empty text; blank lines are kept and never counted; repeated rows are pages of their own; an
empty table gives an empty table; other columns pass through, whatever their names; those
called as a new column are replaced.

Documents of a source have a ratio of their own, ``DOC_RATIO``: pages of a site come from one
template, so its lines stand on most of them, while a source gathers many origins, each of
which may be a few hundredths of it.  Lines under ``SHORT_WORDS`` words, which prose repeats by
chance, still need ``RATIO``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common
from gridloom.plans.joins import salted_join

RATIO = 0.1
LEAST_PAGES = 3
#: For lines of documents: an origin that gives one document in a hundred of its source.
DOC_RATIO = 0.01
#: Lines of fewer words are common by chance and need the ratio of pages.
SHORT_WORDS = 5

#: Bytes of a line's hash in a site's array.
LINE_BYTES = 24


def host_of(url: Column) -> Column:
    """Host of an address, lower case, without user and port; '' if it has none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.lower(found)


def html_lines(html: Column) -> Column:
    """Text pieces between the tags of a page, trimmed, without empty ones; scripts, styles and
    comments are left out."""
    bare = F.regexp_replace(
        F.coalesce(html, F.lit("")),
        r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->|<[^>]*>",
        "\n",
    )
    lines = F.transform(F.split(bare, "\n"), lambda line: F.trim(line))
    return F.filter(lines, lambda line: line != "")


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _mark(line: Column) -> Column:
    """Two independent 64-bit hashes of a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"))


def boilerplate(
    pages: DataFrame, site: Column, lines: Column, ratio: float, least: int, short_ratio: float | None = None
) -> DataFrame:
    """``(site, drops, pages)``: hashes of each site's boilerplate lines; sites without any are left out.

    With ``short_ratio`` lines under ``SHORT_WORDS`` words must stand on more than that share."""
    told = pages.select(site.alias("site"), lines.alias("lines"))
    needs = lambda line: F.lit(ratio)
    if short_ratio is not None and short_ratio != ratio:
        words = lambda line: F.regexp_count(line, F.lit(common.WORD))
        needs = lambda line: F.when(words(line) < SHORT_WORDS, F.lit(short_ratio)).otherwise(F.lit(ratio))
    mark = lambda line: _mark(line).withField("needs", needs(line))
    marks = F.array_distinct(F.transform(F.filter("lines", lambda line: F.trim(line) != ""), mark))
    counts = told.select("site", F.explode(marks).alias("mark")).groupBy("site", "mark.a", "mark.b", "mark.needs").agg(
        F.count(F.lit(1)).alias("n")
    )
    totals = pages.select(site.alias("site")).groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    often = counts.where(F.col("n") >= least).join(totals, "site").where(F.col("n") > F.col("pages") * F.col("needs"))
    return often.groupBy("site", "pages").agg(F.collect_list(F.struct("a", "b")).alias("drops"))


def line_dedup(
    pages: DataFrame,
    site: Column,
    lines: Column,
    ratio: float = RATIO,
    least: int = LEAST_PAGES,
    out: str = "text",
    counts: bool = False,
    short_ratio: float | None = None,
) -> DataFrame:
    """All rows and columns of ``pages``; column ``out`` holds (or is replaced by) the lines that
    stay.  ``counts`` adds ``n_lines`` and ``n_dropped``."""
    spark = pages.sparkSession
    site = F.coalesce(site, F.lit(""))
    drops = common.put(boilerplate(pages, site, lines, ratio, least, short_ratio), "boilerplate")
    held = drops.agg(F.coalesce(F.sum(F.size("drops")), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("sites")).first()
    held_bytes = held["n"] * LINE_BYTES + held["sites"] * 64
    table = drops.select(F.col("site").alias("_site"), "drops", "pages")
    rows = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_row"), site.alias("_site"), lines.alias("_lines")
    )
    if held_bytes <= common.BROADCAST_BYTES:
        met = rows.join(F.broadcast(table), "_site", "left")
    else:
        heavy = common.heavy_of(rows.groupBy("_site").agg(F.count(F.lit(1)).alias("n")), "_site", "n")
        keyed = rows.withColumn("_salted", F.xxhash64("_row"))
        met = salted_join(keyed, table, "_site", "left", heavy=heavy)
    stay = F.when(F.col("drops").isNull(), F.col("_lines")).otherwise(
        F.filter("_lines", lambda line: (F.trim(line) == "") | ~F.array_contains("drops", _mark(line)))
    )
    kept = met.withColumn("_stay", stay)
    made = {out.lower(), *(["n_lines", "n_dropped"] if counts else [])}
    columns = [F.col("_row")[c].alias(c) for c in pages.columns if c.lower() not in made]
    extra = [
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size("_stay")).cast("bigint").alias("n_dropped"),
    ]
    return kept.select(*columns, F.array_join("_stay", "\n").alias(out), *(extra if counts else []))


def dedup_document_lines(docs: DataFrame, ratio: float = DOC_RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """Documents with their columns as they were, sources taken as sites, boilerplate lines gone."""
    text = line_dedup(docs, F.col("source"), text_lines(F.col("text")), ratio, least, short_ratio=max(ratio, RATIO))
    return text.select(*[F.col(f"`{c}`") for c in docs.columns])
