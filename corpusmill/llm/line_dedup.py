"""Line dedup by site-relative frequency, with DataFrame functions only.

A line's ratio is the share of a site's pages that hold it; exact copies of a page count as one page, so that they don't
make its lines look like boilerplate. Lines above the limit are boilerplate of that site and go from its pages; elsewhere
they stay. A site can't have more such lines than its mean number of lines a page divided by
the limit, so they are carried as one array of hashes a site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import written

#: Sites with boilerplate up to which their arrays are broadcast; beyond, pages are joined by a key of their own.
BROADCAST_SITES = 20_000


def host(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _hashes(text: Column) -> Column:
    """Hashes of the different lines of a text, without blank ones."""
    bare = F.filter(F.transform(_lines(text), _bare), lambda x: x != "")
    return F.array_distinct(F.transform(bare, lambda x: F.xxhash64(x)))


def boilerplate(pages: DataFrame, site: Column, text_col: str = "text", ratio: float = 0.05, least_pages: int = 5) -> DataFrame:
    """``_site`` and ``_lines``: hashes of the lines that more than ``ratio`` of the site's different pages hold, and at least ``least_pages``.

    Counts are taken before the shuffle, so a site with most of the pages costs no more than its different lines; its
    pages meet by site and text, so they spread too.
    """
    whole = F.coalesce(text_col, F.lit(""))
    copies = pages.select(site.alias("_site"), F.xxhash64(whole).alias("_h1"), F.xxhash64(whole, F.lit(1)).alias("_h2"), _hashes(F.col(text_col)).alias("_all"))
    # written once: 8 bytes for each line, read for the totals and for the lines
    rows = written(copies.groupBy("_site", "_h1", "_h2").agg(F.first("_all").alias("_all")).select("_site", "_all"), "page_lines")
    totals = rows.groupBy("_site").agg(F.count("*").alias("_pages"))
    held = rows.select("_site", F.explode("_all").alias("_line")).groupBy("_site", "_line").agg(F.count("*").alias("_n")).where(F.col("_n") >= least_pages)
    often = held.join(totals, held["_site"].eqNullSafe(totals["_site"])).where(F.col("_n") > ratio * F.col("_pages"))
    return often.select(held["_site"], "_line").groupBy("_site").agg(F.collect_set("_line").alias("_lines"))


def drop_boilerplate(pages: DataFrame, site: Column, text_col: str = "text", ratio: float = 0.05, least_pages: int = 5, counts: bool = False, broadcast_sites: int = BROADCAST_SITES) -> DataFrame:
    """``pages`` with boilerplate lines cut from the text; all other columns and rows stay.

    Lines compare without blanks at their ends; blank lines are never boilerplate. A null text stays null, a null site is
    a site of its own. With ``counts``, n_lines and n_dropped are added. Texts are whole, and repeated rows all stay; the
    row's columns, whatever their names, don't clash with what is added on the way.
    """
    often = written(boilerplate(pages, site, text_col, ratio, least_pages), "boilerplate")
    # the row's own columns stay together in one, whatever their names
    row = F.col("_row")
    whole = row.getField(text_col)
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_row"), site.alias("_own_site"))
    if often.limit(broadcast_sites + 1).count() <= broadcast_sites:  # arrays of bounded length, at most so many
        joined = rows.join(F.broadcast(often), F.col("_own_site").eqNullSafe(F.col("_site")), "left")
    else:
        # only pages that hold such a line are looked up; they move by a hash of their own, not by site
        key = F.xxhash64("_own_site", whole)
        lines = rows.select(key.alias("_key"), "_own_site", F.explode(_hashes(whole)).alias("_line"))
        flat = often.select("_site", F.explode("_lines").alias("_often"))
        hit = lines.join(flat, (F.col("_line") == F.col("_often")) & F.col("_own_site").eqNullSafe(F.col("_site"))).groupBy("_key").agg(F.collect_set("_line").alias("_lines"))
        joined = rows.withColumn("_mine", key).join(hit, F.col("_mine") == F.col("_key"), "left")
    kept = F.filter(_lines(whole), lambda x: (_bare(x) == "") | ~F.array_contains("_lines", F.xxhash64(_bare(x))))
    text = F.when(F.col("_lines").isNull() | whole.isNull(), whole).otherwise(F.array_join(kept, "\n"))
    total = F.size(_lines(whole))
    dropped = F.when(F.col("_lines").isNull(), F.lit(0)).otherwise(total - F.size(kept))
    out = joined.select("_row", text.alias("_text"), total.cast("long").alias("_total"), dropped.cast("long").alias("_dropped"))
    extra = [F.col("_total").alias("n_lines"), F.col("_dropped").alias("n_dropped")] if counts else []
    return out.select(*[F.col("_text").alias(c) if c == text_col else row.getField(c).alias(c) for c in pages.columns], *extra)
