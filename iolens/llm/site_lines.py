"""Lines that a site repeats on its pages, as DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iolens.llm.common import stored

RATIO = 0.5
#: Standard errors by which a share must exceed the ratio.
CERTAINTY = 1.645

# What has no text, and the tags that begin or end a line.
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
BREAKS = (
    r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|"
    r"h3|h4|h5|h6|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>"
)
TAGS = r"(?s)<[!/a-zA-Z][^>]*>"
SPACES = r"[ \t\n\x0B\f\r]+"


def html_lines(html: Column) -> Column:
    """The lines of a page: text between block tags, spaces run together, without empty lines.

    Character references stay as they are written. Null has no lines.
    """
    flat = F.regexp_replace(F.coalesce(html, F.lit("")), SPACES, " ")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(flat, HIDDEN, " "), BREAKS, "\n"), TAGS, "")
    trimmed = F.transform(F.split(plain, "\n"), lambda s: F.trim(F.regexp_replace(s, " +", " ")))
    return F.filter(trimmed, lambda s: s != "")


def host_of(url: Column) -> Column:
    """Host of a web address in lower case, without user and port; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(host, F.lit(""))


def drop_site_lines(
    pages: DataFrame, host: str, lines: str, ratio: float = RATIO, certainty: float = CERTAINTY
) -> DataFrame:
    """Replace the array ``lines`` by those that are not boilerplate, and add ``n_dropped``.

    A line is boilerplate on a host if the share of the host's rows that contain it exceeds ``ratio``, by
    ``certainty`` standard errors of a share seen on that many rows: of a host of three rows a line of all of
    them goes, of a large host one a little over the ratio. Rows without a host lose nothing; null lines count as
    none. Repeated rows each count. The result has the columns of ``pages`` and ``n_dropped``, which takes
    the place of a column of that name; give the input stored, as it is read three times.

    A host has at most (lines per page / ratio) boilerplate lines, so one row can hold their hashes.
    """
    listed = pages.select(F.col(host).alias("h"), F.explode(F.array_distinct(_digests(F.col(lines)))).alias("line"))
    pages_with = listed.where("h is not null").groupBy("h", "line").agg(F.count("*").alias("n"))
    totals = pages.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("h")).agg(F.count("*").alias("pages"))
    over = F.col("n") - ratio * F.col("pages")
    sure = (over > 0) & (over * over > certainty**2 * ratio * (1 - ratio) * F.col("pages"))
    common = pages_with.join(totals, "h").where(sure)
    # stored, so that the join below can split the pages of a large host
    drops = stored(common.groupBy("h").agg(F.collect_list("line").alias("__drops")), "site-drops")
    joined = pages.join(drops, pages[host] == drops["h"], "left")
    own = F.coalesce(lines, F.array().cast("array<string>"))
    kept = F.when(F.col("__drops").isNull(), own).otherwise(
        F.filter(own, lambda s: ~F.array_contains("__drops", F.unhex(F.md5(s))))
    )
    columns = [kept.alias(lines) if c == lines else pages[c] for c in pages.columns if c != "n_dropped"]
    return joined.select(*columns, (F.size(own) - F.size(kept)).cast("long").alias("n_dropped"))


def _digests(lines: Column) -> Column:
    return F.transform(lines, lambda s: F.unhex(F.md5(s)))
