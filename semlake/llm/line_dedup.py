"""Lines that a site repeats on most of its pages: dropped by site-relative frequency.

Pages are grouped by host. A line counts once for each page that has it; a line is boilerplate on its host if more than
``ratio`` of the host's pages have it. A line of a single page is repeated by none, so it is no boilerplate, whatever the
size of the site: the only page of a host keeps all its lines. Counts are combined before they move. A host has less
than (lines of an average page) / ratio boilerplate lines, so a host's list of them is small, whatever its size.

A page's lines are those of its text: comments, scripts and styles go, block-level tags and line ends part lines, other tags
go, and the commonest entities are resolved.

Defined results: lines have no white space around them, and blank lines are none; a null page gives a null text and no
lines; a page without text gives an empty one; a url without a host (or null) counts under the host ''; rows that share
a page_id are pages of their own; an empty table has an empty result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semlake.llm.common import join_hot, table

RATIO = 0.3
HIDDEN = r"(?is)<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)\s*>"
BLOCK = (
    r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header"
    r"|hr|html|li|main|nav|ol|option|p|pre|section|select|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*>"
)
TAG = r"<[^>]*>"
#: In this order, the ampersand's last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&"))
WHITE = " \t\n\x0b\x0c\r"


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port or path; '' if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def lines_of(html: Column) -> Column:
    """The lines of a page's text."""
    text = F.regexp_replace(html, HIDDEN, "")
    text = F.regexp_replace(F.regexp_replace(text, BLOCK, "\n"), TAG, "")
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    bare = F.transform(F.split(text, "\r?\n"), lambda x: F.btrim(x, F.lit(WHITE)))
    return F.filter(bare, lambda x: x != "")


def mark(line: Column) -> Column:
    """A line's name: 128 bits."""
    return F.unhex(F.md5(line.cast("binary")))


def split_pages(pages: DataFrame) -> DataFrame:
    """(page_id, host, lines; null for a null page), written once, as counting and dropping both read it."""
    return table(pages.select("page_id", host_of(F.col("url")).alias("host"), lines_of(F.col("html")).alias("lines")), "lines")


def boilerplate(split: DataFrame, ratio: float = RATIO) -> tuple[DataFrame, int]:
    """(host, pages, marks): the marks of each host's boilerplate lines (null for none); and the number of all pages."""
    marks = F.transform(F.array_distinct("lines"), mark)
    each = split.select("host", F.explode_outer(marks).alias("mark")).where("mark is not null")
    totals = table(split.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "hosts")
    counts = each.groupBy("host", "mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    often = counts.join(totals, "host").where(F.col("n") > F.col("pages") * ratio)
    marked = totals.join(often.groupBy("host").agg(F.collect_list("mark").alias("marks")), "host", "left")
    return table(marked, "boilerplate"), totals.agg(F.sum("pages")).first()[0] or 0


def drop_repeated_lines(pages: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(page_id, host, n_lines, n_dropped, text) for every page."""
    split = split_pages(pages)
    hosts, total = boilerplate(split, ratio)
    kept = F.filter("lines", lambda x: ~F.array_contains("marks", mark(x)))
    kept = F.when(F.col("marks").isNull(), F.col("lines")).otherwise(kept)
    none = F.col("lines").isNull()
    return join_hot(split, hosts, "host", "pages", total).withColumn("kept", kept).select(
        "page_id", "host", F.when(none, 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(none, 0).otherwise(F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("text"),
    )


def oracle(ratio: float = RATIO) -> str:
    text = f"regexp_replace(regexp_replace(regexp_replace(html, '{HIDDEN}', '', 'g'), '{BLOCK}', chr(10), 'g'), '{TAG}', '', 'g')"
    for entity, plain in ENTITIES:
        text = f"replace({text}, '{entity}', '{plain}')"
    return f"""
    WITH p AS (
      SELECT row_number() OVER () AS r, page_id, html,
             lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '')) AS host,
             regexp_split_to_array({text}, '\\r?\\n') AS lines FROM pages),
    l AS (SELECT r, host, trim(unnest(lines), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line, unnest(range(len(lines))) AS i FROM p),
    b AS (SELECT * FROM l WHERE line <> ''),
    n AS (SELECT host, line, count(DISTINCT r) AS n FROM b GROUP BY ALL),
    t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
    bad AS (SELECT host, line FROM n JOIN t USING (host) WHERE n > 1 AND n > pages * {ratio}),
    k AS (SELECT r, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n_kept FROM b ANTI JOIN bad USING (host, line) GROUP BY r),
    a AS (SELECT r, count(*) AS n_lines FROM b GROUP BY r)
    SELECT page_id, host, coalesce(n_lines, 0) AS n_lines, coalesce(n_lines, 0) - coalesce(n_kept, 0) AS n_dropped,
           CASE WHEN html IS NULL THEN NULL ELSE coalesce(text, '') END AS text
    FROM p LEFT JOIN a USING (r) LEFT JOIN k USING (r)"""
