"""Tags of pages as intervals: rows for tokens, elements from their opening to their own closing tag, and what lies in what.

A page is cut at its tags; token k is a tag with the text behind it. Opening and closing tags of one name are paired by their depth among
the tags of that name, so that nested blocks end where they end and an element that is never closed spoils no other name: it ends with
the page. An element is the interval from its token to its closing token; containment is comparison of token numbers, in windows over a page.
Comments and blocks without text (scripts, styles) are tokens of no name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A tag, a comment, or a block without text.
TOKEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<svg\b.*?</svg\s*>|<[/!]?[a-z][^>]*>"
# Elements without content.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
# The character references that are decoded.
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def decoded(text: Column) -> Column:
    for reference, character in REFERENCES:
        text = F.replace(text, F.lit(reference), F.lit(character))
    return text


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute in quotes; empty where there is none."""
    return F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*["']([^"']*)["']""", 1)


def tokens(pages: DataFrame) -> DataFrame:
    """page_id, url, k, tag, text (behind the tag), name, opens, closes, id, class, href; a page without tags has no rows."""
    html = F.coalesce("html", F.lit(""))
    cut = pages.select("page_id", "url", F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0)).alias("tags"), F.split(html, TOKEN, -1).alias("texts"))
    rows = cut.select("page_id", "url", F.posexplode(F.zip_with("tags", F.slice("texts", F.lit(2), F.greatest(F.size("tags"), F.lit(1))), lambda t, x: F.struct(t.alias("tag"), x.alias("text")))).alias("k", "t")).select("page_id", "url", "k", "t.tag", decoded(F.col("t.text")).alias("text"))
    plain = ~F.lower("tag").rlike("^<(script|style|noscript|svg|!)")
    name = F.when(plain, F.lower(F.regexp_extract("tag", "(?i)^</?([a-z][a-z0-9]*)", 1))).otherwise("")
    rows = rows.withColumn("name", name).withColumn("closes", F.startswith("tag", F.lit("</")))
    opens = (F.col("name") != "") & ~F.col("closes") & ~F.col("name").isin(*VOID) & ~F.endswith("tag", F.lit("/>"))
    return rows.select("*", opens.alias("opens"), attribute(F.col("tag"), "id").alias("id"), attribute(F.col("tag"), "class").alias("class"), F.when(F.col("name") == "a", attribute(F.col("tag"), "href")).otherwise("").alias("href"))


def elements(rows: DataFrame) -> DataFrame:
    """The tokens with end, for an opening tag the number of its closing token or behind the page's last one; null for other tokens."""
    by_name = Window.partitionBy("page_id", "name").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("opens"), 1).when(F.col("closes"), -1).otherwise(0)
    levelled = rows.withColumn("_level", F.sum(step).over(by_name) + F.when(F.col("closes"), 1).otherwise(0))
    # at one level of a name, openings and closings alternate
    paired = F.col("opens") | F.col("closes")
    at_level = Window.partitionBy("page_id", "name", "_level", paired).orderBy("k")
    last = F.max("k").over(Window.partitionBy("page_id"))
    end = F.when(F.col("opens"), F.coalesce(F.when(F.lead("closes").over(at_level), F.lead("k").over(at_level)), last + 1))
    return levelled.withColumn("end", end).drop("_level")


def inside(flag: Column, itself: bool = True) -> Column:
    """Whether a token lies in an element with a flag (or is its opening tag, with itself)."""
    w = Window.partitionBy("page_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow if itself else -1)
    return F.coalesce(F.max(F.when(flag, F.col("end"))).over(w) > F.col("k"), F.lit(False))


def on_page(flag: Column) -> Column:
    """Whether any token of the page has a flag."""
    return F.coalesce(F.max(flag.cast("int")).over(Window.partitionBy("page_id")) == 1, F.lit(False))
