"""Facts of web pages as column expressions: title, texts, contacts, links, research signals, kind of page, list entries.

Entries of listings are read by tag intervals (markup), so that nested blocks end where they end. The other facts are read with patterns:
blocks are matched from their opening to their next closing tag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspike.functions import markup as M
from marlspike.functions import text as X
from marlspike.sources.files import EMAIL, PHONE, first_match

# Words of listings in paths, fragments and titles.
LISTING_WORDS = ("directory", "exhibitor", "exhibitors", "catalog", "catalogue", "members", "member-directory", "participants", "attendees", "vendors", "companies", "fair-directory", "expo", "delegates")
# What the class of a listing's entries contains.
ENTRY_CLASSES = ("card", "item", "exhibitor", "listing", "tile", "directory-row")
# Blocks without text of their own.
SILENT = ("script", "style", "noscript", "svg", "nav", "footer", "header")
# What a listing's own controls say.
NO_NAMES = ("explore", "view all", "show more", "read more", "click here", "home", "about us", "contact us", "past exhibitors", "confirmed exhibitors", "exhibitor directory", "directory", "back")
#: Characters of pages whose tags a task gets on average.
TASK_TEXT = 2 << 20
MOST_TEXT, MOST_CONTACTS, MOST_LINKS = 10_000, 10, 20


def without_silent(html: Column) -> Column:
    return F.regexp_replace(F.coalesce(html, F.lit("")), "(?is)" + "|".join(rf"<{b}\b[^>]*>.*?</{b}>" for b in SILENT), " ")


def plain(html: Column) -> Column:
    """Text between tags, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", " "), r"\s+", " "))


def block(html: Column, tag: str) -> Column:
    """The inner HTML of the first block with a tag, or null."""
    return first_match(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)


def title(html: Column) -> Column:
    return F.coalesce(F.nullif(plain(block(html, "title")), F.lit("")), F.nullif(plain(block(html, "h1")), F.lit("")), F.lit(""))


def description(html: Column) -> Column:
    """The page's description, its name before or behind the content."""
    quoted = r"""["']([^"']+)["']"""
    named = r"""(?:name=["']description["']|property=["']og:description["'])"""
    return F.trim(F.coalesce(first_match(html, rf"(?is)<meta\s+{named}\s+content={quoted}", 1), first_match(html, rf"(?is)<meta\s+content={quoted}\s+{named}", 1)))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.trim(x)))


def emails(html: Column) -> Column:
    return F.slice(F.filter(matches(html, EMAIL), lambda x: ~x.rlike(r"\.(png|jpg|gif|svg)$")), 1, MOST_CONTACTS)


def phones(html: Column) -> Column:
    return F.slice(F.filter(matches(html, PHONE), lambda x: F.length(x).between(8, 20)), 1, MOST_CONTACTS)


def absolute(href: Column, url: Column) -> Column:
    """A reference seen from a page's address; dots in paths stay."""
    origin, folder = first_match(url, r"^https?://[^/?#]+"), first_match(url, r"^(https?://[^/?#]+(?:/[^?#]*)?)/", 1)
    return F.when(href.rlike("(?i)^[a-z][a-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(first_match(url, "^https?:"), href)).when(href.startswith("/"), F.concat(origin, href)).otherwise(F.concat(F.coalesce(folder, origin), F.lit("/"), href))


def links(html: Column, url: Column) -> Column:
    """Distinct references that leave the place, without scripts, in order."""
    own = F.filter(F.regexp_extract_all(html, F.lit(r"""(?is)<a\b[^>]*\bhref=["']([^"']+)["']"""), F.lit(1)), lambda h: ~h.startswith("#") & ~h.startswith("javascript:"))
    return F.array_distinct(F.transform(own, lambda h: absolute(h, url)))


def facts(pages: DataFrame, *more: Column) -> DataFrame:
    """page_id, url, more columns, with title, description, text_content, emails, phones, links (arrays joined by a blank)."""
    html, body = F.coalesce("html", F.lit("")), without_silent(F.col("html"))
    inside = F.coalesce(block(body, "body"), body)
    out = pages.select("page_id", "url", *more, title(body).alias("title"), description(html).alias("description"), F.substring(plain(inside), 1, MOST_TEXT).alias("text_content"), emails(html).alias("emails"), phones(html).alias("phones"), F.slice(links(body, F.col("url")), 1, MOST_LINKS).alias("links"))
    return out.withColumns({c: F.array_join(c, " ") for c in ("emails", "phones", "links")})


def research(pages: DataFrame) -> DataFrame:
    """page_id, summary (description of 11 to 349 characters), site_title, headings (three of 6 to 99 characters) of the first 50,000 characters."""
    head = F.substring(F.coalesce("html", F.lit("")), 1, 50_000)
    decoded = F.trim(F.replace(F.replace(F.replace(description(head), F.lit("&amp;"), F.lit("&")), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")))
    name = F.trim(F.replace(first_match(head, "(?i)<title>([^<]+)</title>", 1), F.lit("&amp;"), F.lit("&")))
    headings = F.transform(F.regexp_extract_all(head, F.lit(r"(?i)<h[12][^>]*>([^<]+)</h[12]>"), F.lit(1)), lambda h: F.trim(F.regexp_replace(h, r"\s+", " ")))
    headings = F.slice(F.filter(headings, lambda h: F.length(h).between(6, 99)), 1, 3)
    return pages.select("page_id", F.when(F.length(decoded).between(11, 349), decoded).alias("summary"), F.when(~F.lower(name).rlike("just a moment|403"), name).alias("site_title"), F.array_join(headings, "; ").alias("headings"))


def classify(pages: DataFrame) -> DataFrame:
    """page_id, score, page_type (DIRECTORY, DETAIL, SINGLE_COMPANY), confidence.

    Score: frames 40 each, a frame loader 50; listing words in the path 30, fragment 35, title 20; a listing section 25;
    10 listing cards 40; 5 repeated elements 25; 4 links with a common path 35. 40 makes a directory.
    """
    html, url = F.coalesce("html", F.lit("")), F.lower("url")
    words = "|".join(LISTING_WORDS)
    count = lambda pattern: F.regexp_count(html, F.lit(pattern))
    points = lambda condition, n: F.when(F.coalesce(condition, F.lit(False)), n).otherwise(0)
    frames = F.size(F.filter(F.regexp_extract_all(html, F.lit(r"""(?is)<iframe\b[^>]*\bsrc=["']([^"']+)["']"""), F.lit(1)), lambda s: ~s.rlike("google|youtube|vimeo")))
    path, fragment = first_match(url, r"^https?://[^/?#]+([^?#]*)", 1), first_match(url, "#(.*)$", 1)
    site = X.root_domain(first_match(url, r"^https?://([^/:?#]+)", 1))
    own = F.filter(links(html, F.col("url")), lambda u: X.root_domain(F.regexp_extract(F.lower(u), r"^https?://([^/:?#]+)", 1)) == site)
    prefixes = F.array_sort(F.filter(F.transform(own, lambda u: F.regexp_extract(u, r"^https?://[^/?#]+(/[^?#]+)/[^/?#]+/?(?:[?#].*)?$", 1)), lambda p: p != ""))
    repeated = F.exists(F.transform(prefixes, lambda p, i: p == F.get(prefixes, i + 3)), lambda same: F.coalesce(same, F.lit(False)))
    score = (
        40 * frames
        + points(html.rlike(r"""(?is)<script\b[^>]*\bsrc=["'][^"']*iframeUrl="""), 50)
        + points(path.rlike(words), 30)
        + points(fragment.rlike(words), 35)
        + points(F.lower(title(html)).rlike(words), 20)
        + points(html.rlike(r"""(?is)<[a-z][^>]*\b(?:id=["'][^"']*(?:exhibitor|directory)|class=["'][^"']*exhibitor-(?:section|list))"""), 25)
        + points(count(r"""(?is)<[a-z][^>]*\bclass=["'][^"']*exhibitor[-_](?:card|item)""") >= 10, 40)
        + points(count(r"""(?is)<(?:(?:tr|li|article)\b|[a-z][a-z0-9]*\b[^>]*\bclass=["'][^"']*(?:card|item|exhibitor))""") >= 5, 25)
        + points(repeated, 35)
    )
    back = html.rlike(r"(?is)<a\b[^>]*>[^<]*(?:back to directory|all exhibitors)") & (F.size(F.filter(F.split(path, "/"), lambda s: s != "")) >= 2)
    scored = pages.select("page_id", score.alias("score"), F.coalesce(back, F.lit(False)).alias("_back"))
    kind = F.when(F.col("score") >= 40, "DIRECTORY").when(F.col("_back"), "DETAIL").otherwise("SINGLE_COMPANY")
    confidence = F.when(F.col("score") >= 40, F.least(F.lit(1.0), F.col("score") / 100.0)).when(F.col("_back"), 0.85).otherwise(0.7)
    return scored.select("page_id", "score", kind.alias("page_type"), confidence.alias("confidence"))


def _class(*words: str) -> Column:
    """Whether a class contains one of these words."""
    return F.col("class").rlike("|".join(words))


def dealt(pages: DataFrame) -> DataFrame:
    """Pages by page_id in as many parts as their text needs: the windows over tags sort in these parts, several at a time, so that
    a task's memory doesn't grow with the table."""
    length = pages.agg(F.sum(F.length("html"))).first()[0] or 0
    least = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pages.repartition(max(least, -(-length // TASK_TEXT)), "page_id")


def containers(pages: DataFrame) -> DataFrame:
    """The tokens (markup.tokens, with end) of a listing's entries: page_id, url, k, card (the entry's own token number), whether the token's
    text stands directly in the entry, and the token's columns.

    Menus, controls and blocks of SILENT are left out. The scope is the element that the address's fragment names; else the exhibitor sections
    where they hold ten elements of an exhibitor class; else the page, as also where the scope has no container. A container that holds
    another one is a wrapper and no entry.
    """
    rows = M.elements(M.tokens(dealt(pages)))
    opened, name, k, end = F.col("end").isNotNull(), F.col("name"), F.col("k"), F.col("end")
    menu = name.isin("nav", "header", "footer", "button") | _class("menu", "nav", "sidebar", "btn", "filter") | F.col("id").rlike("menu|nav|sidebar")
    fragment = F.regexp_extract(F.coalesce("url", F.lit("")), "#(.+)$", 1)
    section = (name.isin("section", "div") & F.contains("id", F.lit("exhibitor"))) | ((name == "section") & _class("exhibitor")) | _class("exhibitor-section")
    rows = rows.withColumns({"_out": M.inside(opened & menu), "_at": opened & (F.col("id") != "") & (F.col("id") == fragment), "_section": opened & section, "_list": opened & (name == "ul") & _class(r"(^|\s)directory-list(\s|$)")})
    rows = rows.where("not _out").withColumns({"_in_fragment": M.inside(F.col("_at"), itself=False), "_in_section": M.inside(F.col("_section"), itself=False), "_in_list": M.inside(F.col("_list"), itself=False)})
    page = Window.partitionBy("page_id")
    enough = F.count_if(F.col("_in_section") & opened & _class("exhibitor")).over(page) >= 10
    scoped = F.when(M.on_page(F.col("_at")), F.col("_in_fragment")).when(enough, F.col("_in_section")).otherwise(True)
    kind = name.isin("article", "tr") | _class(*ENTRY_CLASSES) | ((name == "li") & F.col("_in_list"))
    rows = rows.withColumn("_container", opened & kind).withColumn("_scoped", F.col("_container") & scoped)
    following = F.lead("k").over(Window.partitionBy("page_id", "_container").orderBy("k"))
    leaf = F.col("_container") & (F.col("_scoped") | ~M.on_page(F.col("_scoped"))) & F.coalesce(following > end, F.lit(True))
    rows = rows.withColumn("_leaf", leaf)
    so_far = Window.partitionBy("page_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_card", F.last(F.when(F.col("_leaf"), F.struct("k", "end")), ignorenulls=True).over(so_far)).where(k < F.col("_card.end"))
    rows = rows.withColumn("card", F.col("_card.k"))
    below = F.max(F.when(k > F.col("card"), end)).over(Window.partitionBy("page_id", "card").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("direct", F.coalesce(below <= k, F.lit(True))).select("page_id", "url", "k", "card", "end", "name", "class", "href", "text", "direct")


def entries(pages: DataFrame) -> DataFrame:
    """A row for each entry of a listing page: place, name, link, email, phone, category, city, booth.

    The name is the first heading's text (or that of an element whose class says name or title, or of a strong one), else the first link's,
    else the text that stands directly in the entry, else all of it up to 100 characters; a tag parts words. The link stays on the page's own domain.
    """
    token = F.struct("k", "end", "name", "class", "href", "text", "direct")
    cards = containers(pages).groupBy("page_id", "url", "card").agg(F.array_sort(F.collect_list(token)).alias("t"))
    t, one_line = F.col("t"), lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    joined = lambda tokens: F.array_join(F.transform(tokens, lambda x: x["text"]), " ")

    def first_text(flag):
        """The text of the first element with a flag; empty without one. The entry itself is none of its elements."""
        e = F.get(F.filter(t, lambda x: x["end"].isNotNull() & (x["k"] > F.col("card")) & flag(x)), F.lit(0))
        return F.coalesce(one_line(joined(F.filter(t, lambda x: (x["k"] >= e["k"]) & (x["k"] < e["end"])))), F.lit(""))

    says = lambda x, words: x["class"].rlike(words)
    whole = one_line(joined(t))
    direct = one_line(joined(F.filter(t, lambda x: x["direct"])))
    fallback = F.coalesce(F.nullif(direct, F.lit("")), whole)
    name = F.coalesce(
        F.nullif(first_text(lambda x: x["name"].rlike("^(h[1-5]|strong)$") | says(x, "name|title")), F.lit("")), F.nullif(first_text(lambda x: x["name"] == "a"), F.lit("")), F.when(F.length(fallback).between(2, 100), fallback)
    )
    name = F.trim(F.regexp_replace(name, r"(?i)^(exhibitor|company|name):\s*", ""))
    hrefs = F.filter(F.transform(F.filter(t, lambda x: x["href"] != ""), lambda x: x["href"]), lambda h: ~h.rlike("^(#|javascript:|mailto:|tel:)"))
    own = F.filter(F.transform(hrefs, lambda h: absolute(h, F.col("url"))), lambda u: X.is_related(u, F.col("url")))
    with_scheme = lambda scheme: F.regexp_replace(F.get(F.filter(F.transform(t, lambda x: x["href"]), lambda h: F.startswith(h, F.lit(scheme))), F.lit(0)), f"^{scheme}", "")
    email = F.lower(F.trim(F.coalesce(F.split(with_scheme("mailto:"), r"\?")[0], first_match(F.col("whole"), EMAIL))))
    phone = F.trim(F.coalesce(with_scheme("tel:"), first_match(F.col("whole"), PHONE)))
    booth = first_match(F.col("whole"), r"(?i)\b(?:booth|stall|stand|hall)\s*[:#]?\s*([a-z]?-?\d+[a-z]?)", 1)
    out = cards.withColumns({"whole": whole, "company": name}).where(F.length("company") >= 2).where(F.length("whole") >= 2)
    out = out.where(~F.lower("company").rlike("^(" + "|".join(NO_NAMES) + ")$"))
    place = F.row_number().over(Window.partitionBy("page_id", "url").orderBy("card")) - 1
    return out.select("page_id", place.alias("place"), F.col("company").alias("name"), F.get(own, F.lit(0)).alias("link"), email.alias("email"), phone.alias("phone"), F.nullif(first_text(lambda x: says(x, "category|tag|badge|industry")), F.lit("")).alias("category"), F.nullif(first_text(lambda x: says(x, "location|city|address")), F.lit("")).alias("city"), booth.alias("booth"))
