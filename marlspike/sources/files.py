"""Lead rows from uploaded tables, pasted text and JSON payloads, as column expressions over (source_id, content).

A content is one upload (bounded by the upload limit of whoever stores it); its lines become rows at once, so that
everything behind the split runs line by line in parallel.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Header words of each lead field; a field applies if a cleaned header contains one of its words, the first field counts.
FIELD_ALIASES = {
    "company": ("company", "company name", "company_name", "companyname", "organization", "org", "organization name", "account", "business", "business name", "employer", "firm", "client"),
    "contact": ("contact", "contact name", "contact_name", "full name", "fullname", "name", "person", "lead name", "individual", "first and last name", "contact person"),
    "title": ("title", "job title", "job_title", "designation", "role", "position", "function", "headline"),
    "email": ("email", "e-mail", "mail", "email address", "contact email", "work email", "primary email", "business email"),
    "phone": ("phone", "telephone", "mobile", "cell", "phone number", "contact number", "tel", "work phone", "office phone"),
    "website": ("website", "web", "url", "site", "domain", "homepage", "company url", "company website", "website url", "web site"),
    "industry": ("industry", "sector", "vertical", "business type", "category", "segment"),
    "company_size": ("size", "company size", "employees", "headcount", "team size", "employee count", "staff count", "number of employees"),
    "city": ("city", "location", "metro", "town", "headquarters city", "hq city"),
    "state": ("state", "province", "region"),
    "country": ("country", "nation"),
    "address": ("address", "street", "office address", "full address", "hq address"),
    "linkedin": ("linkedin", "linkedin url", "linkedin profile", "linkedin_url", "company linkedin"),
}
# Patterns of addresses, phones and sites in free text.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{2,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{3,4}"
SITE = r"(?:https?://)?(?:www\.)?[a-zA-Z0-9-]+\.[a-zA-Z]{2,}(?:/[^\s]*)?"
# Keys that hold the records of a payload, and keys that wrap another level, in order.
RECORD_KEYS = ("items", "results", "data", "records", "exhibitors", "companies", "list", "rows", "members", "attendees")
WRAPPERS = ("data", "response", "payload", "result")
MOST_WRAPPERS = 3
# Names under which a JSON record carries each field, in order.
RECORD_FIELDS = {
    "contact": ("contactPerson", "contactPersonName", "contact_person", "contact_name", "contact", "person", "representative", "lead_name", "owner"),
    "email": ("email", "contact_email", "mail", "company_email"),
    "phone": ("phone", "mobile", "telephone", "contact_no", "cell"),
    "city": ("city", "location", "district"),
    "state": ("state", "province"),
    "country": ("country", "nation"),
    "industry": ("category", "subcategory", "productGroupName", "productCategory", "industry", "sector", "products"),
    "hall": ("hall", "hallNumber", "hall_no"),
    "stall": ("booth", "stallNumber", "stall", "stand"),
    "website": ("website", "website_url", "url", "web"),
}
COMPANY_KEYS = ("companyName", "company_name", "exhibitorName", "exhibitor_name", "business_name", "organization")
LOOSE_COMPANY_KEYS = ("name", "company", "title")
BUSINESS_KEYS = ("email", "contact_email", "phone", "mobile", "telephone", "contactPerson", "contactPersonName", "contact_person", "contact", "website", "website_url", "city", "location", "stallNumber", "hallNumber", "stall", "booth", "urn")
# Titles of listings and labels of pages that aren't companies.
LISTING_TITLES = (
    r"^exhibitor\s+directory", "^directory", r"^member\s+directory", "^participants", "^attendees", r"^vendor\s+catalog", r"^trade\s+fair\s+directory", r"^expo\s+directory", r"^all\s+exhibitors", r"^search\s+exhibitors", r"^featured\s*\(\d+\)",
    r"^(?:npe|pack\s*expo|imex|gitex|ces|hannover\s*messe|semashow|canton\s*fair|fabtech)\s*(?:20\d\d)?", r":\s*the\s+(?:plastics|packaging|manufacturing|baking)\s+show", r"\b(?:the\s+plastics\s+show|the\s+packaging\s+show|the\s+baking\s+expo)\b", r"^(?:event|conference|summit|exhibition|trade\s*show)\s*(?:20\d\d)?$", "^home$", "^back$",
)


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def times(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def lines_of(content: Column) -> Column:
    """Lines that aren't blank."""
    return F.filter(F.split(F.coalesce(content, F.lit("")), r"\r?\n"), lambda line: F.trim(line) != "")


#: What stands for the line ends within quoted cells while a table is split into lines.
_HELD = ("\u0001\u0002", "\n\r")


def records_of(content: Column) -> Column:
    """A table's lines that aren't blank; line ends within quotes are held back until cells() gives them out."""
    held = F.transform(F.split(F.coalesce(content, F.lit("")), '"', -1), lambda part, i: F.when(i % 2 == 1, F.translate(part, _HELD[1], _HELD[0])).otherwise(part))
    return lines_of(F.array_join(held, '"'))


def delimiter(content: Column) -> Column:
    """The most frequent of comma, tab and semicolon in the first 2,000 characters; a tie is a comma."""
    sample = F.substring(content, 1, 2000)
    commas, tabs, semicolons = times(sample, ","), times(sample, "\t"), times(sample, ";")
    return F.when((tabs > commas) & (tabs > semicolons), "\t").when((semicolons > commas) & (semicolons > tabs), ";").otherwise(",")


def cells(line: Column, mark: Column) -> Column:
    """A line's trimmed cells; quoted ones may hold delimiters and doubled quotes."""

    def split_at(sep: str) -> Column:
        # every cell is matched with the delimiter before it, so that no match is empty
        pattern = f'{re.escape(sep)} *("(?:[^"]|"")*"|[^{re.escape(sep)}]*)'
        return F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(pattern), F.lit(1))

    raw = F.when(mark == "\t", split_at("\t")).when(mark == ";", split_at(";")).otherwise(split_at(","))
    unquoted = lambda x: F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))
    return F.transform(raw, lambda x: F.trim(F.when(x.startswith('"'), F.translate(unquoted(x), *_HELD)).otherwise(x)))


def field_of(header: Column) -> Column:
    """The lead field that a header stands for, or null."""
    clean = F.trim(F.regexp_replace(F.lower(header), "[^a-z0-9]", " "))
    return F.coalesce(*[F.when(clean.rlike("|".join(re.escape(a) for a in aliases)), field) for field, aliases in FIELD_ALIASES.items()])


def table_rows(sources: DataFrame) -> DataFrame:
    """source_id, row_number (the header is row 1), the lead fields and parse_status (PARSED or FAILED) of delimited contents."""
    opened = sources.select("source_id", delimiter(F.col("content")).alias("mark"), records_of(F.col("content")).alias("lines"))
    headed = opened.where(F.size("lines") > 0).select("source_id", "mark", "lines", F.transform(cells(F.col("lines")[0], F.col("mark")), field_of).alias("fields"))
    rows = headed.select("source_id", "mark", "fields", F.posexplode("lines").alias("pos", "line")).where("pos > 0")
    rows = rows.withColumn("pairs", F.zip_with("fields", cells(F.col("line"), F.col("mark")), lambda f, v: F.struct(f.alias("f"), v.alias("v"))))
    # of several columns of one field the last that isn't empty counts

    def last(field: str) -> Column:
        return F.try_element_at(F.filter("pairs", lambda p: (p["f"] == field) & (p["v"] != "")), F.lit(-1))["v"]

    out = rows.select("source_id", (F.col("pos") + 1).alias("row_number"), *[last(f).alias(f) for f in FIELD_ALIASES])
    host = F.split(F.split(F.regexp_replace("website", r"(?i)^(?:https?://)?(?:www\.)?", ""), "/")[0], r"\.")[0]
    out = out.withColumn("company", F.coalesce("company", F.when(F.col("website").isNotNull(), F.coalesce(F.nullif(host, F.lit("")), F.lit("Company")))))
    known = F.coalesce("company", "email", "website", "phone").isNotNull()
    return out.withColumn("parse_status", F.when(known, "PARSED").otherwise("FAILED"))


def is_table(content: Column) -> Column:
    """Whether the first five lines hold two commas or a tab."""
    head = F.array_join(F.slice(lines_of(content), 1, 5), "\n")
    return (times(head, ",") >= 2) | (times(head, "\t") >= 1)


def text_rows(sources: DataFrame) -> DataFrame:
    """The same columns (fewer fields) from lines of free text: one lead for each line with an address, phone, site or separator.

    A pattern is tried only on lines that have the characters it needs; what it finds is computed once.
    """
    rows = sources.select("source_id", F.posexplode(lines_of(F.col("content"))).alias("pos", "line"))
    digits = F.length("line") - F.length(F.translate("line", "0123456789", ""))
    dot = F.contains(F.col("line"), F.lit("."))
    tried = {"email": (dot & F.contains(F.col("line"), F.lit("@")), EMAIL), "phone": (digits >= 8, PHONE), "website": (dot, SITE)}
    found = rows.select("*", *[F.when(needed, first_match(F.col("line"), p)).alias(name) for name, (needed, p) in tried.items()], F.split("line", r"[|\t,-]").alias("parts"))
    first = F.trim(F.col("parts")[0])
    company = F.when((first != "") & (F.length(first) < 80), first).otherwise(F.concat(F.lit("Company "), F.col("pos") + 1))
    known = F.coalesce("email", "phone", "website").isNotNull() | (F.size("parts") > 1)
    return found.select("source_id", (F.col("pos") + 1).alias("row_number"), F.when(known, company).alias("company"), "email", "phone", "website", F.when(known, "PARSED").otherwise("FAILED").alias("parse_status"))


def pasted_rows(sources: DataFrame) -> DataFrame:
    """Tables or free text, as each content looks."""
    table = table_rows(sources.where(is_table(F.col("content")))).select("source_id", "row_number", "company", "email", "phone", "website", "parse_status")
    return table.unionByName(text_rows(sources.where(~is_table(F.coalesce("content", F.lit(""))))))


def find_records(payload: Column) -> Column:
    """The list (array of variants) of at least two records in a parsed payload: itself, under a known key, or within up to three wrappers; the
    keys of a level come before its wrappers, a wrapper with all within it before the next."""

    def own(node: Column) -> Column:
        lists = F.array(*[F.try_variant_get(node, path, "array<variant>") for path in ("$", *[f"$.{key}" for key in RECORD_KEYS])])
        return F.get(F.filter(lists, lambda x: F.size(x) >= 2), 0)

    def within(node: Column) -> Column:
        return F.array(*[F.struct(F.concat(node["place"], F.lit(str(i))).alias("place"), F.try_variant_get(node["value"], f"$.{key}", "variant").alias("value")) for i, key in enumerate(WRAPPERS)])

    level = F.array(F.struct(F.lit("").alias("place"), payload.alias("value")))
    levels = [level]
    for _ in range(MOST_WRAPPERS):
        level = F.filter(F.flatten(F.transform(level, within)), lambda n: n["value"].isNotNull())
        levels.append(level)
    found = F.filter(F.transform(F.concat(*levels), lambda n: F.struct(n["place"].alias("place"), own(n["value"]).alias("records"))), lambda n: n["records"].isNotNull())
    none = F.lit(None).cast("struct<place:string,records:array<variant>>")
    return F.aggregate(found, none, lambda first, n: F.when(first.isNull() | (n["place"] < first["place"]), n).otherwise(first))["records"]


def json_records(sources: DataFrame) -> DataFrame:
    """source_id, row_number, record (JSON text): a row for each record of the payloads; what isn't JSON, or has an object with a key twice, has none."""
    found = sources.select(F.col("source_id").cast("long").alias("source_id"), find_records(F.try_parse_json("content")).alias("records"))
    return found.select("source_id", F.posexplode("records").alias("place", "value")).select("source_id", (F.col("place") + 1).alias("row_number"), F.to_json("value").alias("record"))


def is_listing_title(name: Column) -> Column:
    """Whether a name is that of a listing or a label of the page; names below two characters are."""
    return (F.length(name) < 2) | F.lower(F.trim(name)).rlike("|".join(LISTING_TITLES))


def record_leads(records: DataFrame) -> DataFrame:
    """Lead fields of JSON records; records without a company, of listings, categories and floor plans are left out."""
    get = lambda keys: F.coalesce(*[F.nullif(F.trim(F.get_json_object("record", f"$.{k}")), F.lit("")) for k in keys])
    company = F.coalesce(get(COMPANY_KEYS), F.when(get(BUSINESS_KEYS).isNotNull(), get(LOOSE_COMPANY_KEYS)))
    out = records.select("source_id", "row_number", company.alias("company"), *[get(keys).alias(f) for f, keys in RECORD_FIELDS.items()], get(("address", "full_address")).alias("address"))
    out = out.where(F.col("company").isNotNull() & ~is_listing_title(F.col("company")) & ~F.col("company").rlike(r"^\d+\.\s+[A-Z\s&]+$|(?i:floor\s+layout|floor\s+plan)"))
    email = F.when(~F.lower("email").rlike("exhibition@|directory@"), F.lower("email"))
    return out.withColumns({"email": email, "address": F.coalesce("address", F.nullif(F.concat_ws(" / ", "hall", "stall"), F.lit("")))})
