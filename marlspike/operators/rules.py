"""Small rules of the data model as queries: lead payloads, facets, paging, caps, provenance, run metrics, recovery, text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlspike import streaming, views
from marlspike.functions import calendar as C
from marlspike.functions import templates as T
from marlspike.functions import text as X
from marlspike.operators import leads as L
from marlspike.operators.audience import contains
from marlspike.sources import files as S
from marlspike.views import with_views

#: Columns that a caller may sort leads by.
SORTABLE = ("row_number", "company", "city", "completeness")
EXPORT_CAP, PREVIEW_CAP, BUFFER_CAP = 10_000, 50, 50
# Names under which a paged response tells its pages, records, current page and page size, in order; the levels
# that may hold them; and the parameters of its address.
PAGES = ("totalPages", "total_pages", "pageCount", "page_count")
RECORDS = ("totalElements", "total_elements", "totalRecords", "total_records", "total", "totalCount")
CURRENT = ("pageNumber", "page", "currentPage")
SIZES = ("pageSize", "page_size", "limit", "per_page")
LEVELS = ("$", "$.data", "$.pagination", "$.meta", "$.paging", "$.info")
PAGE_PARAMETERS, OFFSET_PARAMETERS, SIZE_PARAMETERS = "pagenumber|page_number|page_no|pageno|page|p", "offset|start|skip", "pagesize|page_size|limit|per_page|size|rows"
#: States of a batch that is being worked on, and minutes after which it counts as stalled.
WORKING, STALLED_MINUTES, STALLED_AT_ONCE = ("QUEUED", "DISCOVERING", "EXTRACTING", "NORMALIZING", "DEDUPLICATING", "RESOLVING"), 5, 10


def payload(rows: DataFrame) -> DataFrame:
    """The 28 columns of a lead from whatever of its fields rows has; absent ones are null."""
    field = lambda name: F.col(name).cast("string") if name in rows.columns else F.lit(None).cast("string")
    text = lambda name: X.blank_to_null(field(name))
    whole = rows.withColumn("_division", X.company_division(F.coalesce(text("company"), text("raw_name")))).withColumns({"_domain": X.domain(F.coalesce(text("domain"), text("website"))), "_email": X.email(field("email")), "_phone": X.phone(field("phone"))})
    related = F.col("_division.relation").isNotNull()
    name = F.when(related & (F.col("_division.base") != ""), F.col("_division.base")).otherwise(F.trim(field("company")))
    score = X.completeness(company=field("company"), site=F.coalesce(F.col("_domain"), field("website")), email=F.col("_email"), phone=F.col("_phone"), contact=field("contact"), title=field("title"), city=field("city"), industry=field("industry"))
    plain = ("booth", "hall", "category", "detail_url", "source_url", "contact", "title", "city", "state", "country", "address", "industry", "company_size", "linkedin")
    return whole.select(
        "row_number", F.trim(F.coalesce(field("raw_name"), field("company"))).alias("raw_name"), name.alias("company"), X.company_name(name).alias("name"), F.col("_domain").alias("domain"),
        F.coalesce(text("website"), F.concat(F.lit("https://"), "_domain")).alias("website"), *[text(c).alias(c) for c in plain], F.col("_email").alias("email"), F.col("_phone").alias("phone"), field("source_type").alias("source_type"), field("source_name").alias("source_name"),
        F.to_json(provenance(F.create_map(F.lit("sourceType"), field("source_type")), F.create_map(F.lit("relation"), F.col("_division.relation"), F.lit("parent"), F.col("_division.parent")), related)).alias("provenance"),
        F.col("_email").isNotNull().alias("has_email"), F.col("_domain").isNotNull().alias("has_domain"), F.col("_phone").isNotNull().alias("has_phone"), score.alias("completeness"),
    )


def provenance(own: Column, more: Column, applies: Column) -> Column:
    """own with the entries of more where they apply; those of more win."""
    return F.when(applies, F.map_concat(F.map_filter(own, lambda k, _: ~F.array_contains(F.map_keys(more), k)), more)).otherwise(own)


def facet_counts(leads: DataFrame, dedupe: str | None = None, resolution: str | None = None) -> DataFrame:
    """Counts under the current filter by status in one pass; a facet's own filter gives way to the facet.

    leads has passed the other filters: status, resolution.
    """
    d = F.col("status") == dedupe if dedupe else F.lit(True)
    r = F.col("resolution") == resolution if resolution and resolution != "ALL" else F.lit(True)
    by_status = [F.count_if((F.col("status") == s) & r).alias(s.lower()) for s in ("UNIQUE", "DUPLICATE", "POSSIBLE_DUPLICATE")]
    by_resolution = [F.count_if((F.col("resolution") == s) & d).alias(s.lower()) for s in ("RESOLVED_HIGH", "RESOLVED_MEDIUM", "UNRESOLVED", "REVIEW_REQUIRED")]
    return leads.agg(F.count_if(d & r).alias("total"), *by_status, *by_resolution)


def batch_summary(judged: DataFrame, stored: DataFrame, batch: str = "user_id") -> DataFrame:
    """Ten counts of each batch of leads (status, resolution, source, email, phone); a stored counter counts where it isn't zero.

    stored: batch, resolved, unresolved, review, found.
    """
    none = lambda c: F.count_if(F.col(c).isNull()).alias(f"missing_{c}")
    by_status = [F.count_if(F.col("status") == s).alias(s.lower()) for s in ("UNIQUE", "DUPLICATE", "POSSIBLE_DUPLICATE")]
    levels = {"resolved": ("RESOLVED_HIGH", "RESOLVED_MEDIUM"), "unresolved": ("UNRESOLVED",), "review": ("REVIEW_REQUIRED",)}
    counted = {name: F.count_if(F.col("resolution").isin(*those)) for name, those in levels.items()} | {"found": F.count_if(F.col("source") == "DIRECTORY")}
    n = judged.groupBy(batch).agg(F.count(F.lit(1)).alias("total"), *by_status, none("email"), none("phone"), *[c.alias(name) for name, c in counted.items()])
    known = stored.select(batch, *[F.nullif(c, F.lit(0).cast("long")).alias(f"stored_{c}") for c in counted])
    return n.join(known, batch, "left").withColumns({c: F.coalesce(f"stored_{c}", c) for c in counted}).select(*n.columns)


def buffers(candidates: DataFrame, batch: Column, cap: int, by: str = "campaign_id") -> DataFrame:
    """The candidates that a mailbox looks at for a batch of k: 10 k + k by due time and id, cap at most, with their place."""
    place = F.row_number().over(Window.partitionBy(by).orderBy("due", "id"))
    return candidates.withColumn("place", place).where(F.col("place") <= F.least(F.lit(cap), batch * 10 + batch))


def newest(rows: DataFrame, cap: int, by: str = "row_number") -> DataFrame:
    """The newest rows up to the export's cap."""
    return rows.orderBy(F.desc(by)).limit(cap)


def allowed_days(pairs: DataFrame, own: Column, box: Column, by: str = "campaign_id") -> DataFrame:
    """by, days: days on which each campaign can send through any of its mailboxes; a row of pairs for each mailbox. Without any day there is no row."""
    shared = C.common_days(C.normalize_days(own), C.normalize_days(box))
    # seven days at most a pair, distinct before they meet
    days = pairs.select(by, F.explode(shared).alias("day")).distinct().groupBy(by).agg(F.array_sort(F.collect_list("day")).alias("days"))
    return days.select(by, F.array_join("days", ",").alias("days"))


def lists_of(several: Column, single: Column) -> Column:
    """The lists of a campaign: those named, else its single one, else none."""
    none = F.array().cast("array<bigint>")
    return F.when(F.size(F.coalesce(several, none)) > 0, several).when(single.isNotNull(), F.array(single)).otherwise(none)


def contact_tiers(rows: DataFrame, contacts: DataFrame, emails: DataFrame) -> DataFrame:
    """row_number, reason, contact_id of each imported row: the known contact by address, else by profile address, else by name and company; of
    several the lowest id. rows: row_number, email, profile, full_name, company. contacts: id, profile, full_name, industry."""
    first = lambda df, key, name: df.groupBy(key.alias(name)).agg(F.min("id").alias(f"by_{name}")).where(F.col(name).isNotNull())
    by_email = first(emails.select(F.col("contact_id").alias("id"), "normalized_email"), F.col("normalized_email"), "address")
    by_profile = first(contacts, F.lower("profile"), "page")
    by_name = first(contacts, F.concat_ws("|", F.lower("full_name"), F.lower("industry")), "person")
    keyed = rows.withColumns({"address": X.blank_to_null(F.lower("email")), "page": F.lower(X.clean_url(F.col("profile"))), "person": F.lower(F.concat_ws("|", F.trim("full_name"), F.trim("company")))})
    joined = keyed.join(by_email, "address", "left").join(by_profile, "page", "left").join(by_name, "person", "left")
    reason = F.when(F.col("by_address").isNotNull(), "EXACT_EMAIL").when(F.col("by_page").isNotNull(), "EXACT_LINKEDIN").when(F.col("by_person").isNotNull(), "CONTACT_AND_ORGANIZATION")
    return joined.select("row_number", reason.alias("reason"), F.coalesce("by_address", "by_page", "by_person").alias("contact_id"))


def search_leads(leads: DataFrame, text: str | None = None, columns: tuple[str, ...] = ("company", "contact", "email", "domain", "city", "booth", "hall", "category"), has: tuple[str, ...] = ()) -> DataFrame:
    """Leads with a text in any of the columns that they have, and with all of has (email, phone, domain)."""
    if text and text.strip():
        hits = [F.coalesce(contains(F.col(c), text.strip()), F.lit(False)) for c in columns if c in leads.columns]
        leads = leads.where(F.array_contains(F.array(*hits), True))
    for name in has:
        leads = leads.where(F.col(name).isNotNull())
    return leads


def page(rows: DataFrame, by: str, descending: bool, number: int, size: int, most: int, key: str = "row_number", sortable: tuple[str, ...] = SORTABLE) -> DataFrame:
    """A page of rows sorted by one of the sortable columns, with the key as tiebreak; size is held within 1 and most."""
    if by not in sortable:
        raise ValueError(f"leads aren't sorted by {by}")
    size = min(most, max(1, size))
    return rows.orderBy(F.desc(by) if descending else F.asc(by), key).offset((max(1, number) - 1) * size).limit(size)


def with_leads(raw: DataFrame, leads: DataFrame) -> DataFrame:
    """raw (position from 0, row_number?) with the company of its lead: that of its row number (position + 1 where it has
    none), else the lead at its position. leads: position, row_number?, company."""
    number = F.coalesce("row_number", F.col("position") + 1)
    by_number = leads.where("row_number > 0").groupBy(F.col("row_number").alias("number")).agg(F.max_by(F.struct("company"), "position").alias("numbered"))
    by_place = leads.select("position", F.struct("company").alias("placed"))
    joined = raw.withColumn("number", number).join(by_number, "number", "left").join(by_place, "position", "left")
    return joined.select("position", F.col("number").alias("row_number"), F.coalesce("numbered", "placed")["company"].alias("company"))


def merge_detail(cards: DataFrame, details: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Listing cards with what their detail pages tell; a detail that isn't blank wins."""
    d = details.select("detail_url", *[F.col(f).alias(f"_{f}") for f in fields])
    return cards.join(d, "detail_url", "left").select("detail_url", *[F.coalesce(X.blank_to_null(F.col(f"_{f}")), F.col(f)).alias(f) for f in fields])


def register_leads(found: DataFrame) -> DataFrame:
    """found (run, position, company, domain?, website?) with key and kept: the first of each domain, or else name, within a run.

    Records without a company and titles of listings aren't discovered at all.
    """
    there = found.where(X.blank_to_null(F.col("company")).isNotNull() & ~S.is_listing_title(F.col("company")))
    key = F.coalesce(X.domain(F.coalesce(X.blank_to_null(F.col("domain")), F.col("website"))), X.company_name(F.col("company")))
    first = F.row_number().over(Window.partitionBy("run", "key").orderBy("position"))
    return there.withColumn("key", key).withColumn("kept", first == 1)


def paging_of(responses: DataFrame) -> DataFrame:
    """response_id, parameter, size_parameter, page_size, current_page, total_pages, total_records, zero_indexed, by_offset of the
    captured responses (response_id, url, body) that are pages of more; numbers that stand as texts don't count.
    """

    def number(names: tuple[str, ...]) -> Column:
        # the last level that has one counts, and within it the first name
        at = lambda level, name: F.try_variant_get("_v", f"{level}.{name}", "variant")
        numeric = lambda v: F.when(F.schema_of_variant(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, "$", "double"))
        return F.coalesce(*[F.coalesce(*[numeric(at(level, name)) for name in names]) for level in reversed(LEVELS)])

    pairs = F.filter(F.split(F.coalesce(F.try_parse_url("url", F.lit("QUERY")), F.lit("")), "&"), lambda p: F.contains(p, F.lit("=")))
    parameters = F.transform(pairs, lambda p: F.struct(F.split(p, "=")[0].alias("k"), F.split(p, "=", 2)[1].alias("v")))
    named = lambda pattern: F.get(F.filter("_p", lambda p: p["k"].rlike(f"(?i)^({pattern})$") & (p["v"] != "")), F.lit(0))
    whole = lambda c: F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("long")
    r = responses.withColumns({"_v": F.try_parse_json("body"), "_p": parameters}).where("_v is not null")
    r = r.withColumns({"_pages": F.coalesce(number(PAGES), F.lit(1.0)), "_records": F.coalesce(number(RECORDS), F.lit(0.0)), "_current": F.coalesce(number(CURRENT), F.lit(1.0)), "_size": F.coalesce(number(SIZES), F.lit(20.0)), "_page": named(PAGE_PARAMETERS), "_offset": named(OFFSET_PARAMETERS), "_limit": named(SIZE_PARAMETERS)})
    asked = whole(F.col("_limit.v"))
    r = r.withColumn("_size", F.when(asked > 0, asked.cast("double")).otherwise(F.col("_size")))
    by_offset = F.col("_page").isNull()
    value = F.coalesce(F.nullif(whole(F.coalesce(F.col("_page.v"), F.col("_offset.v"))), F.when(~by_offset, F.lit(0).cast("long"))), F.when(by_offset, F.lit(0.0)).otherwise(F.col("_current")).cast("long"))
    counted = F.ceil(F.col("_records") / F.col("_size"))
    pages = F.when((F.col("_records") > 0) & (F.col("_pages") <= 1) & (F.col("_size") > 0), counted).otherwise(F.col("_pages"))
    found = r.where("_page is not null or _offset is not null").withColumns({"_pages": pages, "_value": value})
    more = found.where((F.col("_pages") > 1) | (F.col("_records") > F.col("_size")))
    return more.select(
        "response_id", F.coalesce("_page.k", "_offset.k").alias("parameter"), F.col("_limit.k").alias("size_parameter"), F.col("_size").cast("long").alias("page_size"),
        F.when(by_offset, F.floor(F.col("_value") / F.col("_size")) + 1).otherwise(F.col("_value")).cast("long").alias("current_page"),
        F.greatest(F.col("_pages"), F.when(F.col("_records") > 0, counted).otherwise(F.lit(2))).cast("long").alias("total_pages"), F.nullif(F.col("_records").cast("long"), F.lit(0).cast("long")).alias("total_records"),
        F.when(by_offset, F.lit(True)).otherwise(F.col("_value") == 0).alias("zero_indexed"), by_offset.alias("by_offset"),
    )


COUNTERS = {"emails_sent": "SENT", "duplicate_sent_reconciled": "ADVANCE", "duplicate_failed_handled": "WAIT", "stale_pending_recovered": "STALE_RETRY", "safety_skipped": "SAFETY", "suppressed": "SUPPRESSED", "cooldown_blocked": "COOLDOWN", "capacity_blocked": "CAPACITY", "failed": "FAILED", "hol_blocked_avoided": "HOL"}


def run_metrics() -> dict[str, Column]:
    """The counters of a scheduler run over its outcomes (campaign_id, mailbox, outcome), as named aggregates; fit for observe()."""
    outcome = F.col("outcome")
    return {
        "campaigns_checked": F.size(F.collect_set("campaign_id")).cast("long"), "mailboxes_eligible": F.size(F.collect_set(F.when(outcome == "SENT", F.col("mailbox")))).cast("long"), "candidates_examined": F.count(F.lit(1)),
        **{name: F.count_if(outcome == kind) for name, kind in COUNTERS.items()}, "emails_skipped": F.count_if(~outcome.isin("SENT", "FAILED")),
    }


def stalled(batches: DataFrame, now: Column, minutes: int = STALLED_MINUTES, most: int = STALLED_AT_ONCE) -> DataFrame:
    """The oldest batches (most at a time) that are still worked on after so many minutes and can be started again: they have an address."""
    old = batches.where(F.col("status").isin(*WORKING) & (F.col("created_at") < now - F.make_dt_interval(mins=F.lit(minutes))))
    return old.where("source_url is not null").orderBy("created_at", "batch_id").limit(most)


def context_of(rows: DataFrame) -> dict[str, Column]:
    """The fields that a template may name, from a lead's own columns, else its organization's (org_ columns); blanks are empty."""
    text = lambda *names: F.coalesce(*[F.when(F.coalesce(F.col(n), F.lit("")) != "", F.trim(n)) for n in names if n in rows.columns], F.lit(""))
    line = text("personalized_line", "personalization", "trigger")
    return {
        "firstName": text("first_name"), "lastName": text("last_name"), "email": text("email", "primary_email", "first_email"), "title": text("job_title", "title"), "companyName": text("company", "org_name"), "website": text("website", "org_domain"), "industry": text("industry", "org_industry"),
        "companySize": text("company_size", "org_size"), "companyPhone": text("company_phone", "org_phone"), "personLinkedinUrl": text("linkedin"), "city": text("city"), "personalization": line, "personalizedLine": line,
    }


def _supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads with a relation in some of their names, and with blanks and fields that others lack."""
    k = F.col("row_number")
    told = F.when(k % 6 == 0, F.concat("company", F.lit(" (A Division of Big "), k, F.lit(")"))).when(k % 6 == 1, F.concat("company", F.lit(" - Division of Big "), k)).when(k % 6 == 2, F.concat("company", F.lit(" [Subsidiary of Big]"))).when(k % 6 == 3, F.concat("company", F.lit(" (formerly Small)"))).when(k % 6 == 4, F.concat("company", F.lit(" (Laser Division)"))).otherwise(F.col("company"))
    return views.lead(spark, sf_dir).withColumns({"company": told, "hall": F.when(k % 2 == 0, F.concat(F.lit(" H"), k % 9)).otherwise("  "), "contact": F.when(k % 4 == 1, " Ann Lee "), "source_type": F.lit("FILE"), "source_name": F.lit("upload")})


def f08_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload(_raw(spark, sf_dir))


def f02_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("row_number", X.company_division(F.col("company")).alias("d")).select("row_number", "d.*")


def a17_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets of leads with an a in their city under the filters UNIQUE and RESOLVED_HIGH."""
    return facet_counts(search_leads(L.resolved_leads(spark, sf_dir, matched=True), "a", ("city",)), "UNIQUE", "RESOLVED_HIGH")


def a18_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten counts of each user's batch."""
    stored = spark.createDataFrame([(0, 0, 3, 0, 0), (1, 7, 0, 0, 9)], "user_id long, resolved long, unresolved long, review long, found long")
    return batch_summary(L.resolved_leads(spark, sf_dir, matched=True), stored)


def p05_lead_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads with a text in any of their columns that have an address and a phone."""
    return search_leads(L.f08_normalize(spark, sf_dir), "textile", ("company", "name", "domain", "email", "phone", "city"), ("email", "phone")).select("row_number", "company", "email")


def p05_export_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export's search: fewer columns, those with a domain."""
    return search_leads(L.f08_normalize(spark, sf_dir), "solar", ("company", "contact", "email", "domain", "city"), ("domain",)).select("row_number", "company", "domain")


def p03_same_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts and suppliers whose city has the same name in any case."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.upper("n_name").alias("named"))
    s = _supplier(spark, sf_dir).join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.lower("named").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return views.contact(spark, sf_dir).groupBy(F.lower("city").alias("k")).agg(F.count(F.lit(1)).alias("contacts")).join(s, "k").select(F.col("k").alias("city"), "contacts", "suppliers")


def o02_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page (page 0 was asked for) of the leads by city, backwards; the size asked for is held to 100."""
    return page(L.f08_normalize(spark, sf_dir), "city", True, 0, 500, 100).select("row_number", "city")


def o06_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.enrollment(spark, sf_dir).where("status in ('active', 'pending')").select("campaign_id", "id", (F.col("contact_id") * 31 % 997).alias("due"))
    return buffers(n, F.col("campaign_id") + 2, BUFFER_CAP)


def o07_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest(L.f08_normalize(spark, sf_dir), EXPORT_CAP).select("row_number", "company")


def t04_allowed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which a campaign can send through any of its mailboxes."""
    m = views.message(spark, sf_dir).select("campaign_id", F.pmod("contact_id", F.lit(views.MAILBOXES)).alias("box")).distinct()
    own = F.when(F.col("campaign_id") == 0, '["MON","tue","Saturday"]').when(F.col("campaign_id") == 1, "sun").otherwise("MON,TUE,WED,THU,FRI")
    box = F.when(F.col("box") % 2 == 0, "WED,MON,SAT").otherwise('["FRI", "TUE"]')
    return allowed_days(m, own, box)


def dt3_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 7
    stored = F.element_at(F.array(*[F.lit(x) for x in ('["Tue", "MONDAY", "tue"]', " fri , Xyz,sat", "sunday", "[mon", "", "none", '["x", 5]')]), (k + 1).cast("int"))
    return _supplier(spark, sf_dir).select("s_suppkey", F.array_join(C.normalize_days(stored), ",").alias("days"))


def m05_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds to the next send without jitter, and the bounds that jitter keeps."""
    k = F.col("s_suppkey").cast("int")
    at = lambda jitter: C.paced_delay(20 + k % 30, 1 + k % 5, k % 11, k % 60, k % 13 == 0, jitter)
    return _supplier(spark, sf_dir).select("s_suppkey", at(0.0).alias("delay"), at(-1.0).alias("least"), at(1.0).alias("most"))


def dt6_minutes_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes left in the local hour and in the sending window, by the local minute of the day."""
    clock = C.local(F.col("event_at"), F.lit(C.DEFAULT_ZONE))
    window = C.minutes_left_in_window(clock, F.when(F.col("id") % 3 != 0, F.lit("17:45")))
    return views.event(spark, sf_dir).groupBy(C.minutes_left_in_hour(clock).alias("in_hour")).agg(F.min(window).alias("least"), F.max(window).alias("most"), F.sum(window).alias("all"))


def x02_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of a campaign: those named, else its single one, else none."""
    k = F.col("s_suppkey")
    several = F.when(k % 3 == 0, F.array(k, k + 1)).when(k % 3 == 1, F.array().cast("array<bigint>"))
    single = F.when(k % 2 == 0, k * 10)
    return _supplier(spark, sf_dir).select("s_suppkey", F.array_join(lists_of(several, single).cast("array<string>"), ",").alias("lists"))


def x03_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's provenance with later entries over earlier ones."""
    k = F.col("s_suppkey")
    merged = provenance(F.create_map(F.lit("file"), F.lit("a.csv"), F.lit("row"), k.cast("string")), F.create_map(F.lit("row"), F.lit("merged"), F.lit("relation"), F.lit("DIVISION")), k % 2 == 0)
    return _supplier(spark, sf_dir).select("s_suppkey", F.explode(merged).alias("entry", "value"))


def x04_paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured responses, one for each supplier: by page, by offset, numbers as text, without parameters, and broken."""
    k = F.col("s_suppkey")
    url = F.concat(F.lit("https://api.example/list?"), F.when(k % 5 == 0, F.concat(F.lit("Page="), k % 3, F.lit("&limit=25"))).when(k % 5 == 1, F.concat(F.lit("offset="), k * 10, F.lit("&x=1"))).when(k % 5 == 2, "page=2").when(k % 5 == 3, "q=a").otherwise("p=1"))
    body = F.when(k % 5 == 0, F.concat(F.lit('{"meta": {"total": '), 100 + k, F.lit('}, "data": []}'))).when(k % 5 == 1, '{"data": {"totalPages": 7, "pageSize": 10}, "info": {"total_pages": 9}}').when(k % 5 == 2, '{"totalPages": "12"}').when(k % 5 == 3, '{"totalPages": 4}').otherwise('{"totalPages": 3')
    return paging_of(_supplier(spark, sf_dir).select(k.alias("response_id"), url.alias("url"), body.alias("body")))


def x05_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template fields of contacts that have a name or not, and their organization's values."""
    c = views.contact(spark, sf_dir).select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit(" "), "full_name")).alias("first_name"), F.lit("  ").alias("title"), F.when(F.col("id") % 3 == 0, "").otherwise(F.col("industry")).alias("industry"), F.lit("Org industry ").alias("org_industry"), "city", F.when(F.col("id") % 5 == 0, " hi ").alias("personalization"), F.lit("trigger").alias("trigger"))
    return c.select("id", F.concat_ws("|", *context_of(c).values()).alias("fields"))


def u07_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a directory run for each user: what was discovered, unique and repeated, and its outcome."""
    k = F.col("row_number")
    found = views.lead(spark, sf_dir).select(F.col("user_id").alias("run"), k.alias("position"), F.when(k % 17 == 0, "Exhibitor Directory").when(k % 19 == 0, "").otherwise(F.col("company")).alias("company"), F.lit(None).cast("string").alias("domain"), "website")
    failed = F.when(F.col("run") == 1, 2).otherwise(0)
    n = register_leads(found).groupBy("run").agg(F.count(F.lit(1)).alias("discovered"), F.count_if("kept").alias("unique"), F.count_if(~F.col("kept")).alias("duplicates"))
    return n.withColumn("outcome", F.when(F.col("unique") == 0, "FAILED").when(failed > 0, "PARTIAL").otherwise("COMPLETED"))


def j18_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second lead as a listing card, the others as the detail pages before them."""
    n = views.lead(spark, sf_dir).select("row_number", "company", "email", "phone", "city")
    key = lambda c: F.concat(F.lit("https://x.example/"), c)
    cards = n.where("row_number % 2 = 0").withColumn("detail_url", key(F.col("row_number")))
    details = n.where("row_number % 2 = 1").withColumns({"detail_url": key(F.col("row_number") - 1), "city": F.when(F.col("row_number") % 3 == 0, "  ").otherwise(F.col("city"))})
    return merge_detail(cards, details, ("company", "email", "phone", "city"))


def j19_raw_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows, some without a number, and the leads extracted from every other one or so."""
    n = views.lead(spark, sf_dir).select((F.col("row_number") - F.col("row_number") % 1).alias("position"), F.when(F.col("row_number") % 4 != 0, F.col("row_number") + 1).alias("row_number"), "company")
    extracted = n.where("position % 3 <> 1").select("position", F.when(F.col("position") % 2 == 0, F.col("position") + 5).otherwise(F.lit(0)).alias("row_number"), "company")
    return with_leads(n.select("position", "row_number"), extracted)


def d01_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, accepted and refused ones of each layer of an ingest: raw rows, normalised leads, leads that are new."""
    raw = views.lead(spark, sf_dir).withColumn("company", F.when(F.col("row_number") % 23 != 0, F.col("company")))
    bronze = raw.withColumn("parse_status", F.when(F.col("company").isNull(), "FAILED").otherwise("PARSED"))
    silver = L.normalize(bronze.where("parse_status = 'PARSED'"))
    probes, existing = silver.where("row_number % 3 = 0"), silver.where("row_number % 3 <> 0")
    gold = probes.join(L.match_existing(probes, existing).select("row_number", "status"), "row_number")
    count = lambda df, layer, good: df.agg(F.lit(layer).alias("layer"), F.count(F.lit(1)).alias("n_rows"), F.count_if(good).alias("accepted"), F.count_if(~good).alias("refused"))
    return count(bronze, "bronze", F.col("parse_status") == "PARSED").unionByName(count(silver, "silver", F.col("completeness") >= 0.3)).unionByName(count(gold, "gold", F.col("status") != "DUPLICATE"))


def j16_contact_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known contact of each imported row: by address, else by profile address, else by name and company; of several the lowest id."""
    k = F.col("s_suppkey")
    rows = _supplier(spark, sf_dir).select(
        k.alias("row_number"), F.when(k % 4 == 0, F.concat(F.lit(" CONTACT"), k % 60 * 2, F.lit("@corp"), k % 60 * 2 % 97, F.lit(".example"))).alias("email"), F.when(k % 4 < 2, F.concat(F.lit("linkedin.com/in/Person-"), k % 90, F.lit("/?utm_source=x"))).alias("profile"),
        F.concat(F.lit("customer#"), F.lpad((k % 120).cast("string"), 9, "0")).alias("full_name"), F.when(k % 3 != 0, "Automobile").otherwise("BUILDING").alias("company"),
    )
    c = views.contact(spark, sf_dir).withColumn("profile", F.when(F.col("id") % 5 == 0, F.concat(F.lit("https://LinkedIn.com/in/person-"), "id")))
    return contact_tiers(rows, c, views.contact_email(spark, sf_dir))


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("SENT", *COUNTERS.values())]), (k % (len(COUNTERS) + 1) + 1).cast("int"))
    return views.message(spark, sf_dir).select("campaign_id", (k % views.MAILBOXES).alias("mailbox"), kind.alias("outcome"))


def a29_run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).agg(*[c.alias(n) for n, c in run_metrics().items()])


def st7_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a stream's run, observed while it runs: events, clicks, the first and last time in microseconds."""
    from marlspike.operators.mail import _event_stream

    e = _event_stream(spark, sf_dir)
    clicks = F.count_if(F.lower("event_type").isin("clicked", "email.clicked"))
    us = F.unix_micros(F.col("event_at").cast("timestamp"))
    return streaming.observed(e, {"events": F.count(F.lit(1)), "clicks": clicks, "first_us": F.min(us), "last_us": F.max(us)})


def st9_stalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    states = ("QUEUED", "COMPLETED", "EXTRACTING", "RESOLVING", "FAILED")
    batches = views.message(spark, sf_dir).select(k.alias("batch_id"), F.element_at(F.array(*[F.lit(x) for x in states]), (k % 5 + 1).cast("int")).alias("status"), F.when(k % 3 != 0, F.concat(F.lit("https://x.example/"), k)).alias("source_url"), F.timestamp_seconds(F.lit(888_000_000) - k * 7 % 900).cast("timestamp_ntz").alias("created_at"))
    return stalled(batches, F.timestamp_seconds(F.lit(888_000_000)).cast("timestamp_ntz"))


def f11_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    url, other = F.concat(F.lit("https://a"), k, F.lit(".site"), k % 5, F.lit(".co.uk/x")), F.concat(F.lit("http://WWW.site"), k % 3, F.lit(".co.uk"))
    return _supplier(spark, sf_dir).select("s_suppkey", X.is_related(url, other).alias("related"))


def f12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    url = F.concat(F.when(k % 2 == 0, "HTTP://").otherwise(""), F.lit("Site"), k, F.lit(".Example/Path/"), F.when(k % 3 == 0, "?utm_source=a&x=1&REF=2#top").when(k % 3 == 1, "/#x").otherwise(""))
    return _supplier(spark, sf_dir).select("s_suppkey", X.clean_url(url).alias("url"))


def f06_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    host = F.when(k % 5 == 0, F.concat(F.lit("a-"), k, F.lit(".example"))).when(k % 5 == 1, "-a.example").when(k % 5 == 2, "a b.example").when(k % 5 == 3, "example")
    return _supplier(spark, sf_dir).select("s_suppkey", X.is_domain(host).alias("valid"))


def f15_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names from profile addresses and from mail addresses."""
    k = F.col("s_suppkey")
    profile = F.concat(F.lit("https://www.linkedin.com/in/"), F.when(k % 3 == 0, "ann-lee-b74382229").when(k % 3 == 1, "bo").otherwise("a-1"))
    mail = F.when(k % 2 == 0, F.concat(F.lit("JO.van"), F.lit("@x.example"))).otherwise(F.concat(F.lit("jo"), k, F.lit(".van@x.example")))
    return _supplier(spark, sf_dir).select("s_suppkey", T.name_from_profile(profile).alias("by_profile"), X.name_from_email(mail).alias("by_mail"))


def f16_capitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _supplier(spark, sf_dir).select("s_suppkey", X.capital_words(F.concat(F.lit("o'neil-smith 2nd LTD, élan x"), "s_suppkey", F.lit("_a b"))).alias("title"))


def f21_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of both plain forms of every page."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", F.md5(X.html_to_text(F.col("html")).cast("binary")).alias("full_text"), F.md5(X.html_to_text_plain(F.col("html")).cast("binary")).alias("short_text"))


def p19_search_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    host = F.when(k % 4 == 0, F.concat(F.lit("Shop"), k, F.lit(".Amazon.com"))).when(k % 4 == 1, "tofler.in").when(k % 4 == 2, F.concat(F.lit("own"), k, F.lit("amazon.com")))
    return _supplier(spark, sf_dir).select("s_suppkey", X.is_shared_host(host, X.SEARCH_HOSTS).alias("rejected"))


def s06_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pasted contents, tables or free text as they look, one for each supplier."""
    k = F.col("s_suppkey")
    table = F.concat(F.lit("Company,Email,Phone\nFirm "), k, F.lit(",A@x.example,\n,b@y.example,555"))
    text = F.concat(F.lit("Firm "), k, F.lit(" | call 555-123-4567\nnothing here\n\nsee www.site"), k, F.lit(".example now"))
    return S.pasted_rows(_supplier(spark, sf_dir).select(k.alias("source_id"), F.when(k % 2 == 0, table).otherwise(text).alias("content")))


def f20_wide_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of texts with characters of two UTF-16 units."""
    return _supplier(spark, sf_dir).select("s_suppkey", X.string_hash(F.concat(F.lit("a\U0001f600é"), F.col("s_suppkey") % 3)).alias("hashed"))


QUERIES = {
    f.__name__: f
    for f in (
        f08_payload, f02_division, a17_facets, a18_batch_summary, p05_lead_search, p05_export_search, p03_same_name, o02_sorted, o06_buffers, o07_export, t04_allowed_days, dt3_days, m05_delay, dt6_minutes_left, x02_lists, x03_provenance, x04_paging,
        x05_context, u07_run, j18_details, j19_raw_leads, d01_layers, j16_contact_tiers, a29_run_metrics, st7_observed, st9_stalled, f11_related, f12_urls, f06_domains, f15_names, f16_capitals, f21_texts, p19_search_hosts, s06_switch, f20_wide_hash,
    )
}

_DIVIDED = """raw AS (SELECT * REPLACE (CASE row_number % 6 WHEN 0 THEN company || ' (A Division of Big ' || row_number || ')' WHEN 1 THEN company || ' - Division of Big ' || row_number WHEN 2 THEN company || ' [Subsidiary of Big]' WHEN 3 THEN company || ' (formerly Small)' WHEN 4 THEN company || ' (Laser Division)' ELSE company END AS company), company AS base FROM lead),
divided AS (SELECT row_number, base, CASE row_number % 6 WHEN 0 THEN 'Big ' || row_number WHEN 1 THEN 'Big ' || row_number WHEN 2 THEN 'Big' WHEN 4 THEN base END AS parent, CASE row_number % 6 WHEN 2 THEN 'SUBSIDIARY' WHEN 3 THEN 'FORMER_NAME' WHEN 5 THEN NULL ELSE 'DIVISION' END AS relation FROM raw)"""
_JUDGED = L._TIERS + "," + L._RESOLVED + ", judged AS (SELECT n.*, status, resolved, source, resolution FROM n JOIN matched USING (row_number) JOIN resolutions USING (row_number))"
_COUNTED = lambda column, values, rest: ", ".join(f"count(*) FILTER (WHERE {column} = '{v}'{rest}) AS {v.lower()}" for v in values)
_STATUS, _LEVEL = ("UNIQUE", "DUPLICATE", "POSSIBLE_DUPLICATE"), ("RESOLVED_HIGH", "RESOLVED_MEDIUM", "UNRESOLVED", "REVIEW_REQUIRED")
_DELAY = lambda j: f"CASE WHEN k % 13 = 0 THEN 5 ELSE greatest(15, base + {j} * least(15, greatest(2, floor(base * 0.1)::INTEGER))) END::INTEGER"
_PLAIN = lambda x, steps: __import__("functools").reduce(lambda e, s: f"regexp_replace({e}, '{s[0]}', {s[1]}, 'g')", steps, x)
_BREAKS = [("(?i)<br[ \\t\\n\\f\\r\\v]*/?>", "chr(10)"), ("(?i)</p>", "chr(10) || chr(10)")]
_EDGES = [("^[ \\t\\n\\f\\r\\v]+|[ \\t\\n\\f\\r\\v]+$", "''")]
_FULL = [("(?is)<style[^>]*>.*?</style>", "''"), *_BREAKS, ("(?i)</li>", "chr(10)"), ("(?i)<li[^>]*>", "'• '"), ("<[^>]+>", "''"), ("(?i)&nbsp;", "' '"), ("(?i)&amp;", "'&'"), ("(?i)&lt;", "'<'"), ("(?i)&gt;", "'>'"), ("(?i)&quot;", "'\"'"), ("(?i)&#39;", "chr(39)"), ("\\n[ \\t\\n\\f\\r\\v]*\\n[ \\t\\n\\f\\r\\v]*\\n", "chr(10) || chr(10)"), *_EDGES]
_SHORT = [*_BREAKS, ("<[^>]*>?", "''"), *_EDGES]
_KINDS = "(['SENT', " + ", ".join(f"'{k}'" for k in COUNTERS.values()) + f"])[id % {len(COUNTERS) + 1} + 1]"
ORACLES = {
    "f08_payload": with_views("lead", f"""WITH {_DIVIDED}, {L._NORMAL.replace("FROM lead)", "FROM lead)")}
SELECT raw.row_number, raw.company AS raw_name, base AS company, n.name, n.domain, trim(raw.website) AS website, NULL::VARCHAR AS booth, CASE WHEN raw.row_number % 2 = 0 THEN 'H' || (raw.row_number % 9) END AS hall, NULL::VARCHAR AS category, NULL::VARCHAR AS detail_url, NULL::VARCHAR AS source_url,
  CASE WHEN raw.row_number % 4 = 1 THEN 'Ann Lee' END AS contact, NULL::VARCHAR AS title, raw.city, NULL::VARCHAR AS state, NULL::VARCHAR AS country, NULL::VARCHAR AS address, NULL::VARCHAR AS industry, NULL::VARCHAR AS company_size, NULL::VARCHAR AS linkedin, n.email, n.phone, 'FILE' AS source_type, 'upload' AS source_name,
  '{{"sourceType":"FILE"' || CASE WHEN relation IS NULL THEN '' ELSE ',"relation":"' || relation || '"' || coalesce(',"parent":"' || parent || '"', ',"parent":null') END || '}}' AS provenance,
  n.email IS NOT NULL AS has_email, n.domain IS NOT NULL AS has_domain, n.phone IS NOT NULL AS has_phone, n.completeness + CASE WHEN raw.row_number % 4 = 1 THEN 10 ELSE 0 END / 100.0::DOUBLE AS completeness FROM raw JOIN divided USING (row_number) JOIN n ON n.row_number = raw.row_number""".replace("SELECT raw.row_number, raw.company", "SELECT raw.row_number, raw.company").replace(", base AS company", ", raw.base AS company")),
    "f02_division": with_views("lead", f"WITH {_DIVIDED} SELECT * FROM divided"),
    "a17_facets": with_views("lead", f"{_JUDGED} SELECT count(*) FILTER (WHERE status = 'UNIQUE' AND resolution = 'RESOLVED_HIGH') AS total, {_COUNTED('status', _STATUS, " AND resolution = 'RESOLVED_HIGH'")}, {_COUNTED('resolution', _LEVEL, " AND status = 'UNIQUE'")} FROM judged WHERE city LIKE '%a%'"),
    "a18_batch_summary": with_views("lead", f"{_JUDGED} SELECT user_id, count(*) AS total, {_COUNTED('status', _STATUS, '')}, count(*) FILTER (WHERE email IS NULL) AS missing_email, count(*) FILTER (WHERE phone IS NULL) AS missing_phone, CASE user_id WHEN 1 THEN 7 ELSE count(*) FILTER (WHERE resolution IN ('RESOLVED_HIGH', 'RESOLVED_MEDIUM')) END AS resolved, CASE user_id WHEN 0 THEN 3 ELSE count(*) FILTER (WHERE resolution = 'UNRESOLVED') END AS unresolved, count(*) FILTER (WHERE resolution = 'REVIEW_REQUIRED') AS review, CASE user_id WHEN 1 THEN 9 ELSE count(*) FILTER (WHERE source = 'DIRECTORY') END AS found FROM judged GROUP BY 1"),
    "p05_lead_search": with_views("lead", f"WITH {L._NORMAL} SELECT row_number, company, email FROM n WHERE email IS NOT NULL AND phone IS NOT NULL AND contains(lower(concat_ws(chr(1), company, name, domain, email, phone, city)), 'textile')"),
    "p05_export_search": with_views("lead", f"WITH {L._NORMAL} SELECT row_number, company, domain FROM n WHERE domain IS NOT NULL AND contains(lower(concat_ws(chr(1), company, email, domain, city)), 'solar')"),
    "p03_same_name": with_views("contact", "SELECT lower(city) AS city, count(*) AS contacts, (SELECT count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE lower(n_name) = lower(city)) AS suppliers FROM contact WHERE lower(city) IN (SELECT lower(n_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey) GROUP BY 1, 3"),
    "o02_sorted": with_views("lead", f"WITH {L._NORMAL} SELECT row_number, city FROM n ORDER BY city DESC, row_number LIMIT 100"),
    "o06_buffers": with_views("enrollment", "SELECT campaign_id, id, contact_id * 31 % 997 AS due, row_number() OVER (PARTITION BY campaign_id ORDER BY contact_id * 31 % 997, id)::INTEGER AS place FROM enrollment WHERE status IN ('active', 'pending') QUALIFY place <= least(50, (campaign_id + 2) * 11)"),
    "o07_export": with_views("lead", f"WITH {L._NORMAL} SELECT row_number, company FROM n ORDER BY row_number DESC LIMIT 10000"),
    "t04_allowed_days": with_views("message", "SELECT campaign_id, array_to_string(list_sort(list_distinct(flatten(list(list_intersect(own, box))))), ',') AS days FROM (SELECT DISTINCT campaign_id, CASE campaign_id WHEN 0 THEN ['MON', 'TUE', 'SAT'] WHEN 1 THEN ['SUN'] ELSE ['MON', 'TUE', 'WED', 'THU', 'FRI'] END AS own, CASE WHEN contact_id % 7 % 2 = 0 THEN ['WED', 'MON', 'SAT'] ELSE ['FRI', 'TUE'] END AS box FROM message) GROUP BY 1 HAVING days <> ''"),
    "dt3_days": "SELECT s_suppkey, (['TUE,MON', 'FRI,SAT', 'SUN', '', '', '', ''])[s_suppkey % 7 + 1] AS days FROM supplier",
    "m05_delay": f"WITH b AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 11 > 0 THEN greatest(15, floor(greatest(15, s_suppkey % 60 * 60) / (s_suppkey % 11 + 1 + s_suppkey % 5))) ELSE greatest(60, s_suppkey % 60 * 60) END::INTEGER AS base FROM supplier) SELECT k AS s_suppkey, {_DELAY(0)} AS delay, {_DELAY(-1)} AS least, {_DELAY(1)} AS most FROM b",
    "dt6_minutes_left": with_views("event", "WITH c AS (SELECT id, event_at + INTERVAL 330 MINUTE AS t FROM event), m AS (SELECT greatest(1, 60 - minute(t))::INTEGER AS in_hour, greatest(0, CASE WHEN id % 3 <> 0 THEN 1065 ELSE 1170 END - hour(t) * 60 - minute(t))::INTEGER AS w FROM c) SELECT in_hour, min(w) AS least, max(w) AS most, sum(w)::BIGINT AS \"all\" FROM m GROUP BY 1"),
    "x02_lists": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey || ',' || (s_suppkey + 1) WHEN s_suppkey % 2 = 0 THEN (s_suppkey * 10)::VARCHAR ELSE '' END AS lists FROM supplier",
    "x03_provenance": "SELECT s_suppkey, unnest(CASE WHEN s_suppkey % 2 = 0 THEN ['file', 'row', 'relation'] ELSE ['file', 'row'] END) AS entry, unnest(CASE WHEN s_suppkey % 2 = 0 THEN ['a.csv', 'merged', 'DIVISION'] ELSE ['a.csv', s_suppkey::VARCHAR] END) AS value FROM supplier",
    "x04_paging": """SELECT s_suppkey AS response_id, CASE s_suppkey % 5 WHEN 0 THEN 'Page' ELSE 'offset' END AS parameter, CASE s_suppkey % 5 WHEN 0 THEN 'limit' END AS size_parameter, CASE s_suppkey % 5 WHEN 0 THEN 25 ELSE 10 END::BIGINT AS page_size, CASE s_suppkey % 5 WHEN 0 THEN CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE s_suppkey % 3 END ELSE s_suppkey + 1 END::BIGINT AS current_page,
  CASE s_suppkey % 5 WHEN 0 THEN ceil((100 + s_suppkey) / 25) ELSE 9 END::BIGINT AS total_pages, CASE s_suppkey % 5 WHEN 0 THEN 100 + s_suppkey END::BIGINT AS total_records, s_suppkey % 5 = 1 AS zero_indexed, s_suppkey % 5 = 1 AS by_offset FROM supplier WHERE s_suppkey % 5 < 2""",
    "x05_context": with_views("contact", "SELECT id, concat_ws('|', CASE WHEN id % 2 = 0 THEN full_name ELSE '' END, '', '', '', '', '', CASE WHEN id % 3 = 0 THEN 'Org industry' ELSE industry END, '', '', '', city, CASE WHEN id % 5 = 0 THEN 'hi' ELSE 'trigger' END, CASE WHEN id % 5 = 0 THEN 'hi' ELSE 'trigger' END) AS fields FROM contact"),
    "u07_run": with_views("lead", f"WITH {L._NORMAL} SELECT user_id AS run, count(*) AS discovered, count(DISTINCT coalesce(domain, name)) AS \"unique\", count(*) - count(DISTINCT coalesce(domain, name)) AS duplicates, CASE WHEN user_id = 1 THEN 'PARTIAL' ELSE 'COMPLETED' END AS outcome FROM n WHERE row_number % 17 <> 0 AND row_number % 19 <> 0 GROUP BY 1"),
    "j18_details": with_views("lead", "SELECT 'https://x.example/' || c.row_number AS detail_url, coalesce(d.company, c.company) AS company, coalesce(d.email, c.email) AS email, coalesce(d.phone, c.phone) AS phone, coalesce(CASE WHEN d.row_number % 3 <> 0 THEN d.city END, c.city) AS city FROM lead c LEFT JOIN lead d ON d.row_number = c.row_number + 1 WHERE c.row_number % 2 = 0"),
    "j19_raw_leads": with_views("lead", """WITH r AS (SELECT row_number AS p, company, CASE WHEN row_number % 4 <> 0 THEN row_number + 1 ELSE row_number + 1 END AS number FROM lead), e AS (SELECT p, company, CASE WHEN p % 2 = 0 THEN p + 5 END AS number FROM r WHERE p % 3 <> 1)
SELECT r.p AS position, r.number AS row_number, coalesce(a.company, b.company) AS company FROM r LEFT JOIN e a ON a.number = r.number LEFT JOIN e b ON b.p = r.p"""),
    "d01_layers": with_views("lead", f"{L._TIERS.replace('FROM z)', 'FROM z WHERE row_number % 23 <> 0)')} SELECT 'bronze' AS layer, count(*) AS n_rows, count(*) FILTER (WHERE row_number % 23 <> 0) AS accepted, count(*) FILTER (WHERE row_number % 23 = 0) AS refused FROM lead UNION ALL SELECT 'silver', count(*), count(*) FILTER (WHERE completeness >= 0.3), count(*) FILTER (WHERE completeness < 0.3) FROM n UNION ALL SELECT 'gold', count(*), count(*) FILTER (WHERE status <> 'DUPLICATE'), count(*) FILTER (WHERE status = 'DUPLICATE') FROM matched"),
    "j16_contact_tiers": with_views("contact contact_email", """WITH r AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 = 0 THEN 'contact' || (s_suppkey % 60 * 2) || '@corp' || (s_suppkey % 60 * 2 % 97) || '.example' END AS email, CASE WHEN s_suppkey % 4 < 2 THEN s_suppkey % 90 END AS person, 'customer#' || lpad((s_suppkey % 120)::VARCHAR, 9, '0') AS full_name, CASE WHEN s_suppkey % 3 <> 0 THEN 'automobile' ELSE 'building' END AS company FROM supplier),
t AS (SELECT k, (SELECT min(contact_id) FROM contact_email e WHERE e.normalized_email = r.email) AS a, (SELECT min(id) FROM contact c WHERE c.id = r.person AND c.id % 5 = 0) AS b, (SELECT min(id) FROM contact c WHERE lower(c.full_name) = r.full_name AND lower(c.industry) = r.company) AS c FROM r)
SELECT k AS row_number, CASE WHEN a IS NOT NULL THEN 'EXACT_EMAIL' WHEN b IS NOT NULL THEN 'EXACT_LINKEDIN' WHEN c IS NOT NULL THEN 'CONTACT_AND_ORGANIZATION' END AS reason, coalesce(a, b, c) AS contact_id FROM t"""),
    "a29_run_metrics": with_views("message", f"WITH o AS (SELECT campaign_id, id % 7 AS mailbox, {_KINDS} AS outcome FROM message) SELECT count(DISTINCT campaign_id) AS campaigns_checked, count(DISTINCT mailbox) FILTER (WHERE outcome = 'SENT') AS mailboxes_eligible, count(*) AS candidates_examined, {', '.join(f"count(*) FILTER (WHERE outcome = '{k}') AS {n}" for n, k in COUNTERS.items())}, count(*) FILTER (WHERE outcome NOT IN ('SENT', 'FAILED')) AS emails_skipped FROM o"),
    "st7_observed": with_views("event", "SELECT count(*) AS events, count(*) FILTER (WHERE lower(event_type) IN ('clicked', 'email.clicked')) AS clicks, epoch_us(min(event_at)) AS first_us, epoch_us(max(event_at)) AS last_us FROM event"),
    "st9_stalled": with_views("message", "SELECT id AS batch_id, (['QUEUED', 'COMPLETED', 'EXTRACTING', 'RESOLVING', 'FAILED'])[id % 5 + 1] AS status, 'https://x.example/' || id AS source_url, make_timestamp((888000000 - id * 7 % 900) * 1000000) AS created_at FROM message WHERE id % 5 IN (0, 2, 3) AND id % 3 <> 0 AND id * 7 % 900 > 300 ORDER BY 4, 1 LIMIT 10"),
    "f11_related": "SELECT s_suppkey, s_suppkey % 5 = s_suppkey % 3 AS related FROM supplier",
    "f12_urls": "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'http' ELSE 'https' END || '://site' || s_suppkey || '.example/Path' || CASE WHEN s_suppkey % 3 = 0 THEN '?x=1' ELSE '' END AS url FROM supplier",
    "f06_domains": "SELECT s_suppkey, s_suppkey % 5 = 0 AS valid FROM supplier",
    "f15_names": "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Ann Lee' WHEN 1 THEN 'Bo' END AS by_profile, CASE WHEN s_suppkey % 2 = 0 THEN 'Jo Van' END AS by_mail FROM supplier",
    "f16_capitals": "SELECT s_suppkey, 'O''Neil-Smith 2nd LTD, éLan X' || s_suppkey || '_a B' AS title FROM supplier",
    "f21_texts": f"SELECT page_id, md5({_PLAIN("coalesce(html, '')", _FULL)}) AS full_text, md5({_PLAIN("coalesce(html, '')", _SHORT)}) AS short_text FROM pages",
    "p19_search_hosts": "SELECT s_suppkey, s_suppkey % 4 <> 2 AS rejected FROM supplier",
    "s06_switch": """SELECT s_suppkey AS source_id, r::INTEGER AS row_number, CASE WHEN s_suppkey % 2 = 0 THEN CASE r WHEN 2 THEN 'Firm ' || s_suppkey END ELSE CASE r WHEN 1 THEN 'Firm ' || s_suppkey WHEN 3 THEN 'see www.site' || s_suppkey || '.example now' END END AS company, CASE WHEN s_suppkey % 2 = 0 THEN CASE r WHEN 2 THEN 'A@x.example' ELSE 'b@y.example' END END AS email,
  CASE WHEN s_suppkey % 2 = 0 THEN CASE r WHEN 3 THEN '555' END ELSE CASE r WHEN 1 THEN '555-123-4567' END END AS phone, CASE WHEN s_suppkey % 2 = 1 AND r = 3 THEN 'www.site' || s_suppkey || '.example' END AS website, CASE WHEN s_suppkey % 2 = 1 AND r = 2 THEN 'FAILED' ELSE 'PARSED' END AS parse_status
  FROM supplier, (SELECT unnest([1, 2, 3]) AS r) WHERE s_suppkey % 2 = 1 OR r > 1""",
    # "a", two units, "é" (233), a digit
    "f20_wide_hash": "SELECT s_suppkey, (CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END)::INTEGER AS hashed FROM (SELECT s_suppkey, list_reduce([0::BIGINT, 97, 55357, 56832, 233, 48 + s_suppkey % 3], lambda h, c: (h * 31 + c) % 4294967296) AS h FROM supplier)",
}
