"""Queries over uploads, pages, templates and exports, and the small rules around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlspike import views
from marlspike.functions import pages as G
from marlspike.functions import templates as T
from marlspike.functions import text as X
from marlspike.operators import analytics, leads
from marlspike.operators.audience import primary_email
from marlspike.sources import exports as E
from marlspike.sources import files as S
from marlspike.views import with_views


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small table for each supplier, with one of three delimiters."""
    k = F.col("s_suppkey")
    mark = F.when(k % 3 == 0, ";").when(k % 3 == 1, "\t").otherwise(",")
    lines = [
        F.concat_ws("|", F.lit("Organization"), F.lit("Contact Person"), F.lit("Designation"), F.lit("Work Email"), F.lit("Telephone"), F.lit("HQ City"), F.lit("Website"), F.lit("Notes")),
        F.concat_ws("|", F.concat(F.lit('"'), "s_name", F.lit(' ""A"",\nB; C"')), F.lit(" Ann "), F.lit("Head"), F.concat(F.lit("a"), k, F.lit("@x.example")), F.lit(""), F.lit("Oslo"), F.lit(""), F.lit("n")),
        F.lit(""),
        F.concat_ws("|", F.lit(""), F.lit("Bo"), F.lit(""), F.lit(""), F.lit(""), F.lit(""), F.concat(F.lit("https://www.site"), k, F.lit(".example/x"))),
        F.concat_ws("|", F.lit(""), F.lit("Nobody"), F.lit(""), F.lit(""), F.lit(""), F.lit("Rome"), F.lit(""), F.lit("x"), F.lit("ragged")),
    ]
    return _table(spark, sf_dir, "supplier").select(k.alias("source_id"), F.replace(F.concat_ws("\n", *lines), F.lit("|"), mark).alias("content"))


def s03_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table_rows(_uploads(spark, sf_dir)).select("source_id", "row_number", "company", "contact", "title", "email", "phone", "city", "website", "parse_status")


def s06_pasted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document taken as pasted free text: its lines as leads."""
    return S.text_rows(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.col("text").alias("content")))


def s08_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of three forms, one for each supplier, with two good records and one that isn't a company."""
    k = F.col("s_suppkey")
    record = lambda name, *rest: F.to_json(F.struct(F.col("s_name").alias(name), *rest))
    one, two, three = record("companyName", F.lit("A@X.example").alias("email"), F.lit("H1").alias("hall"), k.cast("string").alias("stand")), record("name", F.lit("Oslo").alias("city")), F.lit('{"companyName": "Exhibitor Directory"}')
    array = F.concat(F.lit("["), F.concat_ws(",", one, two, three), F.lit("]"))
    content = F.when(k % 3 == 0, array).when(k % 3 == 1, F.concat(F.lit('{"results": '), array, F.lit("}"))).otherwise(F.concat(F.lit('{"data": {"payload": {"rows": '), array, F.lit("}}}")))
    sources = _table(spark, sf_dir, "supplier").select(k.alias("source_id"), content.alias("content"))
    return S.record_leads(S.json_records(sources)).select("source_id", "row_number", "company", "email", "city", "hall", "stall", "address")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", "url", "html")


def u01_page_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.classify(_pages(spark, sf_dir))


def u02_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.entries(_pages(spark, sf_dir))


def u05_page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.facts(_pages(spark, sf_dir))


def u06_research(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.research(_pages(spark, sf_dir))


def u09_site_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lead for each page: the title up to the first separator, else its domain; first address and phone."""
    f = G.facts(_pages(spark, sf_dir), X.phone(F.get(G.phones(F.coalesce("html", F.lit(""))), F.lit(0))).alias("phone"))
    name = F.nullif(F.trim(F.split("title", r" - | \| |: ")[0]), F.lit(""))
    first = lambda c: F.nullif(F.split(c, " ")[0], F.lit(""))
    return f.select("page_id", F.coalesce(name, X.domain(F.col("url"))).alias("company"), X.domain(F.col("url")).alias("domain"), first("emails").alias("email"), "phone")


def s11_engagement_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each enrollment."""
    rows = analytics.a06_contact_engagement(spark, sf_dir)
    people = views.contact(spark, sf_dir).select(F.col("id").alias("contact_id"), "full_name", "industry")
    mails = primary_email(views.contact_email(spark, sf_dir)).select("contact_id", "email")
    c = rows.join(people, "contact_id", "left").join(mails, "contact_id", "left")
    yes = lambda n: F.when(F.col(n) > 0, "YES").otherwise("NO")
    cells: dict[str, Column] = {
        "Contact Name": F.col("full_name"), "Email": F.col("email"), "Company": F.col("industry"), "Campaign": F.concat(F.lit("Campaign "), "campaign_id"), "Sequence Step": F.concat(F.lit("Step "), "current_step"),
        "Sent At": E.iso(F.col("last_sent_at")), "Delivered At": E.iso(F.col("last_sent_at")), "Last Activity At": E.iso(F.col("last_activity_at")),
        "Bounce Status": F.when(F.col("engagement_status") == "BOUNCED", "BOUNCED").otherwise("NONE"), "Unsubscribe Status": F.when(F.col("engagement_status") == "UNSUBSCRIBED", "UNSUBSCRIBED").otherwise("ACTIVE"),
    }
    for kind, flag, count, stem in (("opened", "Unique Opened", "Open Count", "Opened"), ("clicked", "Unique Clicked", "Click Count", "Clicked"), ("replied", "Replied", "Reply Count", "Replied")):
        cells |= {flag: yes(f"{kind}_count"), count: F.col(f"{kind}_count"), f"First {stem} At": E.iso(F.col(f"first_{kind}_at")), f"Last {stem} At": E.iso(F.col(f"last_{kind}_at"))}
    return c.select("id", E.line(E.ENGAGEMENT, cells).alias("line"))


def s12_company_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = leads.resolved_leads(spark, sf_dir)
    cells = {"Company Name": F.col("company"), "Normalized Company Name": F.col("name"), "Domain": F.col("resolved"), "Resolution Status": F.col("resolution"), "Resolution Source": F.col("source")}
    return n.select("row_number", E.line(E.COMPANIES, cells).alias("line"))


def s13_leads_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = leads.f08_normalize(spark, sf_dir)
    cells = {"ID": F.col("row_number"), "Company Name": F.col("company"), "Normalized Name": F.col("name"), "Domain": F.col("domain"), "Email": F.col("email"), "Phone": F.col("phone"), "City": F.col("city"), "Completeness Score": E.percent(F.col("completeness"))}
    return n.select("row_number", E.line(E.LEADS, cells).alias("line"))


def s14_batch_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = _table(spark, sf_dir, "supplier").select(k, "s_name", F.concat(F.lit("Ann van "), k).alias("contact"), F.concat(F.lit("Hall: "), k % 7, F.lit(", Stand #"), k).alias("address"))
    cells = E.batch_values(F.col("contact"), F.col("address")) | {"Company Name": F.col("s_name"), "Event Type": F.lit("Trade Fair / Expo Directory"), "Data Completeness": F.lit("0%"), "Email Format Status": F.lit("Missing"), "Source Row": k}
    return rows.select("s_suppkey", E.line(E.BATCH, cells).alias("line"))


def s15_contacts_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    mails = primary_email(views.contact_email(spark, sf_dir)).select(F.col("contact_id").alias("id"), "email")
    c = views.contact(spark, sf_dir).join(mails, "id", "left")
    cells = {"Full Name": F.col("full_name"), "Email": F.col("email"), "Industry": F.col("industry"), "City": F.col("city"), "Status": F.lit("Cold")}
    return c.select("id", E.line(E.CONTACTS, cells, quote_all=True).alias("line"))


def p17_bots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by whether their made-up reader is automatic."""
    agents = ("Mozilla/5.0", "Googlebot/2.1", "curl/8", "Safari", "HeadlessChrome")
    agent = F.element_at(F.array(*[F.lit(a) for a in agents]), (F.col("id") % len(agents) + 1).cast("int"))
    purpose = F.when(F.col("id") % 7 == 0, "Prefetch")
    return views.event(spark, sf_dir).groupBy(X.is_bot(agent, purpose).alias("bot")).agg(F.count(F.lit(1)).alias("events"))


def p18_ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up addresses of customers by first number, restricted or not."""
    k = F.col("c_custkey")
    ip = F.concat_ws(".", k % 224, k * 7 % 256, k * 3 % 256, F.lit(9))
    return _table(spark, sf_dir, "customer").select((k % 224).alias("first"), X.is_restricted_ip(ip).alias("restricted")).groupBy("first").agg(F.count_if("restricted").alias("restricted"), F.count(F.lit(1)).alias("addresses"))


def p19_shared_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    host = F.when(k % 4 == 0, F.concat(F.lit("Shop"), k, F.lit(".facebook.com"))).when(k % 4 == 1, "x.com").when(k % 4 == 2, F.concat(F.lit("netflix"), k, F.lit("x.com")))
    return _table(spark, sf_dir, "supplier").select("s_suppkey", X.is_shared_host(host).alias("shared"))


def p22_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns through the gate for generated texts."""
    t = _table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return t.groupBy(F.coalesce(T.quality(F.col("text")), F.lit("OK")).alias("outcome")).agg(F.count(F.lit(1)).alias("texts"))


TEMPLATE = "Hi {{#if firstName}}{{ firstName }}{{else}}there{{/if}},{{#if city}} in <b>{{<i>city</i>}}</b>{{#if industry}} ({{industry}}){{/if}}{{/if}}&nbsp;- {{missing}}bye"


def x06_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.contact(spark, sf_dir)
    name = F.when(F.col("id") % 3 != 0, F.col("full_name"))
    industry = F.when(F.col("id") % 2 == 0, F.col("industry"))
    return c.select("id", T.render(F.lit(TEMPLATE), {"firstName": name, "city": F.col("city"), "industry": industry}).alias("rendered"))


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up sequence steps, one for each supplier."""
    k = F.col("s_suppkey")
    subject = F.when(k % 3 != 0, F.concat(F.lit("About {{companyName}} "), k)).otherwise("  ")
    body = F.when(k % 5 == 0, "").when(k % 5 == 1, "Hi {{firstName}} {{nickname}} {{nickname}} {{Zip}}").when(k % 5 == 2, "{{#if city}}Hi{{#if title}} x").otherwise("Hi {{firstName}}, {{unsubscribeLink}}")
    return _table(spark, sf_dir, "supplier").select(k.alias("id"), (k % 3).cast("int").alias("step"), subject.alias("subject"), body.alias("body"))


def a21_template_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _steps(spark, sf_dir).select("id", T.audit(F.col("step"), F.col("subject"), F.col("body")).alias("a"))
    return found.select("id", F.array_join("a.errors", ",").alias("errors"), F.array_join("a.warnings", ",").alias("warnings"))


def x07_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir).select("id", T.balance(F.col("body")).alias("balanced"))


def a16_ai_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successful model calls of each user on one local day (made-up times, half an hour a turn), and what is left of 50."""
    t = views.inbound(spark, sf_dir).where("direction = 'OUTBOUND'").select((F.col("conv_id") % 5).alias("user_id"), F.floor(F.col("received_s") * 60 / 86_400).alias("day"), (F.col("conv_id") % 7 != 0).alias("ok"))
    return t.where("day = 2").groupBy("user_id").agg(F.count_if("ok").alias("used")).withColumn("remaining", F.greatest(F.lit(0), 50 - F.col("used")))


def mailbox_refs(campaigns: DataFrame, mailboxes: DataFrame) -> DataFrame:
    """campaign_id, position, mailbox_id: mailboxes that a campaign names by id or by address, each once, at the place of its id, else of its address.

    Two equi-joins instead of one with OR. campaigns: campaign_id, refs (ordered array). mailboxes: mailbox_id (text), email.
    """
    refs = campaigns.select("campaign_id", F.posexplode("refs").alias("position", "ref"))
    met = lambda name, by_id, by_mail: refs.join(mailboxes.select("mailbox_id", F.col(name).alias("ref")), "ref").select("campaign_id", "mailbox_id", by_id.alias("by_id"), by_mail.alias("by_mail"))
    place, none = F.col("position"), F.lit(None).cast("int")
    both = met("mailbox_id", place, none).unionByName(met("email", none, place))
    return both.groupBy("campaign_id", "mailbox_id").agg(F.coalesce(F.min("by_id"), F.min("by_mail")).alias("position"))


def _boxes(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    return spark.range(views.MAILBOXES).select(F.concat(F.lit("box-"), i).alias("mailbox_id"), F.concat(F.lit("mailbox"), i, F.lit("@sender.example")).alias("email"), (10 + i * 5).alias("hourly"), (100 + i * 50).alias("daily"), (i * 40).alias("sent_today"), (i != 3).alias("connected"))


def _campaign_refs(spark: SparkSession) -> DataFrame:
    k = F.col("id")
    mail = lambda i: F.concat(F.lit("mailbox"), i % views.MAILBOXES, F.lit("@sender.example"))
    box = lambda i: F.concat(F.lit("box-"), i % views.MAILBOXES)
    return spark.range(5).select(k.alias("campaign_id"), F.array(mail(k), box(k + 2), box(k), F.lit("gone")).alias("refs"), (20 + k * 10).alias("hourly_limit"))


def j09_mailbox_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The connected mailboxes that each customer's orders name, by id or address, in the order in which they are named first."""
    k, n = F.col("o_orderkey"), F.col("o_orderkey") * 7 % 40
    ref = F.when(k % 3 == 0, F.concat(F.lit("box-"), n)).otherwise(F.concat(F.lit("mailbox"), n, F.lit("@sender.example")))
    campaigns = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("campaign_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), ref.alias("ref")))), lambda x: x["ref"]).alias("refs"))
    s = F.col("s_suppkey")
    boxes = _table(spark, sf_dir, "supplier").where("s_suppkey % 5 <> 0").select(F.concat(F.lit("box-"), s).alias("mailbox_id"), F.concat(F.lit("mailbox"), s, F.lit("@sender.example")).alias("email"))
    place = F.row_number().over(Window.partitionBy("campaign_id").orderBy("position", "mailbox_id"))
    return mailbox_refs(campaigns, boxes).withColumn("n", place)


def a20_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per campaign: limits of its mailboxes together, what is left today, the rate an hour, hours for its active enrollments, whether all are connected."""
    used = mailbox_refs(_campaign_refs(spark), _boxes(spark)).join(_boxes(spark), "mailbox_id")
    pool = used.groupBy("campaign_id").agg(F.sum("hourly").alias("pool_hourly"), F.sum("daily").alias("pool_daily"), F.sum("sent_today").alias("sent_today"), F.bool_and("connected").alias("all_connected"))
    n = views.enrollment(spark, sf_dir).where("status = 'active'").groupBy("campaign_id").agg(F.count(F.lit(1)).alias("eligible"))
    rate = F.least(F.col("hourly_limit"), F.coalesce(F.nullif("pool_hourly", F.lit(0)), F.lit(1)))
    joined = pool.join(_campaign_refs(spark), "campaign_id").join(n, "campaign_id", "left").na.fill(0, ["eligible"]).withColumn("rate", rate)
    return joined.select("campaign_id", "pool_hourly", "pool_daily", F.greatest(F.lit(0), F.col("pool_daily") - F.col("sent_today")).alias("remaining"), "rate", F.round(F.col("eligible") / F.nullif("rate", F.lit(0)), 1).alias("hours"), "all_connected")


def j17_import_orgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The organization of each imported row: by its domain, else by its exact name."""
    k = F.col("s_suppkey")
    own = F.when(k % 2 == 0, F.concat(F.lit("https://www.Org"), k % 30, F.lit(".example/x")))
    mail = F.concat(F.lit("a@"), F.when(k % 3 == 0, "gmail.com").otherwise(F.concat(F.lit("org"), k % 50, F.lit(".example"))))
    rows = _table(spark, sf_dir, "supplier").select(k.alias("row_number"), T.import_domain(own, mail).alias("domain"), F.concat(F.lit("Org "), k % 60).alias("name"))
    orgs = spark.range(40).select(F.col("id").alias("org_id"), F.concat(F.lit("org"), "id", F.lit(".example")).alias("domain"), F.concat(F.lit("Org "), "id").alias("name"))
    by_domain, by_name = orgs.groupBy("domain").agg(F.min("org_id").alias("by_domain")), orgs.groupBy("name").agg(F.min("org_id").alias("by_name"))
    return rows.join(by_domain, "domain", "left").join(by_name, "name", "left").select("row_number", "domain", F.coalesce("by_domain", "by_name").alias("org_id"))


def f13_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phone number of each line of each document, where there is one."""
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(S.lines_of(F.col("text"))).alias("place", "text"))
    return lines.select("doc_id", "place", T.phone_of_line(F.col("text")).alias("phone")).where("phone is not null")


QUERIES = {
    f.__name__: f
    for f in (
        s03_csv, s06_pasted, s08_json, u01_page_class, u02_entries, u05_page_facts, u06_research, u09_site_lead, s11_engagement_csv, s12_company_csv, s13_leads_csv, s14_batch_csv, s15_contacts_csv, p17_bots,
        p18_ips, p19_shared_hosts, p22_quality, x06_render, a21_template_audit, x07_balance, a16_ai_quota, j09_mailbox_refs, a20_pool, j17_import_orgs, f13_phones,
    )
}

_STEPS = """steps AS (SELECT s_suppkey AS id, s_suppkey % 3 AS step, CASE WHEN s_suppkey % 3 <> 0 THEN 'About {{companyName}} ' || s_suppkey ELSE '' END AS subject, s_suppkey % 5 AS b FROM supplier)"""
_ISO = lambda c: f"coalesce(strftime({c}, '%Y-%m-%dT%H:%M:%S.') || lpad((millisecond({c}) % 1000)::VARCHAR, 3, '0') || 'Z', '')"
_BOXES = "boxes AS (SELECT i, 'box-' || i AS mailbox_id, 10 + i * 5 AS hourly, 100 + i * 50 AS daily, i * 40 AS sent_today, i <> 3 AS connected FROM (SELECT unnest(range(7)) AS i)), refs AS (SELECT k AS campaign_id, i AS box, min(p) AS position FROM (SELECT unnest(range(5)) AS k) c, (SELECT unnest([0, 1, 2]) AS p) q JOIN boxes ON i = CASE p WHEN 1 THEN (k + 2) % 7 ELSE k END GROUP BY 1, 2)"
_EMAIL, _PHONE, _SITE = S.EMAIL, S.PHONE, S.SITE
_ANY = lambda values: "|".join(__import__("re").escape(v).replace("\\ ", " ").replace("\\'", "'").replace("'", "''") for v in values)
_DIGITS = lambda c: f"length(regexp_replace({c}, '[^0-9]', '', 'g'))"
_CLEAN = lambda c: f"nullif(trim(regexp_replace({c}, '[^0-9+ \\t\\n\\x0B\\f\\r().-]', '', 'g'), ' '), '')"
_BARE = lambda x: f"trim(regexp_replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'), ' ')"
_SILENT = "|".join(f"<{b}\\b[^>]*>.*?</{b}>" for b in G.SILENT)
_LED, _WITHIN = (f"nullif(regexp_extract(x, '{p}', 1), '')" for p in (T.PHONE_LED, T.PHONE_WITHIN))
_ABROAD = f"trim(nullif(regexp_extract(x, '{T.PHONE_ABROAD}', 1), ''), ' ')"
ORACLES = {
    "s03_csv": """SELECT s_suppkey AS source_id, r::INTEGER AS row_number, CASE r WHEN 2 THEN s_name || ' "A",' || chr(10) || 'B; C' WHEN 3 THEN 'site' || s_suppkey END AS company, CASE r WHEN 2 THEN 'Ann' WHEN 3 THEN 'Bo' ELSE 'Nobody' END AS contact, CASE r WHEN 2 THEN 'Head' END AS title,
  CASE r WHEN 2 THEN 'a' || s_suppkey || '@x.example' END AS email, NULL::VARCHAR AS phone, CASE r WHEN 2 THEN 'Oslo' WHEN 4 THEN 'Rome' END AS city, CASE r WHEN 3 THEN 'https://www.site' || s_suppkey || '.example/x' END AS website, CASE r WHEN 4 THEN 'FAILED' ELSE 'PARSED' END AS parse_status
  FROM supplier, (SELECT unnest([2, 3, 4]) AS r)""",
    "s06_pasted": f"""WITH l AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\r?\\n'), lambda x: trim(x, ' ') <> '') AS lines FROM documents),
r AS (SELECT doc_id AS source_id, unnest(range(1, len(lines) + 1))::INTEGER AS row_number, unnest(lines) AS line FROM l),
m AS (SELECT *, nullif(regexp_extract(line, '{_EMAIL}'), '') AS email, nullif(regexp_extract(line, '{_PHONE}'), '') AS phone, nullif(regexp_extract(line, '{_SITE}'), '') AS website, regexp_split_to_array(line, '[|\\t,-]') AS parts FROM r),
k AS (SELECT *, coalesce(email, phone, website) IS NOT NULL OR len(parts) > 1 AS known FROM m)
SELECT source_id, row_number, CASE WHEN known THEN CASE WHEN trim(parts[1], ' ') <> '' AND length(trim(parts[1], ' ')) < 80 THEN trim(parts[1], ' ') ELSE 'Company ' || row_number END END AS company, email, phone, website, CASE WHEN known THEN 'PARSED' ELSE 'FAILED' END AS parse_status FROM k""",
    "s08_json": """SELECT s_suppkey AS source_id, r::INTEGER AS row_number, s_name AS company, CASE r WHEN 1 THEN 'a@x.example' END AS email, CASE r WHEN 2 THEN 'Oslo' END AS city, CASE r WHEN 1 THEN 'H1' END AS hall, CASE r WHEN 1 THEN s_suppkey::VARCHAR END AS stall,
  CASE r WHEN 1 THEN 'H1 / ' || s_suppkey END AS address FROM supplier, (SELECT unnest([1, 2]) AS r)""",
    "s11_engagement_csv": f"""SELECT a.id, concat_ws(',', coalesce(c.full_name, ''), coalesce(p.email, ''), coalesce(c.industry, ''), 'Campaign ' || a.campaign_id, 'Step ' || a.current_step, {_ISO('a.last_sent_at')}, {_ISO('a.last_sent_at')}, {", ".join(f"CASE WHEN {k}_count > 0 THEN 'YES' ELSE 'NO' END, {k}_count, {_ISO(f'first_{k}_at')}, {_ISO(f'last_{k}_at')}" for k in ("opened", "clicked", "replied"))},
  CASE WHEN engagement_status = 'BOUNCED' THEN 'BOUNCED' ELSE 'NONE' END, CASE WHEN engagement_status = 'UNSUBSCRIBED' THEN 'UNSUBSCRIBED' ELSE 'ACTIVE' END, {_ISO('a.last_activity_at')}) AS line
FROM ({analytics.ORACLES["a06_contact_engagement"]}) a LEFT JOIN ({views.VIEWS["contact"]}) c ON c.id = a.contact_id LEFT JOIN (SELECT * FROM ({views.VIEWS["contact_email"]}) QUALIFY row_number() OVER (PARTITION BY contact_id ORDER BY is_primary DESC, id) = 1) p ON p.contact_id = a.contact_id""",
    "s12_company_csv": with_views("lead", f"WITH {leads._NORMAL}, {leads._RESOLVED}, c AS (SELECT row_number, CASE WHEN contains(company, ',') THEN '\"' || company || '\"' ELSE company END AS q, name, coalesce(resolved, '') AS d, resolution, coalesce(source, '') AS s FROM n JOIN resolutions USING (row_number)) SELECT row_number, q || ',' || name || ',,' || d || ',' || resolution || ',' || s || ',,,,,' AS line FROM c"),
    "u06_research": """WITH h AS (SELECT page_id, left(coalesce(html, ''), 50000) AS head FROM pages),
d AS (SELECT page_id, trim(replace(replace(replace(trim(coalesce(nullif(regexp_extract(head, '(?is)<meta\\s+(?:name=["'']description["'']|property=["'']og:description["''])\\s+content=["'']([^"'']+)["'']', 1), ''), nullif(regexp_extract(head, '(?is)<meta\\s+content=["'']([^"'']+)["'']\\s+(?:name=["'']description["'']|property=["'']og:description["''])', 1), '')), ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), ' ') AS s,
  trim(replace(nullif(regexp_extract(head, '(?i)<title>([^<]+)</title>', 1), ''), '&amp;', '&'), ' ') AS name, list_filter(list_transform(regexp_extract_all(head, '(?i)<h[12][^>]*>([^<]+)</h[12]>', 1), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'), ' ')), lambda x: length(x) BETWEEN 6 AND 99)[1:3] AS hs FROM h)
SELECT page_id, CASE WHEN length(s) BETWEEN 11 AND 349 THEN s END AS summary, CASE WHEN NOT regexp_matches(lower(name), 'just a moment|403') THEN name END AS site_title, array_to_string(hs, '; ') AS headings FROM d""",
    "u09_site_lead": f"""WITH b AS (SELECT page_id, url, coalesce(html, '') AS h, regexp_replace(coalesce(html, ''), '(?is){_SILENT}', ' ', 'g') AS c FROM pages),
t AS (SELECT page_id, coalesce(nullif({_BARE("regexp_extract(c, '(?is)<title\\b[^>]*>(.*?)</title>', 1)")}, ''), nullif({_BARE("regexp_extract(c, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1)")}, ''), '') AS title, nullif(regexp_extract(lower(url), '^https?://(?:www\\.)?([^/:?#]+[.][^/:?#]+)', 1), '') AS domain,
  list_filter(list_transform(regexp_extract_all(h, '{_EMAIL}'), lambda x: trim(x, ' ')), lambda x: NOT regexp_matches(x, '\\.(png|jpg|gif|svg)$'))[1] AS email, list_filter(list_transform(regexp_extract_all(h, '{_PHONE}'), lambda x: trim(x, ' ')), lambda x: length(x) BETWEEN 8 AND 20)[1] AS call FROM b),
p AS (SELECT *, CASE WHEN call LIKE '+%' THEN '+' ELSE '' END || regexp_replace(call, '[^0-9]', '', 'g') AS phone FROM t)
SELECT page_id, coalesce(nullif(trim(regexp_split_to_array(title, ' - | \\| |: ')[1], ' '), ''), domain) AS company, domain, email, CASE WHEN regexp_full_match(phone, '[+]?[0-9]{{7,15}}') THEN phone END AS phone FROM p""",
    "p22_quality": f"""WITH t AS (SELECT trim(coalesce(text, ''), ' ') AS x FROM conversations WHERE role = 'assistant'), m AS (SELECT x, lower(x) AS low, greatest(1, len(regexp_extract_all(x, '[^.!?]+[.!?]+(\\s|$)'))) AS sentences, len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '')) AS words FROM t)
SELECT CASE WHEN x = '' THEN 'EMPTY' WHEN low = 'no_useful_personalization' THEN 'NO_USEFUL_DATA' WHEN regexp_matches(low, '{_ANY(T.PLACEHOLDERS)}') THEN 'PLACEHOLDER' WHEN regexp_matches(low, '{_ANY(T.CLICHES)}') THEN 'CLICHE' WHEN regexp_matches(low, '{_ANY(T.ASSUMPTIONS)}') THEN 'ASSUMPTION'
  WHEN sentences > {T.MOST_SENTENCES} THEN 'TOO_MANY_SENTENCES' WHEN words < {T.LEAST_WORDS} THEN 'TOO_SHORT' WHEN words > {T.MOST_WORDS} THEN 'TOO_LONG' ELSE 'OK' END AS outcome, count(*) AS texts FROM m GROUP BY 1""",
    "f13_phones": f"""WITH l AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\r?\\n'), lambda x: trim(x, ' ') <> '') AS lines FROM documents), e AS (SELECT doc_id, unnest(range(len(lines)))::INTEGER AS place, trim(unnest(lines), ' ') AS x FROM l),
p AS (SELECT doc_id, place, x, {_LED} AS led, {_WITHIN} AS within, {_ABROAD} AS abroad FROM e)
SELECT doc_id, place, coalesce(CASE WHEN {_DIGITS('led')} BETWEEN 7 AND 15 THEN {_CLEAN('led')} END, CASE WHEN regexp_matches(x, '{T.PHONE_ALONE}') AND ((x LIKE '+%' AND {_DIGITS('x')} BETWEEN 8 AND 15) OR {_DIGITS('x')} BETWEEN 10 AND 13) THEN x END,
  CASE WHEN {_DIGITS('within')} BETWEEN 7 AND 15 THEN {_CLEAN('within')} END, CASE WHEN {_DIGITS('abroad')} BETWEEN 9 AND 15 THEN abroad END) AS phone FROM p WHERE phone IS NOT NULL""",
    "s13_leads_csv": with_views("lead", f"WITH {leads._NORMAL}, c AS (SELECT row_number, CASE WHEN contains(company, ',') THEN '\"' || company || '\"' ELSE company END AS q, name, coalesce(domain, '') AS d, coalesce(email, '') AS e, coalesce(phone, '') AS p, city, round(completeness * 100)::INTEGER AS s FROM n) SELECT row_number, row_number || ',' || q || ',' || name || ',' || d || ',,,,' || e || ',' || p || ',' || city || ',,,,,,,,,,' || s || '%,' AS line FROM c"),
    "s14_batch_csv": """SELECT s_suppkey, s_name || ',,Ann van ' || s_suppkey || ',Ann,van ' || s_suppkey || ',,,,,,,,,,"Hall: ' || (s_suppkey % 7) || ', Stand #' || s_suppkey || '",,,,,,,,Trade Fair / Expo Directory,' || (s_suppkey % 7) || ',' || s_suppkey || ',,,,,,,,' || s_suppkey || ',,,0%,Missing,' AS line FROM supplier""",
    "s15_contacts_csv": with_views("contact contact_email", """WITH pick AS (SELECT * FROM contact_email QUALIFY row_number() OVER (PARTITION BY contact_id ORDER BY is_primary DESC, id) = 1)
SELECT contact.id, '"","","' || full_name || '","' || coalesce(email, '') || '","","","' || industry || '","' || coalesce(city, '') || '","Cold"' AS line FROM contact LEFT JOIN pick ON pick.contact_id = contact.id"""),
    "p17_bots": with_views("event", "SELECT id % 5 IN (1, 2, 4) OR id % 7 = 0 AS bot, count(*) AS events FROM event GROUP BY 1"),
    "p18_ips": "SELECT a AS first, count(*) FILTER (WHERE a IN (0, 10, 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 100 AND b BETWEEN 64 AND 127)) AS restricted, count(*) AS addresses FROM (SELECT c_custkey % 224 AS a, c_custkey * 7 % 256 AS b FROM customer) GROUP BY 1",
    "p19_shared_hosts": "SELECT s_suppkey, s_suppkey % 4 <> 2 AS shared FROM supplier",
    "x06_render": with_views("contact", "SELECT id, 'Hi ' || CASE WHEN id % 3 <> 0 THEN full_name ELSE 'there' END || ',' || ' in <b>' || city || '</b>' || CASE WHEN id % 2 = 0 THEN ' (' || industry || ')' ELSE '' END || ' - bye' AS rendered FROM contact"),
    "a21_template_audit": f"WITH {_STEPS} SELECT id, concat_ws(',', CASE WHEN step = 1 AND subject = '' THEN 'SUBJECT_MISSING' END, CASE WHEN b = 0 THEN 'BODY_EMPTY' END) AS errors, CASE b WHEN 1 THEN 'UNSUBSCRIBE_MISSING,UNKNOWN:nickname,UNKNOWN:Zip' WHEN 3 THEN '' WHEN 4 THEN '' ELSE 'UNSUBSCRIBE_MISSING' END AS warnings FROM steps",
    "x07_balance": f"WITH {_STEPS} SELECT id, CASE b WHEN 0 THEN '' WHEN 1 THEN 'Hi {{{{firstName}}}} {{{{nickname}}}} {{{{nickname}}}} {{{{Zip}}}}' WHEN 2 THEN '{{{{#if city}}}}Hi{{{{#if title}}}} x' || chr(10) || '{{{{/if}}}}' || chr(10) || '{{{{/if}}}}' ELSE 'Hi {{{{firstName}}}}, {{{{unsubscribeLink}}}}' END AS balanced FROM steps",
    "a16_ai_quota": with_views("inbound", "SELECT conv_id % 5 AS user_id, count(*) FILTER (WHERE conv_id % 7 <> 0) AS used, greatest(0, 50 - count(*) FILTER (WHERE conv_id % 7 <> 0)) AS remaining FROM inbound WHERE direction = 'OUTBOUND' AND received_s * 60 // 86400 = 2 GROUP BY 1"),
    "j09_mailbox_refs": """WITH refs AS (SELECT o_custkey AS campaign_id, o_orderkey * 7 % 40 AS box, o_orderkey % 3 = 0 AS by_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INTEGER AS position FROM orders),
placed AS (SELECT campaign_id, 'box-' || box AS mailbox_id, coalesce(min(position) FILTER (WHERE by_id), min(position)) AS position FROM refs JOIN supplier ON s_suppkey = box AND s_suppkey % 5 <> 0 GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY position, mailbox_id)::INTEGER AS n FROM placed""",
    "a20_pool": with_views("enrollment", f"WITH {_BOXES}, p AS (SELECT campaign_id, sum(hourly)::BIGINT AS pool_hourly, sum(daily)::BIGINT AS pool_daily, sum(sent_today)::BIGINT AS s, bool_and(connected) AS all_connected FROM refs JOIN boxes ON box = i GROUP BY 1), e AS (SELECT campaign_id, count(*) AS eligible FROM enrollment WHERE status = 'active' GROUP BY 1) SELECT campaign_id, pool_hourly, pool_daily, greatest(0, pool_daily - s) AS remaining, least(20 + campaign_id * 10, pool_hourly) AS rate, round(coalesce(eligible, 0) / least(20 + campaign_id * 10, pool_hourly), 1) AS hours, all_connected FROM p LEFT JOIN e USING (campaign_id)"),
    "j17_import_orgs": "WITH r AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'org' || (s_suppkey % 30) || '.example' WHEN s_suppkey % 3 <> 0 THEN 'org' || (s_suppkey % 50) || '.example' END AS domain, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 30 WHEN s_suppkey % 3 <> 0 AND s_suppkey % 50 < 40 THEN s_suppkey % 50 WHEN s_suppkey % 60 < 40 THEN s_suppkey % 60 END AS org_id FROM supplier) SELECT k AS row_number, domain, org_id FROM r",
}
