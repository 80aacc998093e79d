"""Audience building: list unions, hygiene exclusions, insert-ignore, upsert, cascades, filters and searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlspike import views
from marlspike.views import with_views

#: Lists that the audience queries take together, their tenant, and the campaign they go to.
LISTS, TENANT, CAMPAIGN = (0, 3), 1, 2


def contains(column: Column, text: str) -> Column:
    """Case-insensitive substring; % and _ stand for themselves."""
    return F.instr(F.lower(column), text.lower()) > 0


def primary_email(emails: DataFrame) -> DataFrame:
    """The primary address of each contact, else its first (lowest id)."""
    place = F.row_number().over(Window.partitionBy("contact_id").orderBy(F.desc("is_primary"), "id"))
    return emails.withColumn("_n", place).where("_n = 1").drop("_n")


def union_lists(members: DataFrame, lists: tuple[int, ...]) -> DataFrame:
    """Contacts of any of the lists, each once."""
    return members.where(F.col("list_id").isin(*lists)).select("contact_id").distinct()


def exclusions(audience: DataFrame, contacts: DataFrame, emails: DataFrame, suppressed: DataFrame, tenant: int | None = None) -> DataFrame:
    """contact_id, normalized_email and reason of each member: the first that holds, null for those to be mailed.

    Order: missing contact, do not contact, missing or invalid address, verification, bounces (2 or more hard, else soft),
    duplicate address (an earlier eligible member has it), suppressed. A contact has one address here, so the address
    alone decides about duplicates. Suppressions of another tenant don't count.
    """
    own = suppressed if tenant is None else suppressed.where(F.col("user_id").isNull() | (F.col("user_id") == tenant))
    own = own.groupBy("normalized_email").agg(F.min("reason").alias("suppression"))
    c = contacts.select(F.col("id").alias("contact_id"), "do_not_contact")
    e = primary_email(emails).select("contact_id", "normalized_email", "is_valid", "verification", "bounce_count")
    joined = audience.join(c, "contact_id", "left").join(e, "contact_id", "left").join(own, "normalized_email", "left")
    early = (
        F.when(F.col("do_not_contact").isNull(), "missing_contact")
        .when(F.col("do_not_contact"), "do_not_contact")
        .when(F.col("normalized_email").isNull() | ~F.col("is_valid"), "invalid_email")
        .when(F.col("verification") == "invalid", "invalid_status")
        .when(F.col("bounce_count") >= 2, "hard_bounce")
        .when(F.col("bounce_count") > 0, "soft_bounce")
    )
    # only those who passed so far are ranked by address: the others, many of them without one, stay where they are
    judged = joined.withColumn("early", early)
    first = Window.partitionBy("normalized_email").orderBy("contact_id")
    passed = judged.where("early is null").withColumn("_n", F.row_number().over(first))
    rest = judged.where("early is not null").withColumn("_n", F.lit(1))
    reason = F.coalesce("early", F.when(F.col("_n") > 1, "duplicate"), F.when(F.col("suppression").isNotNull(), F.concat(F.lit("suppressed:"), "suppression")))
    return passed.unionByName(rest).select("contact_id", "normalized_email", reason.alias("reason"))


def insert_ignore(existing: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """existing and those rows of new whose key isn't there."""
    return existing.unionByName(new.join(existing.select(*keys).distinct(), list(keys), "left_anti").select(existing.columns))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key by order; of equal ones the new row."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new")))
    return both.withColumn("_n", place).where("_n = 1").drop("_n", "_new")


def cascade_delete(tombstones: DataFrame, key: str, *tables: tuple[DataFrame, str]) -> list[DataFrame]:
    """Each table without the rows whose column points to a tombstone."""
    gone = tombstones.select(F.col(key).alias("_gone")).distinct()
    return [t.join(gone, t[c] == gone["_gone"], "left_anti") for t, c in tables]


def _audience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_lists(views.list_member(spark, sf_dir), LISTS)


def t01_audience_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audience(spark, sf_dir)


def t02_audience_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members not yet enrolled in the campaign."""
    return _audience(spark, sf_dir).join(views.enrollment(spark, sf_dir).where(F.col("campaign_id") == CAMPAIGN), "contact_id", "left_anti")


def t05_reply_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct people of reply events and of replied enrollments together."""
    e = views.event(spark, sf_dir).where("event_type in ('replied', 'email.replied') and enrollment_id is not null").select("campaign_id", F.col("enrollment_id").alias("person"))
    n = views.enrollment(spark, sf_dir).where("status = 'replied'").select("campaign_id", F.col("id").alias("person"))
    return e.unionByName(n).groupBy("campaign_id").agg(F.count_distinct("person").alias("people"))


def j07_suppression_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.contact_email(spark, sf_dir).join(views.suppression(spark, sf_dir), "normalized_email", "left_anti").select("id", "normalized_email")


def j20_rule_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dynamic list: contacts whose industry contains a word and whose country doesn't start with A."""
    return views.contact(spark, sf_dir).where(contains(F.col("industry"), "auto") & ~F.col("country").startswith("A")).select("id", "industry", "country")


def p04_contact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts with a text in any of their columns or addresses."""
    text = "corp7.ex"
    hits = views.contact_email(spark, sf_dir).where(contains(F.col("email"), text)).select(F.col("contact_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    c = views.contact(spark, sf_dir).join(hits, "id", "left")
    wanted = contains(F.col("full_name"), text) | contains(F.col("city"), text) | contains(F.col("industry"), text) | F.col("_hit").isNotNull()
    return c.where(wanted).select("id", "full_name", "city")


def p09_some_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts with a suppressed address."""
    bad = views.contact_email(spark, sf_dir).join(views.suppression(spark, sf_dir), "normalized_email", "left_semi")
    return views.contact(spark, sf_dir).join(bad.select(F.col("contact_id").alias("id")), "id", "left_semi").select("id", "city")


def p10_no_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts without any address."""
    return views.contact(spark, sf_dir).join(views.contact_email(spark, sf_dir).select(F.col("contact_id").alias("id")), "id", "left_anti").select("id", "city")


def p12_is_sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that progress counts as sent: six statuses, or a send time without a failed, draft, pending or queued status."""
    status = F.lower("status")
    sent = status.isin("sent", "delivered", "opened", "clicked", "replied", "bounced") | (F.col("sent_at").isNotNull() & ~status.isin("failed", "draft", "pending", "queued"))
    return views.message(spark, sf_dir).groupBy("status").agg(F.count_if(sent).alias("counted"), F.count(F.lit(1)).alias("messages"))


def p13_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrollments that aren't leased (or whose lease ended) and are due at a given time."""
    now = F.lit(1_000_000)
    n = views.enrollment(spark, sf_dir).withColumns({"lease_ends": F.when(F.col("contact_id") % 4 == 0, 999_000 + F.col("contact_id") * 10), "next_at": F.when(F.col("contact_id") % 3 != 0, 998_000 + F.col("contact_id") * 3)})
    return n.where((F.col("lease_ends").isNull() | (F.col("lease_ends") < now)) & (F.col("next_at").isNull() | (F.col("next_at") <= now))).where("status in ('active', 'pending')").select("id", "lease_ends", "next_at")


def w03_primary_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return primary_email(views.contact_email(spark, sf_dir)).select("contact_id", "id", "normalized_email", "is_primary")


def d05_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exclusions(_audience(spark, sf_dir), views.contact(spark, sf_dir), views.contact_email(spark, sf_dir), views.suppression(spark, sf_dir), TENANT)


def a19_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many members each exclusion takes."""
    kind = F.coalesce(F.split("reason", ":")[0], F.lit("eligible"))
    return d05_exclusion(spark, sf_dir).groupBy(kind.alias("outcome")).agg(F.count(F.lit(1)).alias("members"))


def a22_personalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each list in five parts; the first that holds counts."""
    k = F.col("contact_id")
    part = F.when(k % 11 == 0, "failed").when(k % 5 == 0, "completed").when(k % 7 == 0, "processing").when(k % 3 == 0, "queued").otherwise("missing")
    return views.list_member(spark, sf_dir).groupBy("list_id").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(part == p).alias(p) for p in ("failed", "completed", "processing", "queued", "missing")])


def a23_list_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Member counts of the lists, and one row for all suppressions."""
    lists = views.list_member(spark, sf_dir).groupBy(F.concat(F.lit("list-"), "list_id").alias("name")).agg(F.count(F.lit(1)).alias("members"))
    return lists.unionByName(views.suppression(spark, sf_dir).agg(F.lit("suppression").alias("name"), F.count(F.lit(1)).alias("members")))


def bulk_import(rows: DataFrame, known: DataFrame, members: DataFrame) -> DataFrame:
    """rows (row_number, email, domain, company) with outcome and contact_id (of known contacts): invalid, duplicate (an earlier row
    has its address, or its contact is on the list, maybe by an earlier row), updated (known, put on the list) or new.

    known: normalized_email, contact_id. members: contact_id of the list that is imported to.
    """
    email = F.lower(F.trim("email"))
    valid = F.coalesce(F.contains(email, F.lit("@")) & F.contains(email, F.lit(".")) & (F.length(email) <= 254), F.lit(False))
    judged = rows.withColumns({"email": email, "_valid": valid})
    good = judged.where("_valid").withColumn("_n", F.row_number().over(Window.partitionBy("email").orderBy("row_number")))
    first = good.where("_n = 1").join(known.groupBy(F.col("normalized_email").alias("email")).agg(F.max("contact_id").alias("contact_id")), "email", "left").join(members.select("contact_id", F.lit(True).alias("_member")).distinct(), "contact_id", "left")
    # only rows of known contacts are ranked by contact
    by_contact = F.row_number().over(Window.partitionBy("contact_id").orderBy("row_number"))
    there = first.where("contact_id is not null").withColumn("outcome", F.when(F.col("_member") | (by_contact > 1), "duplicate").otherwise("updated"))
    out = there.unionByName(first.where("contact_id is null").withColumn("outcome", F.lit("new")))
    columns = ["row_number", "email", "domain", "company", "contact_id", "outcome"]
    other = good.where("_n > 1").withColumn("outcome", F.lit("duplicate")).unionByName(judged.where("not _valid").withColumn("outcome", F.lit("invalid")), allowMissingColumns=True)
    return out.select(columns).unionByName(other.withColumn("contact_id", F.lit(None).cast("long")).select(columns))


def import_writes(outcomes: DataFrame, organizations: DataFrame) -> DataFrame:
    """target, row_number, name of what an import writes: contacts with their address, list members, and organizations.

    A new row's organization is that of its domain, else that of its company's name, else a new one, which later rows of the
    same domain or name find. So only the first new row of an unknown domain (or one without a domain) can make one, and it
    does unless an earlier one made one of its company's name. organizations: domain, name.
    """
    new = outcomes.where("outcome = 'new'")
    keyed = new.where("domain is not null").withColumn("_n", F.row_number().over(Window.partitionBy("domain").orderBy("row_number"))).where("_n = 1").drop("_n")
    keyed = keyed.join(organizations.select("domain").distinct(), "domain", "left_anti").select(new.columns)
    makers = keyed.unionByName(new.where("domain is null and company is not null")).withColumn("name", F.coalesce("company", "domain"))
    makers = makers.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("row_number"))).where("_n = 1 or company is null")
    taken = organizations.select(F.col("name").alias("company")).distinct()
    made = makers.where("company is not null").join(taken, "company", "left_anti").select("row_number", "name").unionByName(makers.where("company is null").select("row_number", "name"))
    as_target = lambda df, target, name: df.select(F.lit(target).alias("target"), "row_number", F.col(name).alias("name"))
    parts = [as_target(new, "contact", "email"), as_target(new, "contact_email", "email"), as_target(outcomes.where("outcome in ('new', 'updated')"), "list_member", "email"), as_target(made, "organization", "name")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: The list that the import goes to.
IMPORT_LIST = 3


def _import_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to import: made from suppliers, some of them known, repeated or without a valid address, domain or company."""
    from marlspike.functions.templates import import_domain

    k = F.col("s_suppkey")
    owner = k % 60
    email = F.when(k % 13 == 0, "not-an-address").otherwise(F.concat(F.lit(" Contact"), owner * 3, F.lit("@corp"), (owner * 3) % 97, F.when(k % 2 == 0, ".example").otherwise(".test")))
    own = F.when(k % 5 == 0, F.concat(F.lit("https://www.Org"), k % 8, F.lit(".example/x")))
    company = F.when(k % 3 != 0, F.concat(F.lit("Firm "), k % 11))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.alias("row_number"), email.alias("email"), import_domain(own, F.lower(F.trim(email))).alias("domain"), company.alias("company"))


def d13_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each imported row's outcome."""
    members = views.list_member(spark, sf_dir).where(F.col("list_id") == IMPORT_LIST)
    return bulk_import(_import_rows(spark, sf_dir), views.contact_email(spark, sf_dir), members)


def d13_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    organizations = spark.range(12).select(F.concat(F.lit("corp"), F.col("id") * 6, F.lit(".test")).alias("domain"), F.concat(F.lit("Firm "), F.col("id") * 4).alias("name"))
    return import_writes(d13_import(spark, sf_dir), organizations)


def a24_import_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d13_import(spark, sf_dir).groupBy("outcome").agg(F.count(F.lit(1)).alias("n_rows"))


def s17_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrollments of the campaign after the audience has been added."""
    old = views.enrollment(spark, sf_dir).where(F.col("campaign_id") == CAMPAIGN).select("campaign_id", "contact_id", "status")
    new = _audience(spark, sf_dir).select(F.lit(CAMPAIGN).cast("long").alias("campaign_id"), "contact_id", F.lit("pending").alias("status"))
    return insert_ignore(old, new, "campaign_id", "contact_id")


def s18_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppressions after bounced and complaining addresses are entered, the later entry winning."""
    old = views.suppression(spark, sf_dir).select("normalized_email", "reason", F.lit(1).alias("at"))
    new = views.contact_email(spark, sf_dir).where("bounce_count > 0").groupBy("normalized_email").agg(F.lit("hard_bounce").alias("reason"), F.max("bounce_count").alias("at"))
    return upsert(old, new, ["normalized_email"], "at")


def s19_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that stay in each table when every seventh contact is deleted."""
    contacts = views.contact(spark, sf_dir)
    tables = {"contact": (contacts, "id"), "contact_email": (views.contact_email(spark, sf_dir), "contact_id"), "list_member": (views.list_member(spark, sf_dir), "contact_id"), "enrollment": (views.enrollment(spark, sf_dir), "contact_id"), "message": (views.message(spark, sf_dir), "contact_id"), "event": (views.event(spark, sf_dir), "contact_id")}
    left = cascade_delete(contacts.where("id % 7 = 0"), "id", *tables.values())
    out = None
    for name, t in zip(tables, left, strict=True):
        part = t.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"))
        out = part if out is None else out.unionByName(part)
    return out


def s20_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list's copy under a new id and name, with its members."""
    return views.list_member(spark, sf_dir).where("list_id = 3").select((F.col("list_id") + 100).alias("list_id"), F.concat(F.lit("list-"), "list_id", F.lit(" (Copy)")).alias("name"), "contact_id")


def f25_suppression_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pasted addresses, split at line ends, commas and semicolons: trimmed, lower, over 3 characters, an @ not at either end."""
    pasted = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.concat(F.lit(" A"), "s_suppkey", F.lit("@X.example;"), F.col("s_suppkey") % 10, F.lit("@Y.example,@bad,worse@\n a@b ,Z"), F.col("s_suppkey") % 3, F.lit("@q.example")).alias("pasted"))
    each = pasted.select("s_suppkey", F.explode(F.split("pasted", "[\\n,;]")).alias("x")).select("s_suppkey", F.lower(F.trim("x")).alias("email"))
    return each.where(F.length("email") > 3).where("instr(email, '@') > 1 and not endswith(email, '@')").distinct()


def o01_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 3 of the contacts by city, 50 a page (100 at most), with the id as tiebreak."""
    size = min(50, 100)
    return views.contact(spark, sf_dir).orderBy("city", "id").offset(2 * size).limit(size).select("id", "city")


def o04_upcoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five enrollments due next."""
    n = views.enrollment(spark, sf_dir).where("status = 'active'").withColumn("next_at", F.pmod(F.col("contact_id") * 7919 + F.col("campaign_id"), F.lit(100_003)))
    return n.orderBy("next_at", "id").limit(5).select("id", "next_at")


QUERIES = {f.__name__: f for f in (t01_audience_union, t02_audience_diff, t05_reply_union, j07_suppression_anti, j20_rule_members, p04_contact_search, p09_some_child, p10_no_child, p12_is_sent, p13_due, w03_primary_pick, d05_exclusion, a19_preflight, a22_personalization, a23_list_cards, d13_import, d13_writes, a24_import_stats, s17_insert_ignore, s18_upsert, s19_cascade, s20_copy, f25_suppression_input, o01_page, o04_upcoming)}

_PRIMARY = "pick AS (SELECT * FROM contact_email QUALIFY row_number() OVER (PARTITION BY contact_id ORDER BY is_primary DESC, id) = 1)"
_AUDIENCE = "audience AS (SELECT DISTINCT contact_id FROM list_member WHERE list_id IN (0, 3))"
_EXCLUDED = f"""WITH {_PRIMARY}, {_AUDIENCE},
own AS (SELECT normalized_email, min(reason) AS suppression FROM suppression WHERE user_id IS NULL OR user_id = {TENANT} GROUP BY 1),
j AS (SELECT a.contact_id, p.normalized_email, suppression, CASE WHEN do_not_contact IS NULL THEN 'missing_contact' WHEN do_not_contact THEN 'do_not_contact' WHEN p.normalized_email IS NULL OR NOT is_valid THEN 'invalid_email'
  WHEN verification = 'invalid' THEN 'invalid_status' WHEN bounce_count >= 2 THEN 'hard_bounce' WHEN bounce_count > 0 THEN 'soft_bounce' END AS early
  FROM audience a LEFT JOIN contact c ON c.id = a.contact_id LEFT JOIN pick p ON p.contact_id = a.contact_id LEFT JOIN own ON own.normalized_email = p.normalized_email),
excluded AS (SELECT contact_id, normalized_email, coalesce(early, CASE WHEN EXISTS (SELECT 1 FROM j k WHERE k.early IS NULL AND k.normalized_email = j.normalized_email AND k.contact_id < j.contact_id) THEN 'duplicate' END, 'suppressed:' || suppression) AS reason FROM j)"""
_IMPORT = """WITH i AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 13 = 0 THEN 'not-an-address' ELSE 'contact' || (s_suppkey % 60 * 3) || '@corp' || ((s_suppkey % 60 * 3) % 97) || CASE WHEN s_suppkey % 2 = 0 THEN '.example' ELSE '.test' END END AS email,
  CASE WHEN s_suppkey % 5 = 0 THEN 'org' || (s_suppkey % 8) || '.example' WHEN s_suppkey % 13 <> 0 THEN 'corp' || ((s_suppkey % 60 * 3) % 97) || CASE WHEN s_suppkey % 2 = 0 THEN '.example' ELSE '.test' END END AS domain, CASE WHEN s_suppkey % 3 <> 0 THEN 'Firm ' || (s_suppkey % 11) END AS company FROM supplier),
f AS (SELECT *, email NOT LIKE '%@%.%' AS bad, row_number() OVER (PARTITION BY email ORDER BY k) AS n, (SELECT max(contact_id) FROM contact_email e WHERE e.normalized_email = i.email) AS found FROM i),
g AS (SELECT *, row_number() OVER (PARTITION BY found ORDER BY k) AS m, found IN (SELECT contact_id FROM list_member WHERE list_id = 3) AS member FROM f WHERE NOT bad AND n = 1),
outcomes AS (SELECT f.k AS row_number, f.email, f.domain, f.company, g.found AS contact_id, CASE WHEN f.bad THEN 'invalid' WHEN g.k IS NULL THEN 'duplicate' WHEN g.found IS NULL THEN 'new' WHEN g.member OR g.m > 1 THEN 'duplicate' ELSE 'updated' END AS outcome FROM f LEFT JOIN g ON g.k = f.k)"""
_TEXT = "corp7.ex"
ORACLES = {
    "t01_audience_union": with_views("list_member", "SELECT DISTINCT contact_id FROM list_member WHERE list_id = 0 OR list_id = 3"),
    "t02_audience_diff": with_views("list_member enrollment", "SELECT contact_id FROM list_member WHERE list_id IN (0, 3) EXCEPT SELECT contact_id FROM enrollment WHERE campaign_id = 2"),
    "t05_reply_union": with_views("event enrollment", "SELECT campaign_id, count(*) AS people FROM (SELECT campaign_id, enrollment_id FROM event WHERE event_type IN ('replied', 'email.replied') AND enrollment_id IS NOT NULL UNION SELECT campaign_id, id FROM enrollment WHERE status = 'replied') GROUP BY 1"),
    "j07_suppression_anti": with_views("contact_email suppression", "SELECT id, normalized_email FROM contact_email WHERE normalized_email NOT IN (SELECT normalized_email FROM suppression)"),
    "j20_rule_members": with_views("contact", "SELECT id, industry, country FROM contact WHERE industry ILIKE '%auto%' AND left(country, 1) <> 'A'"),
    "p04_contact_search": with_views("contact contact_email", f"SELECT id, full_name, city FROM contact c WHERE contains(lower(full_name || chr(1) || city || chr(1) || industry), '{_TEXT}') OR EXISTS (SELECT 1 FROM contact_email e WHERE e.contact_id = c.id AND contains(lower(email), '{_TEXT}'))"),
    "p09_some_child": with_views("contact contact_email suppression", "SELECT id, city FROM contact WHERE id IN (SELECT contact_id FROM contact_email JOIN suppression USING (normalized_email))"),
    "p10_no_child": with_views("contact contact_email", "SELECT id, city FROM contact WHERE id NOT IN (SELECT contact_id FROM contact_email)"),
    "p12_is_sent": with_views("message", "SELECT status, count(*) FILTER (WHERE status IN ('sent', 'delivered', 'opened', 'clicked', 'replied', 'bounced') OR (sent_at IS NOT NULL AND status NOT IN ('failed', 'draft', 'pending', 'queued'))) AS counted, count(*) AS messages FROM message GROUP BY 1"),
    "p13_due": with_views("enrollment", "SELECT * FROM (SELECT id, status, CASE WHEN contact_id % 4 = 0 THEN 999000 + contact_id * 10 END AS lease_ends, CASE WHEN contact_id % 3 <> 0 THEN 998000 + contact_id * 3 END AS next_at FROM enrollment) WHERE coalesce(lease_ends, 0) < 1000000 AND coalesce(next_at, 0) <= 1000000 AND status IN ('active', 'pending')").replace("SELECT * FROM (SELECT id, status,", "SELECT id, lease_ends, next_at FROM (SELECT id, status,"),
    "w03_primary_pick": with_views("contact_email", f"WITH {_PRIMARY} SELECT contact_id, id, normalized_email, is_primary FROM pick"),
    "d05_exclusion": with_views("contact contact_email suppression list_member", _EXCLUDED + " SELECT * FROM excluded"),
    "a19_preflight": with_views("contact contact_email suppression list_member", _EXCLUDED + " SELECT coalesce(split_part(reason, ':', 1), 'eligible') AS outcome, count(*) AS members FROM excluded GROUP BY 1"),
    "a22_personalization": with_views("list_member", "SELECT list_id, count(*) AS total, count(*) FILTER (WHERE p = 'failed') AS failed, count(*) FILTER (WHERE p = 'completed') AS completed, count(*) FILTER (WHERE p = 'processing') AS processing, count(*) FILTER (WHERE p = 'queued') AS queued, count(*) FILTER (WHERE p = 'missing') AS missing FROM (SELECT list_id, CASE WHEN contact_id % 11 = 0 THEN 'failed' WHEN contact_id % 5 = 0 THEN 'completed' WHEN contact_id % 7 = 0 THEN 'processing' WHEN contact_id % 3 = 0 THEN 'queued' ELSE 'missing' END AS p FROM list_member) GROUP BY 1"),
    "a23_list_cards": with_views("list_member suppression", "SELECT 'list-' || list_id AS name, count(*) AS members FROM list_member GROUP BY 1 UNION ALL SELECT 'suppression', count(*) FROM suppression"),
    "d13_import": with_views("contact_email list_member", _IMPORT + " SELECT * FROM outcomes"),
    "d13_writes": with_views("contact_email list_member", _IMPORT + """, orgs AS (SELECT 'corp' || (i * 6) || '.test' AS domain, 'Firm ' || (i * 4) AS name FROM (SELECT unnest(range(12)) AS i)),
c AS (SELECT *, coalesce(company, domain) AS name FROM outcomes o WHERE outcome = 'new' AND CASE WHEN domain IS NULL THEN company IS NOT NULL ELSE domain NOT IN (SELECT domain FROM orgs) AND NOT EXISTS (SELECT 1 FROM outcomes p WHERE p.outcome = 'new' AND p.domain = o.domain AND p.row_number < o.row_number) END)
SELECT 'contact' AS target, row_number, email AS name FROM outcomes WHERE outcome = 'new' UNION ALL SELECT 'contact_email', row_number, email FROM outcomes WHERE outcome = 'new' UNION ALL SELECT 'list_member', row_number, email FROM outcomes WHERE outcome IN ('new', 'updated')
UNION ALL SELECT 'organization', row_number, name FROM c WHERE company IS NULL OR (company NOT IN (SELECT name FROM orgs) AND NOT EXISTS (SELECT 1 FROM c d WHERE d.name = c.name AND d.row_number < c.row_number))"""),
    "a24_import_stats": with_views("contact_email list_member", _IMPORT + " SELECT outcome, count(*) AS n_rows FROM outcomes GROUP BY 1"),
    "s17_insert_ignore": with_views("list_member enrollment", "SELECT campaign_id, contact_id, status FROM enrollment WHERE campaign_id = 2 UNION ALL SELECT 2, contact_id, 'pending' FROM (SELECT DISTINCT contact_id FROM list_member WHERE list_id IN (0, 3)) WHERE contact_id NOT IN (SELECT contact_id FROM enrollment WHERE campaign_id = 2)"),
    "s18_upsert": with_views("contact_email suppression", "SELECT normalized_email, reason, at_ AS at FROM (SELECT normalized_email, reason, 1 AS at_, 0 AS new_ FROM suppression UNION ALL SELECT normalized_email, 'hard_bounce', max(bounce_count), 1 FROM contact_email WHERE bounce_count > 0 GROUP BY 1) QUALIFY row_number() OVER (PARTITION BY normalized_email ORDER BY at_ DESC, new_ DESC) = 1").replace("at_ AS at", 'at_ AS "at"'),
    "s19_cascade": with_views("contact contact_email list_member enrollment message event", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t} WHERE {c} NOT IN (SELECT id FROM contact WHERE id % 7 = 0)" for t, c in (("contact", "id"), ("contact_email", "contact_id"), ("list_member", "contact_id"), ("enrollment", "contact_id"), ("message", "contact_id"), ("event", "contact_id")))),
    "s20_copy": with_views("list_member", "SELECT list_id + 100 AS list_id, 'list-' || list_id || ' (Copy)' AS name, contact_id FROM list_member WHERE list_id = 3"),
    "f25_suppression_input": "SELECT DISTINCT s_suppkey, email FROM (SELECT s_suppkey, lower(trim(unnest(string_split(replace(replace(' A' || s_suppkey || '@X.example;' || (s_suppkey % 10) || '@Y.example,@bad,worse@\n a@b ,Z' || (s_suppkey % 3) || '@q.example', ';', ','), chr(10), ',')  , ',')))) AS email FROM supplier) WHERE length(email) > 3 AND email LIKE '_%@%_'",
    "o01_page": with_views("contact", "SELECT id, city FROM contact ORDER BY city, id LIMIT 50 OFFSET 100"),
    "o04_upcoming": with_views("enrollment", "SELECT id, (contact_id * 7919 + campaign_id) % 100003 AS next_at FROM enrollment WHERE status = 'active' ORDER BY next_at, id LIMIT 5"),
}
