"""Domain tables of the outreach data model over the star-schema test tables, in Spark and as SQL for the oracle.

Every expression is portable, so that both sides restate the same rows. Timestamps are UTC without zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE_STATUS = ("sent", "delivered", "opened", "clicked", "replied", "bounced", "failed", "pending", "queued", "draft", "sent", "delivered")
ENROLLMENT_STATUS = ("active", "active", "completed", "replied", "bounced", "unsubscribed", "active", "pending", "soft_bounced", "completed")
MAILBOXES = 7


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, contact_id, campaign_id, enrollment_id?, step_no?, status, from_email, to_email, sent_at?, created_at."""
    key = F.col("o_orderkey")
    status = _pick(MESSAGE_STATUS, F.pmod(key * 7 + F.col("o_custkey"), F.lit(12)))
    campaign = F.pmod(key, F.lit(5))
    return _read(spark, sf_dir, "orders").select(
        key.alias("id"),
        F.col("o_custkey").alias("contact_id"),
        campaign.alias("campaign_id"),
        F.when(key % 11 != 0, F.concat_ws("-", campaign, "o_custkey")).alias("enrollment_id"),
        F.when(key % 13 != 0, key % 3 + 1).alias("step_no"),
        status.alias("status"),
        F.concat(F.lit("Mailbox"), key % MAILBOXES, F.lit("@sender.example")).alias("from_email"),
        F.concat(F.lit("Contact"), "o_custkey", F.lit("@corp"), F.col("o_custkey") % 97, F.lit(".example")).alias("to_email"),
        F.when(~status.isin("pending", "queued", "draft"), F.col("o_orderdate")).alias("sent_at"),
        F.col("o_orderdate").alias("created_at"),
    )


def event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, contact_id, campaign_id, enrollment_id?, message_id, link_no, event_type, event_at."""
    key = F.col("event_id")
    plain = F.when(F.col("event_type") == "view", "opened").when(F.col("event_type") == "click", "clicked").when(F.col("event_type") == "signup", "replied").when(F.col("event_type") == "purchase", "unsubscribed").otherwise("bounced")
    kind = F.when(key % 3 == 0, F.concat(F.lit("email."), plain)).when(key % 29 == 0, F.upper(plain)).otherwise(plain)
    campaign = F.pmod(key, F.lit(5))
    return _read(spark, sf_dir, "events").select(
        key.alias("id"),
        F.col("user_id").alias("contact_id"),
        campaign.alias("campaign_id"),
        F.when(key % 17 != 0, F.concat_ws("-", campaign, "user_id")).alias("enrollment_id"),
        key.alias("message_id"),
        (key % 7 + 1).alias("link_no"),
        kind.alias("event_type"),
        F.col("ts").alias("event_at"),
    )


def enrollment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, campaign_id, contact_id, current_step, status; a row for each campaign and contact."""
    pairs = _read(spark, sf_dir, "orders").select(F.pmod("o_orderkey", F.lit(5)).alias("campaign_id"), F.col("o_custkey").alias("contact_id")).distinct()
    status = _pick(ENROLLMENT_STATUS, F.pmod(F.col("campaign_id") * 7 + F.col("contact_id"), F.lit(10)))
    return pairs.select(F.concat_ws("-", "campaign_id", "contact_id").alias("id"), "campaign_id", "contact_id", (F.col("contact_id") % 3 + 1).alias("current_step"), status.alias("status"))


def contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, user_id, full_name, industry, city, country, do_not_contact, created_at order by id."""
    nation, region = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    place = nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"])
    c = _read(spark, sf_dir, "customer")
    return c.join(F.broadcast(place), c["c_nationkey"] == place["n_nationkey"], "left").select(
        F.col("c_custkey").alias("id"), (F.col("c_custkey") % 4).alias("user_id"), F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("industry"), F.col("n_name").alias("city"), F.col("r_name").alias("country"), (F.col("c_acctbal") < 0).alias("do_not_contact")
    )


def contact_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, contact_id, email, normalized_email, is_primary, is_valid, verification, bounce_count; one or two for each contact but some."""
    c = _read(spark, sf_dir, "customer").where("c_custkey % 23 <> 0")
    rows = c.select(F.col("c_custkey").alias("contact_id"), F.explode(F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("n"))
    owner = F.when(F.col("n") == 2, F.col("contact_id") - F.col("contact_id") % 6).otherwise(F.col("contact_id"))
    email = F.concat(F.lit("Contact"), owner, F.lit("@corp"), owner % 97, F.lit(".example"))
    return rows.select(
        (F.col("contact_id") * 2 + F.col("n")).alias("id"),
        "contact_id",
        email.alias("email"),
        F.lower(email).alias("normalized_email"),
        (F.col("n") == F.col("contact_id") % 2 + 1).alias("is_primary"),
        (F.col("contact_id") % 19 != 0).alias("is_valid"),
        F.when(F.col("contact_id") % 31 == 0, "invalid").when(F.col("contact_id") % 7 == 0, "risky").otherwise("valid").alias("verification"),
        F.when(F.col("contact_id") % 37 == 0, 2).when(F.col("contact_id") % 41 == 0, 1).otherwise(0).alias("bounce_count"),
    )


def suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """normalized_email, reason, user_id? (null: global)."""
    owner = F.col("s_suppkey") * 11
    reason = _pick(("unsubscribe", "hard_bounce", "spam_complaint", "do_not_contact"), F.col("s_suppkey") % 4)
    return _read(spark, sf_dir, "supplier").select(F.lower(F.concat(F.lit("Contact"), owner, F.lit("@corp"), owner % 97, F.lit(".example"))).alias("normalized_email"), reason.alias("reason"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_suppkey") % 4).alias("user_id"))


def list_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """list_id (0 to 5), contact_id; lists overlap."""
    c = _read(spark, sf_dir, "customer")
    rows = c.select(F.explode(F.array(F.col("c_custkey") % 6, F.col("c_custkey") % 4)).alias("list_id"), F.col("c_custkey").alias("contact_id"))
    return rows.distinct()


def link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, message_id, link_no, destination_url, click_count."""
    item, part = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "part")
    joined = item.join(part, item["l_partkey"] == part["p_partkey"])
    return joined.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"),
        F.col("l_orderkey").alias("message_id"),
        F.col("l_linenumber").cast("long").alias("link_no"),
        F.concat(F.lit("https://shop.example/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))).alias("destination_url"),
        F.col("l_quantity").cast("int").alias("click_count"),
    )


def lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_number, user_id, company, domain?, email?, phone?, city; names come in several spellings."""
    nation = _read(spark, sf_dir, "nation")
    s = _read(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    base = F.concat(F.lit("Nova "), _pick(("Textile", "Software", "Global", "Marine", "Solar"), key % 5), F.lit(" "), key % 211)
    suffix = _pick((" Ltd", " GmbH & Co. KG", ", LLC", "", " Pvt. Ltd."), key % 7 % 5)
    return s.join(F.broadcast(nation), s["c_nationkey"] == nation["n_nationkey"]).select(
        key.alias("row_number"),
        (key % 2).alias("user_id"),
        F.concat(base, suffix).alias("company"),
        F.when(key % 3 == 0, F.concat(F.lit("https://www.nova"), key % 307, F.lit(".example.co.uk/about?x=1"))).alias("website"),
        F.when(key % 4 == 0, F.concat(F.lit("mailto:Sales"), key % 401, F.lit("@Nova.example"))).alias("email"),
        F.when(key % 5 == 0, F.concat(F.lit("+1 (555) 200-"), F.lpad((key % 499).cast("string"), 4, "0"))).alias("phone"),
        F.col("n_name").alias("city"),
    )


def inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, conv_id, turn, direction, body, received_at (a made-up time from conversation and turn)."""
    key = F.col("conv_id") * 100 + F.col("turn")
    return _read(spark, sf_dir, "conversations").select(
        key.alias("id"), "conv_id", "turn", F.when(F.col("role") == "user", "INBOUND").when(F.col("role") == "assistant", "OUTBOUND").otherwise("SYSTEM").alias("direction"), F.col("text").alias("body"), (F.col("conv_id") * 1000 + F.col("turn") * F.col("turn") * 20).alias("received_s")
    )


def team(spark: SparkSession) -> DataFrame:
    """user_id, name, email: the four users."""
    k = F.col("id")
    return spark.range(4).select(k.alias("user_id"), F.concat(F.lit("User "), k).alias("name"), F.concat(F.lit("User"), k, F.lit("@team.example")).alias("email"))


def campaign(spark: SparkSession) -> DataFrame:
    """campaign_id (0 to 4), user_id?, owner? (a user's name or address), budget."""
    k = F.col("id")
    owner = F.when(k == 1, "User 1").when(k == 2, "User2@team.example")
    return spark.range(5).select(k.alias("campaign_id"), F.when(k.isin(0, 4), F.lit(0).cast("long")).alias("user_id"), owner.alias("owner"), (k * 7 + 3).alias("budget"))


def mailbox(spark: SparkSession) -> DataFrame:
    """mailbox_id (0 to 6), user_id, email."""
    k = F.col("id")
    return spark.range(MAILBOXES).select(k.alias("mailbox_id"), (k % 4).alias("user_id"), F.concat(F.lit("Mailbox"), k, F.lit("@sender.example")).alias("email"))


def conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, mailbox_id, campaign_id?, contact_id, assigned_to? (a user's id or address), status, interest, unread, has_inbound."""
    k = F.col("conv_id")
    user = F.concat(F.lit("User"), k % 4, F.lit("@team.example"))
    turns = _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.bool_or(F.col("role") == "user").alias("has_inbound"))
    return turns.select(
        "conv_id", (k % MAILBOXES).alias("mailbox_id"), F.when(k % 3 != 0, k % 5).alias("campaign_id"), (k * 13 % 150).alias("contact_id"),
        F.when(k % 6 == 0, (k % 4).cast("string")).when(k % 6 == 1, user).alias("assigned_to"), _pick(("OPEN", "NEEDS_ACTION", "CLOSED"), k % 3).alias("status"), F.when(k % 4 == 0, "INTERESTED").otherwise("NONE").alias("interest"), (k % 5).alias("unread"), "has_inbound",
    )


def reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reply_id, sender, mailbox, header?, received_s: inbound turns as mails of contacts, aliases, own mailboxes and strangers."""
    k, c = F.col("id"), F.col("conv_id") * 31 + F.col("turn") * 7
    contact = F.when(k % 5 == 2, c % 138 - c % 138 % 23).otherwise(c % 150)
    sender = F.when(k % 5 == 1, F.concat(F.lit("alias"), k, F.lit("@else.example"))).when(k % 5 == 3, F.concat(F.lit("MAILBOX"), k % MAILBOXES, F.lit("@sender.example"))).when(k % 5 == 4, "nobody@else.example")
    sender = F.coalesce(sender, F.concat(F.lit("contact"), contact, F.lit("@corp"), contact % 97, F.lit(".example")))
    header = F.when(k % 5 < 2, F.concat(F.lit("<MSG"), (F.col("conv_id") * 37 + F.col("turn") * 11) % 1500, F.lit("@mail.example>")))
    return inbound(spark, sf_dir).where("direction = 'INBOUND'").select(k.alias("reply_id"), sender.alias("sender"), F.concat(F.lit("Mailbox"), F.col("conv_id") % MAILBOXES, F.lit("@sender.example")).alias("mailbox"), header.alias("header"), "received_s")


_STATUSES = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"

#: The same tables as SQL; with_views() puts the named ones in front of a query.
VIEWS: dict[str, str] = {
    "message": f"""SELECT o_orderkey AS id, o_custkey AS contact_id, o_orderkey % 5 AS campaign_id,
  CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey % 5) || '-' || o_custkey END AS enrollment_id,
  CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey % 3 + 1 END AS step_no,
  ({_STATUSES(MESSAGE_STATUS)})[(o_orderkey * 7 + o_custkey) % 12 + 1] AS status,
  'Mailbox' || (o_orderkey % {MAILBOXES}) || '@sender.example' AS from_email,
  'Contact' || o_custkey || '@corp' || (o_custkey % 97) || '.example' AS to_email,
  CASE WHEN ({_STATUSES(MESSAGE_STATUS)})[(o_orderkey * 7 + o_custkey) % 12 + 1] NOT IN ('pending', 'queued', 'draft') THEN o_orderdate END AS sent_at,
  o_orderdate AS created_at FROM orders""",
    "event": """SELECT event_id AS id, user_id AS contact_id, event_id % 5 AS campaign_id,
  CASE WHEN event_id % 17 <> 0 THEN (event_id % 5) || '-' || user_id END AS enrollment_id,
  event_id AS message_id, event_id % 7 + 1 AS link_no,
  CASE WHEN event_id % 3 = 0 THEN 'email.' || plain WHEN event_id % 29 = 0 THEN upper(plain) ELSE plain END AS event_type, ts AS event_at
  FROM (SELECT *, CASE event_type WHEN 'view' THEN 'opened' WHEN 'click' THEN 'clicked' WHEN 'signup' THEN 'replied' WHEN 'purchase' THEN 'unsubscribed' ELSE 'bounced' END AS plain FROM events)""",
    "enrollment": f"""SELECT campaign_id || '-' || contact_id AS id, campaign_id, contact_id, contact_id % 3 + 1 AS current_step,
  ({_STATUSES(ENROLLMENT_STATUS)})[(campaign_id * 7 + contact_id) % 10 + 1] AS status
  FROM (SELECT DISTINCT o_orderkey % 5 AS campaign_id, o_custkey AS contact_id FROM orders)""",
    "contact": """SELECT c_custkey AS id, c_custkey % 4 AS user_id, c_name AS full_name, c_mktsegment AS industry, n_name AS city, r_name AS country, c_acctbal < 0 AS do_not_contact
  FROM customer LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey""",
    "contact_email": """SELECT contact_id * 2 + n AS id, contact_id, 'Contact' || owner || '@corp' || (owner % 97) || '.example' AS email,
  lower('Contact' || owner || '@corp' || (owner % 97) || '.example') AS normalized_email, n = contact_id % 2 + 1 AS is_primary,
  contact_id % 19 <> 0 AS is_valid, CASE WHEN contact_id % 31 = 0 THEN 'invalid' WHEN contact_id % 7 = 0 THEN 'risky' ELSE 'valid' END AS verification,
  CASE WHEN contact_id % 37 = 0 THEN 2 WHEN contact_id % 41 = 0 THEN 1 ELSE 0 END AS bounce_count
  FROM (SELECT c_custkey AS contact_id, n, CASE WHEN n = 2 THEN c_custkey - c_custkey % 6 ELSE c_custkey END AS owner
    FROM customer, (SELECT unnest([1, 2]) AS n) WHERE c_custkey % 23 <> 0 AND (n = 1 OR c_custkey % 3 = 0))""",
    "suppression": """SELECT lower('Contact' || (s_suppkey * 11) || '@corp' || ((s_suppkey * 11) % 97) || '.example') AS normalized_email,
  (['unsubscribe', 'hard_bounce', 'spam_complaint', 'do_not_contact'])[s_suppkey % 4 + 1] AS reason,
  CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 4 END AS user_id FROM supplier""",
    "list_member": "SELECT DISTINCT unnest([c_custkey % 6, c_custkey % 4]) AS list_id, c_custkey AS contact_id FROM customer",
    "link": """SELECT l_orderkey || '-' || l_linenumber AS id, l_orderkey AS message_id, l_linenumber::BIGINT AS link_no,
  'https://shop.example/' || lower(replace(p_brand, '#', '-')) AS destination_url, trunc(l_quantity)::INTEGER AS click_count
  FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "lead": """SELECT c_custkey AS row_number, c_custkey % 2 AS user_id,
  'Nova ' || (['Textile', 'Software', 'Global', 'Marine', 'Solar'])[c_custkey % 5 + 1] || ' ' || (c_custkey % 211) || ([' Ltd', ' GmbH & Co. KG', ', LLC', '', ' Pvt. Ltd.'])[c_custkey % 7 % 5 + 1] AS company,
  CASE WHEN c_custkey % 3 = 0 THEN 'https://www.nova' || (c_custkey % 307) || '.example.co.uk/about?x=1' END AS website,
  CASE WHEN c_custkey % 4 = 0 THEN 'mailto:Sales' || (c_custkey % 401) || '@Nova.example' END AS email,
  CASE WHEN c_custkey % 5 = 0 THEN '+1 (555) 200-' || lpad((c_custkey % 499)::VARCHAR, 4, '0') END AS phone, n_name AS city
  FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "inbound": """SELECT conv_id * 100 + turn AS id, conv_id, turn, CASE role WHEN 'user' THEN 'INBOUND' WHEN 'assistant' THEN 'OUTBOUND' ELSE 'SYSTEM' END AS direction,
  text AS body, conv_id * 1000 + turn * turn * 20 AS received_s FROM conversations""",
    "team": "SELECT k AS user_id, 'User ' || k AS name, 'User' || k || '@team.example' AS email FROM (SELECT unnest(range(4)) AS k)",
    "campaign": "SELECT k AS campaign_id, CASE WHEN k IN (0, 4) THEN 0 END AS user_id, CASE k WHEN 1 THEN 'User 1' WHEN 2 THEN 'User2@team.example' END AS owner, k * 7 + 3 AS budget FROM (SELECT unnest(range(5)) AS k)",
    "mailbox": f"SELECT k AS mailbox_id, k % 4 AS user_id, 'Mailbox' || k || '@sender.example' AS email FROM (SELECT unnest(range({MAILBOXES})) AS k)",
    "conversation": f"""SELECT conv_id, conv_id % {MAILBOXES} AS mailbox_id, CASE WHEN conv_id % 3 <> 0 THEN conv_id % 5 END AS campaign_id, conv_id * 13 % 150 AS contact_id,
  CASE conv_id % 6 WHEN 0 THEN (conv_id % 4)::VARCHAR WHEN 1 THEN 'User' || (conv_id % 4) || '@team.example' END AS assigned_to, (['OPEN', 'NEEDS_ACTION', 'CLOSED'])[conv_id % 3 + 1] AS status,
  CASE WHEN conv_id % 4 = 0 THEN 'INTERESTED' ELSE 'NONE' END AS interest, conv_id % 5 AS unread, bool_or(role = 'user') AS has_inbound FROM conversations GROUP BY conv_id""",
    "reply": f"""SELECT id AS reply_id, CASE id % 5 WHEN 1 THEN 'alias' || id || '@else.example' WHEN 3 THEN 'MAILBOX' || (id % {MAILBOXES}) || '@sender.example' WHEN 4 THEN 'nobody@else.example' ELSE 'contact' || n || '@corp' || (n % 97) || '.example' END AS sender,
  'Mailbox' || (conv_id % {MAILBOXES}) || '@sender.example' AS mailbox, CASE WHEN id % 5 < 2 THEN '<MSG' || ((conv_id * 37 + turn * 11) % 1500) || '@mail.example>' END AS header, conv_id * 1000 + turn * turn * 20 AS received_s
  FROM (SELECT *, conv_id * 100 + turn AS id, CASE WHEN (conv_id * 100 + turn) % 5 = 2 THEN (conv_id * 31 + turn * 7) % 138 - (conv_id * 31 + turn * 7) % 138 % 23 ELSE (conv_id * 31 + turn * 7) % 150 END AS n FROM conversations WHERE role = 'user')""",
}


def with_views(names: str, query: str) -> str:
    """query behind the named views (separated by blanks) as common table expressions."""
    head = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in names.split())
    body = query.strip()
    if body.split(maxsplit=1)[0] == "WITH":
        return f"WITH {head},\n{body[4:]}"
    return f"WITH {head}\n{body}"
