"""Engagement analytics: overview, funnel, timeline, steps, links, contacts, cards, mailboxes.

The surfaces define "sent", "delivered" and "unique" differently; each function names the definition it uses. Facts
are aggregated one by one and joined on their key afterwards, never joined to each other first. Exact distinct counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike import views
from marlspike.views import with_views

CAMPAIGNS = 5
SIX = ("sent", "delivered", "opened", "clicked", "replied", "bounced")
STARTED = ("active", "replied", "completed", "bounced")


def alias_set(kind: str, upper: bool = False) -> list[str]:
    """The names of an event type; the upper-case form counts on mailbox surfaces alone."""
    return [kind, f"email.{kind}", *([kind.upper()] if upper else [])]


def is_event(kind: str, upper: bool = False) -> Column:
    return F.col("event_type").isin(alias_set(kind, upper))


def rate(part: Column, whole: Column, clamp: bool = True) -> Column:
    """Percent to one decimal, null when there is no whole."""
    value = F.round(100.0 * part / F.nullif(whole, F.lit(0)), 1)
    return F.least(F.lit(100.0), value) if clamp else value


def _distinct(key: str, condition: Column) -> Column:
    return F.count_distinct(F.when(condition, F.col(key)))


def overview(messages: DataFrame, events: DataFrame, enrollments: DataFrame) -> DataFrame:
    """Per campaign: totals, unique people and rates.

    Sent: messages now sent or delivered. Delivered: sent less bounced messages. Unique: enrollments; replies and
    unsubscriptions come from events and from the enrollment's own status together.
    """
    sent = F.col("status").isin("sent", "delivered")
    m = messages.groupBy("campaign_id").agg(
        F.count_if(sent).alias("sent"),
        _distinct("enrollment_id", sent).alias("unique_sent"),
        F.count_if(F.col("status") == "bounced").alias("bounced_messages"),
        F.count_if(F.col("status").isin("bounced", "failed", "pending")).alias("confidence_unknown"),
    )
    people = lambda source, kind, condition: source.where(condition).select("campaign_id", F.lit(kind).alias("kind"), F.col("person"))
    of_events, of_status, of_messages = events.withColumn("person", F.col("enrollment_id")), enrollments.withColumn("person", F.col("id")), messages.withColumn("person", F.col("enrollment_id"))
    both = (
        people(of_events, "bounced", is_event("bounced"))
        .unionByName(people(of_messages, "bounced", F.col("status") == "bounced"))
        .unionByName(people(of_events, "replied", is_event("replied")))
        .unionByName(people(of_status, "replied", F.col("status") == "replied"))
        .unionByName(people(of_events, "unsubscribed", is_event("unsubscribed")))
        .unionByName(people(of_status, "unsubscribed", F.col("status") == "unsubscribed"))
    )
    u = both.groupBy("campaign_id").agg(*[_distinct("person", F.col("kind") == k).alias(f"unique_{k}") for k in ("bounced", "replied", "unsubscribed")])
    e = events.groupBy("campaign_id").agg(
        F.count_if(is_event("opened")).alias("total_opens"),
        _distinct("enrollment_id", is_event("opened")).alias("unique_openers"),
        F.count_if(is_event("clicked")).alias("total_clicks"),
        _distinct("enrollment_id", is_event("clicked")).alias("unique_clickers"),
        F.count_if(is_event("replied")).alias("reply_events"),
    )
    n = enrollments.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("total_enrolled"), F.count_if(F.col("status").isin(*STARTED)).alias("sequence_started"))
    return overview_rates(n.join(m, "campaign_id", "left").join(u, "campaign_id", "left").join(e, "campaign_id", "left").na.fill(0))


def overview_rates(joined: DataFrame) -> DataFrame:
    """The overview's columns, from its totals and unique people."""
    delivered, reached = F.greatest(F.lit(0), F.col("sent") - F.col("bounced_messages")), F.greatest(F.lit(0), F.col("unique_sent") - F.col("unique_bounced"))
    wide = joined.withColumns({"delivered": delivered, "unique_delivered": reached, "total_replies": F.greatest("reply_events", "unique_replied")})
    base = F.col("unique_delivered")
    return wide.select(
        "campaign_id", "total_enrolled", "sequence_started", "sent", "unique_sent", "delivered", "unique_delivered", "confidence_unknown", "total_opens", "unique_openers",
        rate(F.col("unique_openers"), base).alias("unique_open_rate"), "total_clicks", "unique_clickers", rate(F.col("unique_clickers"), base).alias("unique_click_rate"),
        "total_replies", "unique_replied", rate(F.col("unique_replied"), base).alias("reply_rate"), "unique_bounced", rate(F.col("unique_bounced"), F.col("unique_sent")).alias("bounce_rate"),
        "unique_unsubscribed", rate(F.col("unique_unsubscribed"), base).alias("unsubscribe_rate"),
    )


OVERVIEW_SQL = """
m AS (SELECT campaign_id, count(*) FILTER (WHERE status IN ('sent', 'delivered')) AS sent,
    count(DISTINCT enrollment_id) FILTER (WHERE status IN ('sent', 'delivered')) AS unique_sent,
    count(*) FILTER (WHERE status = 'bounced') AS bounced_messages,
    count(*) FILTER (WHERE status IN ('bounced', 'failed', 'pending')) AS confidence_unknown FROM message GROUP BY 1),
people AS (SELECT campaign_id, enrollment_id AS person, replace(event_type, 'email.', '') AS kind FROM event WHERE event_type <> upper(event_type)
  UNION ALL SELECT campaign_id, enrollment_id, status FROM message WHERE status = 'bounced'
  UNION ALL SELECT campaign_id, id, status FROM enrollment WHERE status IN ('replied', 'unsubscribed')),
u AS (SELECT campaign_id, count(DISTINCT person) FILTER (WHERE kind = 'bounced') AS unique_bounced,
    count(DISTINCT person) FILTER (WHERE kind = 'replied') AS unique_replied,
    count(DISTINCT person) FILTER (WHERE kind = 'unsubscribed') AS unique_unsubscribed FROM people GROUP BY 1),
e AS (SELECT campaign_id, count(*) FILTER (WHERE event_type IN ('opened', 'email.opened')) AS total_opens,
    count(DISTINCT enrollment_id) FILTER (WHERE event_type IN ('opened', 'email.opened')) AS unique_openers,
    count(*) FILTER (WHERE event_type IN ('clicked', 'email.clicked')) AS total_clicks,
    count(DISTINCT enrollment_id) FILTER (WHERE event_type IN ('clicked', 'email.clicked')) AS unique_clickers,
    count(*) FILTER (WHERE event_type IN ('replied', 'email.replied')) AS reply_events FROM event GROUP BY 1),
n AS (SELECT campaign_id, count(*) AS total_enrolled, count(*) FILTER (WHERE status IN ('active', 'replied', 'completed', 'bounced')) AS sequence_started FROM enrollment GROUP BY 1),
w AS (SELECT *, greatest(0, sent - bounced_messages) AS delivered, greatest(0, unique_sent - unique_bounced) AS unique_delivered, greatest(reply_events, unique_replied) AS total_replies
  FROM n LEFT JOIN m USING (campaign_id) LEFT JOIN u USING (campaign_id) LEFT JOIN e USING (campaign_id)),
overview AS (SELECT campaign_id, total_enrolled, sequence_started, sent, unique_sent, delivered, unique_delivered, confidence_unknown, total_opens, unique_openers,
  least(100.0, round(100.0 * unique_openers / nullif(unique_delivered, 0), 1))::DOUBLE AS unique_open_rate, total_clicks, unique_clickers,
  least(100.0, round(100.0 * unique_clickers / nullif(unique_delivered, 0), 1))::DOUBLE AS unique_click_rate, total_replies, unique_replied,
  least(100.0, round(100.0 * unique_replied / nullif(unique_delivered, 0), 1))::DOUBLE AS reply_rate, unique_bounced,
  least(100.0, round(100.0 * unique_bounced / nullif(unique_sent, 0), 1))::DOUBLE AS bounce_rate, unique_unsubscribed,
  least(100.0, round(100.0 * unique_unsubscribed / nullif(unique_delivered, 0), 1))::DOUBLE AS unsubscribe_rate FROM w)
"""


def a01_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview(views.message(spark, sf_dir), views.event(spark, sf_dir), views.enrollment(spark, sf_dir))


def funnel(over: DataFrame) -> DataFrame:
    """Five stages of unique people for each campaign; percent of sent (100 for the first), drop from the stage before (not below 0)."""
    names = ("Sent", "Delivered (Inferred)", "Opened", "Clicked", "Replied")
    counts = ("unique_sent", "unique_delivered", "unique_openers", "unique_clickers", "unique_replied")
    rows = []
    for i, (name, count) in enumerate(zip(names, counts, strict=True)):
        share = F.lit(100.0) if i == 0 else F.coalesce(rate(F.col(count), F.col("unique_sent"), clamp=False), F.lit(0.0))
        before = F.col(counts[max(i - 1, 0)])
        drop = F.lit(0.0) if i == 0 else F.greatest(F.lit(0.0), F.coalesce(rate(before - F.col(count), before, clamp=False), F.lit(0.0)))
        rows.append(F.struct(F.lit(i + 1).alias("stage_no"), F.lit(name).alias("stage"), F.col(count).alias("people"), share.alias("percent_of_sent"), drop.alias("drop_off")))
    return over.select("campaign_id", F.explode(F.array(*rows)).alias("s")).select("campaign_id", "s.*")


def a02_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel(a01_overview(spark, sf_dir))


def timeline(messages: DataFrame, events: DataFrame, first_day: str, days: int) -> DataFrame:
    """Per campaign and day of the span: sends (by sent time, else creation), unique and total engagement; days without any are zero."""
    last = F.date_add(F.lit(first_day).cast("date"), days - 1)
    inside = lambda day: (day >= F.lit(first_day).cast("date")) & (day <= last)
    sends = messages.where(F.col("status").isin("sent", "delivered")).withColumn("day", F.coalesce("sent_at", "created_at").cast("date")).where(inside(F.col("day"))).groupBy("campaign_id", "day").agg(F.count(F.lit(1)).alias("sent"))
    seen = events.withColumn("day", F.col("event_at").cast("date")).where(inside(F.col("day")))
    seen = seen.groupBy("campaign_id", "day").agg(
        _distinct("enrollment_id", is_event("opened")).alias("unique_opens"), _distinct("enrollment_id", is_event("clicked")).alias("unique_clickers"), _distinct("enrollment_id", is_event("replied")).alias("replies"),
        F.count_if(is_event("opened")).alias("total_opens"), F.count_if(is_event("clicked")).alias("total_clicks"),
    )
    campaigns = messages.select("campaign_id").union(events.select("campaign_id")).distinct()
    spine = campaigns.select("campaign_id", F.explode(F.sequence(F.lit(first_day).cast("date"), last)).alias("day"))
    return spine.join(sends, ["campaign_id", "day"], "left").join(seen, ["campaign_id", "day"], "left").na.fill(0).withColumn("delivered", F.col("sent"))


def a03_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timeline(views.message(spark, sf_dir), views.event(spark, sf_dir), "2024-01-01", 31)
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def steps(messages: DataFrame, events: DataFrame, numbers: list[int]) -> DataFrame:
    """Per campaign and step: sent (sent, delivered or bounced messages), delivered (messages), unique people by enrollment; rates aren't clamped."""
    counted = messages.where(F.col("status").isin("sent", "delivered", "bounced") & F.col("step_no").isNotNull())
    m = counted.groupBy("campaign_id", "step_no").agg(F.count(F.lit(1)).alias("sent"), F.count_if(F.col("status") == "bounced").alias("bounces"))
    tied = events.select("message_id", "event_type", F.col("enrollment_id").alias("person")).join(counted.select(F.col("id").alias("message_id"), "campaign_id", "step_no"), "message_id")
    e = tied.groupBy("campaign_id", "step_no").agg(
        _distinct("person", is_event("opened")).alias("unique_opens"), F.count_if(is_event("opened")).alias("total_opens"), _distinct("person", is_event("clicked")).alias("unique_clicks"),
        F.count_if(is_event("clicked")).alias("total_clicks"), _distinct("person", is_event("replied")).alias("replies"),
    )
    spine = messages.select("campaign_id").distinct().select("campaign_id", F.explode(F.array(*[F.lit(n).cast("long") for n in numbers])).alias("step_no"))
    out = spine.join(m, ["campaign_id", "step_no"], "left").join(e, ["campaign_id", "step_no"], "left").na.fill(0)
    out = out.withColumn("delivered", F.greatest(F.lit(0), F.col("sent") - F.col("bounces")))
    for name, part in (("unique_open_rate", "unique_opens"), ("unique_click_rate", "unique_clicks"), ("reply_rate", "replies")):
        out = out.withColumn(name, rate(F.col(part), F.col("delivered"), clamp=False))
    return out


def a04_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(views.message(spark, sf_dir), views.event(spark, sf_dir), [1, 2, 3])


def links(link: DataFrame, events: DataFrame, messages: DataFrame) -> DataFrame:
    """Per destination: the links' own click counters, distinct clickers (enrollment, else contact, else recipient), first and last click.

    The counters are summed before events are joined, so that events don't multiply them.
    """
    counters = link.groupBy("destination_url").agg(F.sum("click_count").alias("total_clicks"))
    clicks = events.where(is_event("clicked")).select("message_id", "link_no", "event_at", "enrollment_id", "contact_id")
    to = messages.select(F.col("id").alias("message_id"), "to_email")
    tied = clicks.join(link.select("message_id", "link_no", "destination_url"), ["message_id", "link_no"]).join(to, "message_id", "left")
    who = F.coalesce("enrollment_id", F.col("contact_id").cast("string"), "to_email", F.lit("unknown"))
    seen = tied.groupBy("destination_url").agg(F.count_distinct(who).alias("unique_clickers"), F.min("event_at").alias("first_clicked_at"), F.max("event_at").alias("last_clicked_at"))
    return counters.join(seen, "destination_url", "left").na.fill(0, ["unique_clickers"])


def a05_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(views.link(spark, sf_dir), views.event(spark, sf_dir), views.message(spark, sf_dir))


def contact_engagement(enrollments: DataFrame, events: DataFrame, messages: DataFrame) -> DataFrame:
    """Per enrollment: counts, first and last times, last activity and the derived status.

    Precedence: bounced, unsubscribed (by enrollment status), replied, clicked, opened, sent, not sent.
    """
    kinds = ("opened", "clicked", "replied")
    e = events.where("enrollment_id is not null").groupBy(F.col("enrollment_id").alias("id")).agg(*[c for k in kinds for c in (F.count_if(is_event(k)).alias(f"{k}_count"), F.min(F.when(is_event(k), F.col("event_at"))).alias(f"first_{k}_at"), F.max(F.when(is_event(k), F.col("event_at"))).alias(f"last_{k}_at"))])
    m = messages.where("enrollment_id is not null").groupBy(F.col("enrollment_id").alias("id")).agg(F.max("sent_at").alias("last_sent_at"), F.count(F.lit(1)).alias("messages"))
    joined = enrollments.join(e, "id", "left").join(m, "id", "left").na.fill(0)
    joined = joined.withColumn("replied_count", F.greatest("replied_count", F.when(F.col("status") == "replied", 1).otherwise(0)))
    status = F.when(F.col("status") == "bounced", "BOUNCED").when(F.col("status") == "unsubscribed", "UNSUBSCRIBED").when(F.col("replied_count") > 0, "REPLIED").when(F.col("clicked_count") > 0, "CLICKED").when(F.col("opened_count") > 0, "OPENED").when(F.col("last_sent_at").isNotNull() | (F.col("messages") > 0), "SENT").otherwise("NOT_SENT")
    return joined.withColumns({"engagement_status": status, "last_activity_at": F.greatest("last_sent_at", "last_opened_at", "last_clicked_at", "last_replied_at")}).drop("messages")




def segment(rows: DataFrame, name: str) -> DataFrame:
    opened, clicked, replied, status = F.col("opened_count") > 0, F.col("clicked_count") > 0, F.col("replied_count") > 0, F.col("engagement_status")
    filters = {
        "OPENED": opened, "NOT_OPENED": ~opened & (status == "SENT"), "CLICKED": clicked, "REPLIED": replied, "BOUNCED": status == "BOUNCED", "UNSUBSCRIBED": status == "UNSUBSCRIBED",
        "HIGH_ENGAGEMENT": clicked | replied, "NO_ENGAGEMENT": (status == "SENT") & ~opened,
    }
    wanted = filters.get(name.upper())
    return rows if wanted is None else rows.where(wanted)


def a06_contact_engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contact_engagement(views.enrollment(spark, sf_dir), views.event(spark, sf_dir), views.message(spark, sf_dir))


def p14_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each named segment."""
    rows = a06_contact_engagement(spark, sf_dir)
    names = ("ALL", "OPENED", "NOT_OPENED", "CLICKED", "REPLIED", "BOUNCED", "UNSUBSCRIBED", "HIGH_ENGAGEMENT", "NO_ENGAGEMENT")
    out = None
    for name in names:
        part = segment(rows, name).groupBy(F.lit(name).alias("segment")).agg(F.count(F.lit(1)).alias("people"))
        out = part if out is None else out.unionByName(part)
    return out


def global_overview(messages: DataFrame, events: DataFrame, enrollments: DataFrame) -> DataFrame:
    """Per campaign on the global surface: sent is any of six statuses, delivered four of them (or sent, if none)."""
    m = messages.groupBy("campaign_id").agg(F.count_if(F.col("status").isin(*SIX)).alias("sent"), F.count_if(F.col("status").isin("delivered", "opened", "clicked", "replied")).alias("delivered_raw"))
    e = events.groupBy("campaign_id").agg(F.count_if(is_event("opened")).alias("opened"), F.count_if(is_event("clicked")).alias("clicked"), F.count_if(is_event("replied")).alias("reply_events"), F.count_if(is_event("bounced")).alias("bounced"))
    n = enrollments.groupBy("campaign_id").agg(F.count_if(F.col("status") == "replied").alias("replied_enrollments"), F.count(F.lit(1)).alias("enrolled"))
    out = n.join(m, "campaign_id", "left").join(e, "campaign_id", "left").na.fill(0)
    out = out.withColumns({"delivered": F.when((F.col("delivered_raw") == 0) & (F.col("sent") > 0), F.col("sent")).otherwise(F.col("delivered_raw")), "replies": F.greatest("reply_events", "replied_enrollments")})
    return out.withColumn("reply_rate", F.coalesce(rate(F.col("replies"), F.col("sent"), clamp=False), F.lit(0.0))).select("campaign_id", "enrolled", "sent", "delivered", "opened", "clicked", "replies", "bounced", "reply_rate")


def a07_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return global_overview(views.message(spark, sf_dir), views.event(spark, sf_dir), views.enrollment(spark, sf_dir))


def bulk(messages: DataFrame, events: DataFrame, enrollments: DataFrame) -> DataFrame:
    """Per campaign on the bulk surface: uniques are contacts, from plain event names and message statuses together; bounces are enrollments."""
    sent = F.col("status").isin("sent", "delivered", "opened", "clicked", "replied")
    m = messages.groupBy("campaign_id").agg(F.count_if(sent).alias("sent"), F.count_if(F.col("status") == "failed").alias("failed"))
    n = enrollments.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("recipients"), F.count_if(F.col("status") == "bounced").alias("hard_bounces"), F.count_if(F.col("status") == "soft_bounced").alias("soft_bounces"), F.count_if(F.col("status") == "unsubscribed").alias("unsubscribes"))
    kinds = ("opened", "clicked", "replied")
    people = events.where(F.col("event_type").isin(*kinds)).select("campaign_id", "contact_id", F.col("event_type").alias("kind")).unionByName(messages.where(F.col("status").isin(*kinds)).select("campaign_id", "contact_id", F.col("status").alias("kind")))
    u = people.groupBy("campaign_id").agg(*[_distinct("contact_id", F.col("kind") == k).alias(f"unique_{k}") for k in kinds])
    return bulk_rates(n.join(m, "campaign_id", "left").join(u, "campaign_id", "left").na.fill(0))


def bulk_rates(joined: DataFrame) -> DataFrame:
    """The bulk surface's columns, from its totals and unique contacts."""
    out = joined.withColumn("delivered", F.greatest(F.lit(0), F.col("sent") - F.col("hard_bounces")))
    for k in ("opened", "clicked", "replied"):
        out = out.withColumn(f"{k}_rate", F.coalesce(rate(F.col(f"unique_{k}"), F.col("delivered"), clamp=False), F.lit(0.0)))
    return out


def a08_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bulk(views.message(spark, sf_dir), views.event(spark, sf_dir), views.enrollment(spark, sf_dir))


def a09_bulk_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bulk list's card; what it shows as unique opens is a total, named so here."""
    m = views.message(spark, sf_dir).groupBy("campaign_id").agg(F.count_if(F.col("status").isin("sent", "delivered", "opened", "clicked", "replied")).alias("sent"), F.count_if(F.col("status").isin("delivered", "opened", "clicked", "replied")).alias("delivered"), F.count_if(F.col("status") == "bounced").alias("bounces"))
    e = views.event(spark, sf_dir).groupBy("campaign_id").agg(F.count_if(F.col("event_type") == "opened").alias("total_opens"), F.count_if(F.col("event_type") == "unsubscribed").alias("unsubscribes"))
    return m.join(e, "campaign_id", "left").na.fill(0)


def campaign_card(messages: DataFrame, events: DataFrame, enrollments: DataFrame) -> DataFrame:
    """Per campaign: dispatched is one of six statuses or a send time without a failed, draft or pending status; unique by enrollment, else recipient."""
    dispatched = F.col("status").isin(*SIX) | (F.col("sent_at").isNotNull() & ~F.col("status").isin("failed", "draft", "pending"))
    m = messages.groupBy("campaign_id").agg(F.count_if(dispatched).alias("sent"), F.count_distinct(F.when(dispatched, F.coalesce("enrollment_id", F.lower("to_email")))).alias("unique_sent"))
    n = enrollments.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("enrolled"), F.count_if(F.col("status") == "replied").alias("replied"))
    e = events.groupBy("campaign_id").agg(F.count_if(is_event("replied")).alias("reply_events"))
    out = n.join(m, "campaign_id", "left").join(e, "campaign_id", "left").na.fill(0).withColumn("replies", F.greatest("replied", "reply_events"))
    percent = F.when(F.col("unique_sent") > 0, F.least(F.lit(100), F.round(100.0 * F.col("replies") / F.nullif(F.col("unique_sent"), F.lit(0))).cast("int"))).otherwise(0)
    return out.select("campaign_id", "enrolled", "sent", "unique_sent", "replies", percent.alias("reply_rate"))


def a10_campaign_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaign_card(views.message(spark, sf_dir), views.event(spark, sf_dir), views.enrollment(spark, sf_dir))


def mailboxes(messages: DataFrame, events: DataFrame) -> DataFrame:
    """Per sender (case-folded): totals as the larger of message and event counts, rates of all sent, health from 70 to 100."""
    box = F.lower(F.trim("from_email"))
    m = messages.groupBy(box.alias("mailbox")).agg(F.count_if(F.col("status").isin("sent", "delivered", "opened", "clicked", "replied")).alias("sent"), *[F.count_if(F.col("status") == k).alias(f"m_{k}") for k in ("bounced", "opened", "clicked", "replied")])
    tied = events.select("message_id", "event_type").join(messages.select(F.col("id").alias("message_id"), box.alias("mailbox")), "message_id")
    e = tied.groupBy("mailbox").agg(*[F.count_if(is_event(k, upper=True)).alias(f"e_{k}") for k in ("opened", "clicked", "replied")])
    out = m.join(e, "mailbox", "left").na.fill(0)
    for k in ("opened", "clicked", "replied"):
        out = out.withColumn(k, F.greatest(f"m_{k}", f"e_{k}")).withColumn(f"{k}_rate", F.coalesce(rate(F.col(k), F.col("sent"), clamp=False), F.lit(0.0)))
    bounce = F.coalesce(100.0 * F.col("m_bounced") / F.nullif(F.col("sent"), F.lit(0)), F.lit(0.0))
    return out.withColumns({"bounced": F.col("m_bounced"), "delivered": F.greatest(F.lit(0), F.col("sent") - F.col("m_bounced")), "bounce_rate": F.round(bounce, 1), "health": F.greatest(F.lit(70), F.round(100 - 5 * bounce).cast("int"))}).select("mailbox", "sent", "delivered", "bounced", "opened", "clicked", "replied", "opened_rate", "clicked_rate", "replied_rate", "bounce_rate", "health")


def a11_mailbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mailboxes(views.message(spark, sf_dir), views.event(spark, sf_dir))


def a12_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the dashboard's head, one row per tenant: contacts, enrolled, active, messages sent, replies."""
    contacts = views.contact(spark, sf_dir).select(F.col("id").alias("contact_id"), "user_id")
    c = contacts.groupBy("user_id").agg(F.count(F.lit(1)).alias("contacts"))
    n = views.enrollment(spark, sf_dir).join(contacts, "contact_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("enrollments"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "replied").alias("replied"))
    m = views.message(spark, sf_dir).join(contacts, "contact_id").groupBy("user_id").agg(F.count_if(F.col("status").isin(*SIX)).alias("sent"))
    return c.join(n, "user_id", "left").join(m, "user_id", "left").na.fill(0)


def a14_mailbox_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrollments in progress for each mailbox of the pool, zero for idle ones."""
    pool = spark.range(views.MAILBOXES + 2).select(F.concat(F.lit("Mailbox"), "id", F.lit("@sender.example")).alias("mailbox"))
    busy = views.enrollment(spark, sf_dir).where(F.col("status").isin("active", "pending")).groupBy(F.concat(F.lit("Mailbox"), (F.col("contact_id") + F.col("campaign_id")) % views.MAILBOXES, F.lit("@sender.example")).alias("mailbox")).agg(F.count(F.lit(1)).alias("assigned"))
    return pool.join(busy, "mailbox", "left").na.fill(0, ["assigned"])


def a15_ai_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model usage by provider (its _USER or _PLATFORM ending folded) and status, with token sums; turns stand for calls."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'assistant'")
    provider = F.concat(F.when(F.col("conv_id") % 3 == 0, "ALPHA").otherwise("BETA"), F.when(F.col("turn") % 4 == 1, "_USER").when(F.col("turn") % 4 == 3, "_PLATFORM").otherwise(""))
    used = t.select(F.regexp_replace(provider, "_(USER|PLATFORM)$", "").alias("provider"), F.when(F.col("conv_id") % 7 == 0, "FAILED").otherwise("SUCCESS").alias("status"), F.length("text").cast("long").alias("tokens"))
    return used.groupBy("provider", "status").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("total_tokens"))


def contact_timeline(messages: DataFrame, events: DataFrame) -> DataFrame:
    """Messages and events of each enrollment in one feed with a running number by time (message before event, then id)."""
    from pyspark.sql import Window

    sent = messages.where("enrollment_id is not null and sent_at is not null").select("enrollment_id", F.lit(0).alias("feed"), "id", F.concat(F.lit("message:"), "status").alias("what"), F.col("sent_at").alias("happened_at"))
    seen = events.where("enrollment_id is not null").select("enrollment_id", F.lit(1).alias("feed"), "id", F.concat(F.lit("event:"), "event_type").alias("what"), F.col("event_at").alias("happened_at"))
    both = sent.unionByName(seen)
    return both.withColumn("place", F.row_number().over(Window.partitionBy("enrollment_id").orderBy("happened_at", "feed", "id"))).drop("feed")


def w07_contact_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contact_timeline(views.message(spark, sf_dir), views.event(spark, sf_dir))


QUERIES = {f.__name__: f for f in (a01_overview, a02_funnel, a03_timeline, a04_steps, a05_links, a06_contact_engagement, p14_segments, a07_global, a08_bulk, a09_bulk_card, a10_campaign_card, a11_mailbox, a12_dashboard, a14_mailbox_load, a15_ai_usage, w07_contact_timeline)}

_FACTS = "message event enrollment"
_ENGAGED = """
e AS (SELECT enrollment_id AS id, """ + ", ".join(f"count(*) FILTER (WHERE event_type IN ('{k}', 'email.{k}')) AS {k}_n, min(event_at) FILTER (WHERE event_type IN ('{k}', 'email.{k}')) AS first_{k}_at, max(event_at) FILTER (WHERE event_type IN ('{k}', 'email.{k}')) AS last_{k}_at" for k in ("opened", "clicked", "replied")) + """
  FROM event WHERE enrollment_id IS NOT NULL GROUP BY 1),
m AS (SELECT enrollment_id AS id, max(sent_at) AS last_sent_at, count(*) AS messages FROM message WHERE enrollment_id IS NOT NULL GROUP BY 1),
j AS (SELECT n.id, campaign_id, contact_id, current_step, status, coalesce(opened_n, 0) AS opened_count, first_opened_at, last_opened_at, coalesce(clicked_n, 0) AS clicked_count, first_clicked_at, last_clicked_at,
  greatest(coalesce(replied_n, 0), CASE WHEN status = 'replied' THEN 1 ELSE 0 END) AS replied_count, first_replied_at, last_replied_at, last_sent_at, coalesce(messages, 0) AS messages
  FROM enrollment n LEFT JOIN e ON n.id = e.id LEFT JOIN m ON n.id = m.id),
engaged AS (SELECT * EXCLUDE (messages), CASE WHEN status = 'bounced' THEN 'BOUNCED' WHEN status = 'unsubscribed' THEN 'UNSUBSCRIBED' WHEN replied_count > 0 THEN 'REPLIED' WHEN clicked_count > 0 THEN 'CLICKED'
    WHEN opened_count > 0 THEN 'OPENED' WHEN last_sent_at IS NOT NULL OR messages > 0 THEN 'SENT' ELSE 'NOT_SENT' END AS engagement_status,
  greatest(last_sent_at, last_opened_at, last_clicked_at, last_replied_at) AS last_activity_at FROM j)
"""
_RATE = lambda part, whole, name: f"coalesce(round(100.0 * {part} / nullif({whole}, 0), 1), 0)::DOUBLE AS {name}"
_KIND = lambda k: f"event_type IN ('{k}', 'email.{k}')"

ORACLES = {
    "a01_overview": with_views(_FACTS, "WITH " + OVERVIEW_SQL + " SELECT * FROM overview"),
    "a02_funnel": with_views(_FACTS, "WITH " + OVERVIEW_SQL + """
SELECT campaign_id, 1 AS stage_no, 'Sent' AS stage, unique_sent AS people, 100.0::DOUBLE AS percent_of_sent, 0.0::DOUBLE AS drop_off FROM overview
""" + "".join(f"""UNION ALL SELECT campaign_id, {i}, '{name}', {count}, coalesce(round(100.0 * {count} / nullif(unique_sent, 0), 1), 0)::DOUBLE, greatest(0, coalesce(round(100.0 * ({before} - {count}) / nullif({before}, 0), 1), 0))::DOUBLE FROM overview
""" for i, name, count, before in ((2, "Delivered (Inferred)", "unique_delivered", "unique_sent"), (3, "Opened", "unique_openers", "unique_delivered"), (4, "Clicked", "unique_clickers", "unique_openers"), (5, "Replied", "unique_replied", "unique_clickers")))),
    "a03_timeline": with_views("message event", f"""
SELECT campaign_id, strftime(day, '%Y-%m-%d') AS day, coalesce(sent, 0) AS sent, coalesce(sent, 0) AS delivered, coalesce(unique_opens, 0) AS unique_opens, coalesce(unique_clickers, 0) AS unique_clickers,
  coalesce(replies, 0) AS replies, coalesce(total_opens, 0) AS total_opens, coalesce(total_clicks, 0) AS total_clicks
FROM (SELECT campaign_id FROM message UNION SELECT campaign_id FROM event) c CROSS JOIN (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS day) d
LEFT JOIN (SELECT campaign_id, coalesce(sent_at, created_at)::DATE AS day, count(*) AS sent FROM message WHERE status IN ('sent', 'delivered') GROUP BY ALL) s USING (campaign_id, day)
LEFT JOIN (SELECT campaign_id, event_at::DATE AS day, count(DISTINCT enrollment_id) FILTER (WHERE {_KIND('opened')}) AS unique_opens, count(DISTINCT enrollment_id) FILTER (WHERE {_KIND('clicked')}) AS unique_clickers,
  count(DISTINCT enrollment_id) FILTER (WHERE {_KIND('replied')}) AS replies, count(*) FILTER (WHERE {_KIND('opened')}) AS total_opens, count(*) FILTER (WHERE {_KIND('clicked')}) AS total_clicks FROM event GROUP BY ALL) e USING (campaign_id, day)"""),
    "a04_steps": with_views("message event", f"""WITH
counted AS (SELECT * FROM message WHERE status IN ('sent', 'delivered', 'bounced') AND step_no IS NOT NULL),
m AS (SELECT campaign_id, step_no, count(*) AS sent, count(*) FILTER (WHERE status = 'bounced') AS bounces FROM counted GROUP BY ALL),
e AS (SELECT counted.campaign_id, step_no, count(DISTINCT event.enrollment_id) FILTER (WHERE {_KIND('opened')}) AS unique_opens, count(*) FILTER (WHERE {_KIND('opened')}) AS total_opens,
  count(DISTINCT event.enrollment_id) FILTER (WHERE {_KIND('clicked')}) AS unique_clicks, count(*) FILTER (WHERE {_KIND('clicked')}) AS total_clicks, count(DISTINCT event.enrollment_id) FILTER (WHERE {_KIND('replied')}) AS replies
  FROM event JOIN counted ON event.message_id = counted.id GROUP BY ALL),
j AS (SELECT campaign_id, step_no, coalesce(sent, 0) AS sent, coalesce(bounces, 0) AS bounces, coalesce(unique_opens, 0) AS unique_opens, coalesce(total_opens, 0) AS total_opens, coalesce(unique_clicks, 0) AS unique_clicks,
  coalesce(total_clicks, 0) AS total_clicks, coalesce(replies, 0) AS replies, greatest(0, coalesce(sent, 0) - coalesce(bounces, 0)) AS delivered
  FROM (SELECT DISTINCT campaign_id FROM message) c CROSS JOIN (SELECT unnest([1, 2, 3])::BIGINT AS step_no) s LEFT JOIN m USING (campaign_id, step_no) LEFT JOIN e USING (campaign_id, step_no))
SELECT *, round(100.0 * unique_opens / nullif(delivered, 0), 1)::DOUBLE AS unique_open_rate, round(100.0 * unique_clicks / nullif(delivered, 0), 1)::DOUBLE AS unique_click_rate, round(100.0 * replies / nullif(delivered, 0), 1)::DOUBLE AS reply_rate FROM j"""),
    "a05_links": with_views("link event message", f"""
SELECT destination_url, total_clicks, coalesce(unique_clickers, 0) AS unique_clickers, first_clicked_at, last_clicked_at
FROM (SELECT destination_url, sum(click_count)::BIGINT AS total_clicks FROM link GROUP BY 1) c
LEFT JOIN (SELECT destination_url, count(DISTINCT coalesce(event.enrollment_id, event.contact_id::VARCHAR, to_email, 'unknown')) AS unique_clickers, min(event_at) AS first_clicked_at, max(event_at) AS last_clicked_at
  FROM event JOIN link USING (message_id, link_no) LEFT JOIN message ON message.id = event.message_id WHERE {_KIND('clicked')} GROUP BY 1) s USING (destination_url)"""),
    "a06_contact_engagement": with_views(_FACTS, "WITH " + _ENGAGED + " SELECT * FROM engaged"),
    "p14_segments": with_views(_FACTS, "WITH " + _ENGAGED + """
SELECT segment, count(*) AS people FROM (SELECT unnest(list_filter(['ALL', CASE WHEN opened_count > 0 THEN 'OPENED' END, CASE WHEN opened_count = 0 AND engagement_status = 'SENT' THEN 'NOT_OPENED' END,
  CASE WHEN clicked_count > 0 THEN 'CLICKED' END, CASE WHEN replied_count > 0 THEN 'REPLIED' END, CASE WHEN engagement_status IN ('BOUNCED', 'UNSUBSCRIBED') THEN engagement_status END,
  CASE WHEN clicked_count > 0 OR replied_count > 0 THEN 'HIGH_ENGAGEMENT' END, CASE WHEN engagement_status = 'SENT' AND opened_count = 0 THEN 'NO_ENGAGEMENT' END], lambda x: x IS NOT NULL)) AS segment FROM engaged) GROUP BY 1"""),
    "a07_global": with_views(_FACTS, f"""
SELECT campaign_id, enrolled, sent, CASE WHEN raw = 0 AND sent > 0 THEN sent ELSE raw END AS delivered, opened, clicked, greatest(r, replied) AS replies, bounced, {_RATE('greatest(r, replied)', 'sent', 'reply_rate')}
FROM (SELECT campaign_id, count(*) AS enrolled, count(*) FILTER (WHERE status = 'replied') AS replied FROM enrollment GROUP BY 1)
LEFT JOIN (SELECT campaign_id, count(*) FILTER (WHERE status IN ('sent', 'delivered', 'opened', 'clicked', 'replied', 'bounced')) AS sent, count(*) FILTER (WHERE status IN ('delivered', 'opened', 'clicked', 'replied')) AS raw FROM message GROUP BY 1) USING (campaign_id)
LEFT JOIN (SELECT campaign_id, count(*) FILTER (WHERE {_KIND('opened')}) AS opened, count(*) FILTER (WHERE {_KIND('clicked')}) AS clicked, count(*) FILTER (WHERE {_KIND('replied')}) AS r, count(*) FILTER (WHERE {_KIND('bounced')}) AS bounced FROM event GROUP BY 1) USING (campaign_id)"""),
    "a08_bulk": with_views(_FACTS, f"""
SELECT *, {_RATE('unique_opened', 'delivered', 'opened_rate')}, {_RATE('unique_clicked', 'delivered', 'clicked_rate')}, {_RATE('unique_replied', 'delivered', 'replied_rate')}
FROM (SELECT campaign_id, recipients, hard_bounces, soft_bounces, unsubscribes, sent, failed, unique_opened, unique_clicked, unique_replied, greatest(0, sent - hard_bounces) AS delivered
FROM (SELECT campaign_id, count(*) AS recipients, count(*) FILTER (WHERE status = 'bounced') AS hard_bounces, count(*) FILTER (WHERE status = 'soft_bounced') AS soft_bounces, count(*) FILTER (WHERE status = 'unsubscribed') AS unsubscribes FROM enrollment GROUP BY 1)
LEFT JOIN (SELECT campaign_id, count(*) FILTER (WHERE status IN ('sent', 'delivered', 'opened', 'clicked', 'replied')) AS sent, count(*) FILTER (WHERE status = 'failed') AS failed FROM message GROUP BY 1) USING (campaign_id)
LEFT JOIN (SELECT campaign_id, count(DISTINCT contact_id) FILTER (WHERE k = 'opened') AS unique_opened, count(DISTINCT contact_id) FILTER (WHERE k = 'clicked') AS unique_clicked, count(DISTINCT contact_id) FILTER (WHERE k = 'replied') AS unique_replied
  FROM (SELECT campaign_id, contact_id, event_type AS k FROM event UNION ALL SELECT campaign_id, contact_id, status FROM message) GROUP BY 1) USING (campaign_id))"""),
    "a09_bulk_card": with_views("message event", """
SELECT * FROM (SELECT campaign_id, count(*) FILTER (WHERE status IN ('sent', 'delivered', 'opened', 'clicked', 'replied')) AS sent, count(*) FILTER (WHERE status IN ('delivered', 'opened', 'clicked', 'replied')) AS delivered, count(*) FILTER (WHERE status = 'bounced') AS bounces FROM message GROUP BY 1)
LEFT JOIN (SELECT campaign_id, count(*) FILTER (WHERE event_type = 'opened') AS total_opens, count(*) FILTER (WHERE event_type = 'unsubscribed') AS unsubscribes FROM event GROUP BY 1) USING (campaign_id)"""),
    "a10_campaign_card": with_views(_FACTS, f"""
SELECT campaign_id, enrolled, sent, unique_sent, greatest(replied, r) AS replies, CASE WHEN unique_sent > 0 THEN least(100, round(100.0 * greatest(replied, r) / unique_sent)::INTEGER) ELSE 0 END AS reply_rate
FROM (SELECT campaign_id, count(*) AS enrolled, count(*) FILTER (WHERE status = 'replied') AS replied FROM enrollment GROUP BY 1)
LEFT JOIN (SELECT campaign_id, count(*) AS sent, count(DISTINCT coalesce(enrollment_id, lower(to_email))) AS unique_sent FROM message
  WHERE status IN ('sent', 'delivered', 'opened', 'clicked', 'replied', 'bounced') OR (sent_at IS NOT NULL AND status NOT IN ('failed', 'draft', 'pending')) GROUP BY 1) USING (campaign_id)
LEFT JOIN (SELECT campaign_id, count(*) FILTER (WHERE {_KIND('replied')}) AS r FROM event GROUP BY 1) USING (campaign_id)"""),
    "a11_mailbox": with_views("message event", """WITH
m AS (SELECT lower(trim(from_email)) AS mailbox, count(*) FILTER (WHERE status IN ('sent', 'delivered', 'opened', 'clicked', 'replied')) AS sent, count(*) FILTER (WHERE status = 'bounced') AS bounced,
  count(*) FILTER (WHERE status = 'opened') AS mo, count(*) FILTER (WHERE status = 'clicked') AS mc, count(*) FILTER (WHERE status = 'replied') AS mr FROM message GROUP BY 1),
e AS (SELECT lower(trim(from_email)) AS mailbox, count(*) FILTER (WHERE event_type IN ('opened', 'email.opened', 'OPENED')) AS eo, count(*) FILTER (WHERE event_type IN ('clicked', 'email.clicked', 'CLICKED')) AS ec,
  count(*) FILTER (WHERE event_type IN ('replied', 'email.replied', 'REPLIED')) AS er FROM event JOIN message ON message.id = event.message_id GROUP BY 1),
j AS (SELECT mailbox, sent, greatest(0, sent - bounced) AS delivered, bounced, greatest(mo, coalesce(eo, 0)) AS opened, greatest(mc, coalesce(ec, 0)) AS clicked, greatest(mr, coalesce(er, 0)) AS replied FROM m LEFT JOIN e USING (mailbox))
SELECT *, """ + ", ".join(_RATE(k, "sent", f"{k}_rate") for k in ("opened", "clicked", "replied")) + """, coalesce(round(100.0 * bounced / nullif(sent, 0), 1), 0)::DOUBLE AS bounce_rate,
  greatest(70, round(100 - 5 * coalesce(100.0 * bounced / nullif(sent, 0), 0))::INTEGER) AS health FROM j"""),
    "a12_dashboard": with_views("contact enrollment message", """
SELECT user_id, contacts, coalesce(enrollments, 0) AS enrollments, coalesce(active, 0) AS active, coalesce(replied, 0) AS replied, coalesce(sent, 0) AS sent
FROM (SELECT user_id, count(*) AS contacts FROM contact GROUP BY 1)
LEFT JOIN (SELECT user_id, count(*) AS enrollments, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'replied') AS replied FROM enrollment JOIN contact ON contact.id = contact_id GROUP BY 1) USING (user_id)
LEFT JOIN (SELECT user_id, count(*) FILTER (WHERE status IN ('sent', 'delivered', 'opened', 'clicked', 'replied', 'bounced')) AS sent FROM message JOIN contact ON contact.id = contact_id GROUP BY 1) USING (user_id)"""),
    "a14_mailbox_load": with_views("enrollment", """
SELECT mailbox, coalesce(n, 0) AS assigned FROM (SELECT 'Mailbox' || unnest(range(9)) || '@sender.example' AS mailbox)
LEFT JOIN (SELECT 'Mailbox' || ((contact_id + campaign_id) % 7) || '@sender.example' AS mailbox, count(*) AS n FROM enrollment WHERE status IN ('active', 'pending') GROUP BY 1) USING (mailbox)"""),
    "a15_ai_usage": """
SELECT regexp_replace((CASE WHEN conv_id % 3 = 0 THEN 'ALPHA' ELSE 'BETA' END) || (CASE turn % 4 WHEN 1 THEN '_USER' WHEN 3 THEN '_PLATFORM' ELSE '' END), '_(USER|PLATFORM)$', '') AS provider,
  CASE WHEN conv_id % 7 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status, count(*) AS calls, sum(length(text))::BIGINT AS total_tokens
FROM conversations WHERE role = 'assistant' GROUP BY 1, 2""",
    "w07_contact_timeline": with_views("message event", """
SELECT enrollment_id, id, what , happened_at, row_number() OVER (PARTITION BY enrollment_id ORDER BY happened_at, feed, id)::INTEGER AS place FROM (
  SELECT enrollment_id, 0 AS feed, id, 'message:' || status AS what, sent_at AS happened_at FROM message WHERE enrollment_id IS NOT NULL AND sent_at IS NOT NULL
  UNION ALL SELECT enrollment_id, 1, id, 'event:' || event_type, event_at FROM event WHERE enrollment_id IS NOT NULL)"""),
}
