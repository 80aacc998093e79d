"""Calendar buckets, quotas, capacity, step progress, rotation, send plans and reservations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlspike import views
from marlspike.functions import calendar as C
from marlspike.views import with_views

STEPS = 3


def quota_counts(messages: DataFrame, now: str, zone: str) -> DataFrame:
    """Sends of each mailbox and campaign in the local hour and day of now (half-open); replied messages don't count."""
    at, tz = F.lit(now).cast("timestamp_ntz"), F.lit(zone)
    hour, day = C.hour_bounds(at, tz), C.day_bounds(at, tz)
    sent = messages.where(F.col("status").isin("sent", "delivered", "opened", "clicked", "bounced"))
    inside = lambda b: (F.col("sent_at") >= b["start"]) & (F.col("sent_at") < b["end"])
    counted = sent.where(inside(day)).select(F.lower("from_email").alias("mailbox"), "campaign_id", inside(hour).alias("in_hour"))
    m = counted.groupBy(F.lit("mailbox").alias("kind"), F.col("mailbox").alias("name")).agg(F.count(F.lit(1)).alias("today"), F.count_if("in_hour").alias("this_hour"))
    c = counted.groupBy(F.lit("campaign").alias("kind"), F.col("campaign_id").cast("string").alias("name")).agg(F.count(F.lit(1)).alias("today"), F.count_if("in_hour").alias("this_hour"))
    return m.unionByName(c)


def step_progress(messages: DataFrame, enrollments: DataFrame, steps: int = STEPS) -> DataFrame:
    """Per campaign and step: recipients to whom the step was sent, what remains, percent.

    A message with a step implies all earlier steps; one without goes to the recipient's earliest free step; an
    enrollment beyond a step, or completed, has been sent it. So what a recipient got is always the first n steps: the
    largest explicit step plus the number of unmapped messages, or what the enrollment says if that is more.
    """
    status = F.lower("status")
    sent = status.isin("sent", "delivered", "opened", "clicked", "replied", "bounced") | (F.col("sent_at").isNotNull() & ~status.isin("failed", "draft", "pending", "queued"))
    who = F.coalesce("enrollment_id", F.lower(F.trim("to_email")))
    known = F.col("step_no").between(1, steps)
    by_message = messages.where(sent).groupBy("campaign_id", who.alias("person")).agg((F.coalesce(F.max(F.when(known, F.col("step_no"))), F.lit(0)) + F.count_if(~F.coalesce(known, F.lit(False)))).alias("n"))
    by_state = enrollments.select("campaign_id", F.col("id").alias("person"), F.when(F.col("status") == "completed", F.lit(steps).cast("long")).otherwise(F.greatest(F.coalesce("current_step", F.lit(1)) - 1, F.lit(0))).alias("n"))
    reached = by_message.unionByName(by_state).groupBy("campaign_id", "person").agg(F.least(F.max("n"), F.lit(steps)).alias("n"))
    eligible = enrollments.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("eligible"))
    counts = reached.groupBy("campaign_id").agg(*[F.count_if(F.col("n") >= s).alias(f"s{s}") for s in range(1, steps + 1)])
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("step_no"), F.col(f"s{s}").alias("sent")) for s in range(1, steps + 1)]))
    flat = eligible.join(counts, "campaign_id", "left").na.fill(0).select("campaign_id", "eligible", rows.alias("r")).select("campaign_id", "eligible", "r.*")
    left = F.greatest(F.lit(0), F.col("eligible") - F.col("sent"))
    state = F.when(F.col("sent") == 0, "NOT_STARTED").when(left == 0, "COMPLETED").otherwise("IN_PROGRESS")
    return flat.select("campaign_id", "step_no", "eligible", "sent", left.alias("remaining"), C.completion(F.col("sent"), F.col("eligible")).alias("percent"), state.alias("state"))


def rotate(leads: DataFrame, mailboxes: DataFrame, group: str = "campaign_id", order: str = "id") -> DataFrame:
    """Each lead's mailbox: the least loaded one, ties by position. mailboxes: group, mailbox, position, load, room.

    Closed form: mailbox m offers slots at levels load, load + 1, ... (room of them); slot k by (level, position) takes
    the group's k-th lead. No more slots than leads are made.
    """
    wanted = leads.groupBy(group).agg(F.count(F.lit(1)).alias("_leads"))
    slots = F.least(F.col("room"), F.col("_leads")).cast("int")
    offered = mailboxes.join(wanted, group).where(slots > 0).withColumn("level", F.explode(F.sequence(F.col("load").cast("int"), F.col("load").cast("int") + slots - 1)))
    numbered = offered.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy("level", "position"))).select(group, "_k", "mailbox")
    ranked = leads.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    return ranked.join(numbered, [group, "_k"], "left").drop("_k")


def send_plan(campaigns: DataFrame) -> DataFrame:
    """Today's and the next days' queue of each campaign.

    campaigns: capacity, sent, eligible, next_allowed (array of booleans for the next three days), active. What exceeds
    today's remaining capacity rolls over to the first allowed of the next three days.
    """
    left = F.greatest(F.lit(0), F.col("capacity") - F.col("sent"))
    live = F.when(F.col("active"), F.col("eligible")).otherwise(F.lit(0))
    sendable = F.least(live, left)
    planned = F.when(F.col("active"), F.col("sent") + sendable).otherwise(F.lit(0))
    first = F.array_position("next_allowed", True)
    out = campaigns.withColumns({"remaining": left, "sendable": sendable, "rollover": live - sendable, "planned": planned})
    progress = F.when(F.col("planned") > 0, F.round(100.0 * F.col("sent") / F.nullif(F.col("planned"), F.lit(0))).cast("int")).otherwise(F.lit(0))
    return out.withColumns({"progress": progress, **{f"day_{d}": F.when(first == d, F.col("rollover")).otherwise(F.lit(0)) for d in (1, 2, 3)}})


def interleave(jobs: DataFrame, user: str, order: list[str], turn: int = 5) -> DataFrame:
    """Round robin of the users' queues, so many jobs a turn: jobs with turn and place within it."""
    n = F.row_number().over(Window.partitionBy(user).orderBy(*order)) - 1
    return jobs.withColumn("_n", n).withColumn("turn", F.floor(F.col("_n") / turn).cast("int")).withColumn("place", (F.col("_n") % turn).cast("int")).drop("_n")


def _zone() -> Column:
    return F.lit("Asia/Kolkata")


def a13_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota_counts(views.message(spark, sf_dir), "1998-03-02 06:10:00", "Asia/Kolkata")


def dt1_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by local hour of day and local date's weekday, and whether they lie within the sending window."""
    ts = F.col("event_at")
    clock = C.local(ts, _zone())
    inside = C.in_window(ts, _zone(), F.array(*[F.lit(d) for d in C.DEFAULT_DAYS]), F.lit("09:30"), F.lit("17:30:00"))
    return views.event(spark, sf_dir).groupBy(F.hour(clock).alias("local_hour"), C.day_code(clock).alias("day")).agg(F.count(F.lit(1)).alias("events"), F.count_if(inside).alias("inside"), F.min(C.day_bounds(ts, _zone())["start"]).alias("first_day_start"), F.max(C.hour_bounds(ts, _zone())["end"]).alias("last_hour_end"))


def dt5_next_send(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next send time of each event's contact: 0 to 3 allowed days later, Monday to Friday, 09:30 to 17:30."""
    days = F.array(*[F.lit(d) for d in C.DEFAULT_DAYS])
    next_at = C.next_send_time(F.col("event_at"), (F.col("id") % 4).cast("int"), days, _zone(), F.lit("09:30:00"), F.lit("17:30:00"))
    return views.event(spark, sf_dir).select("id", next_at.alias("next_at"))


def dt7_five_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.event(spark, sf_dir).groupBy(C.stored_five_minutes(F.col("event_at")).alias("bucket")).agg(F.count(F.lit(1)).alias("events"))


def t03_common_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which campaign and mailbox both may send, from their stored texts; none if either is invalid."""
    m = views.message(spark, sf_dir).select("campaign_id", F.pmod("contact_id", F.lit(views.MAILBOXES)).alias("box")).distinct()
    stored = F.when(F.col("campaign_id") == 0, '["MON","tue","Wednesday"]').when(F.col("campaign_id") == 1, "mon, fri").when(F.col("campaign_id") == 2, "SUN,XYZ").otherwise("MON,TUE,WED,THU,FRI")
    box = F.when(F.col("box") % 2 == 0, "WED,MON,SAT").otherwise('["FRI", "TUE"]')
    return m.select("campaign_id", "box", F.array_join(C.common_days(C.normalize_days(stored), C.normalize_days(box)), ",").alias("days"))


def m03_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capacity, reason and batch size for each supplier taken as a mailbox with made-up limits and use."""
    k = F.col("s_suppkey").cast("int")
    boxes = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.alias("id"), C.remaining(20 + k % 30, k * 7 % 50).alias("mh"), C.remaining(100 + k % 200, k * 13 % 300).alias("md"), C.remaining(F.when(k % 4 != 0, 60 + k % 40), k * 3 % 100).alias("ch"), C.remaining(F.when(k % 3 != 0, 400), k * 29 % 500).alias("cd"), (20 + k % 30).alias("hourly"), (k % 60).alias("minute"))
    capacity, reason = C.effective_capacity(F.col("mh"), F.col("md"), F.col("ch"), F.col("cd"))
    left = F.greatest(F.lit(1), 60 - F.col("minute"))
    return boxes.withColumns({"capacity": capacity, "skip_reason": reason}).select("id", "capacity", "skip_reason", C.batch_size(F.col("capacity"), F.col("hourly"), left, F.lit(240), F.col("id") % 10 == 0).alias("batch"))


def a25_step_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return step_progress(views.message(spark, sf_dir), views.enrollment(spark, sf_dir))


def d08_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active enrollments of each campaign over five mailboxes with given loads and room."""
    leads = views.enrollment(spark, sf_dir).where("status = 'active'").select("campaign_id", "contact_id")
    boxes = leads.select("campaign_id").distinct().withColumn("position", F.explode(F.array(*[F.lit(i) for i in range(5)])))
    boxes = boxes.select("campaign_id", "position", F.concat(F.lit("box"), "position").alias("mailbox"), (F.col("position") * 13 % 40).alias("load"), F.when(F.col("position") == 3, 25).otherwise(100_000).alias("room"))
    return rotate(leads, boxes, "campaign_id", "contact_id")


def a26_send_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.enrollment(spark, sf_dir).where("status in ('active', 'pending')").groupBy("campaign_id").agg(F.count(F.lit(1)).alias("eligible"))
    m = views.message(spark, sf_dir).where("status in ('sent', 'delivered')").groupBy("campaign_id").agg(F.pmod(F.count(F.lit(1)), F.lit(300)).alias("sent"))
    k = F.col("campaign_id")
    rows = n.join(m, "campaign_id").select("campaign_id", "eligible", "sent", (200 + k * 100).alias("capacity"), (k != 4).alias("active"), F.array(k % 2 == 0, k % 3 != 0, F.lit(True)).alias("next_allowed"))
    return send_plan(rows).drop("next_allowed")


def w08_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = views.enrollment(spark, sf_dir).where("status = 'pending'").select((F.col("contact_id") % 4).alias("user_id"), "id", "contact_id")
    return interleave(jobs, "user_id", ["contact_id", "id"])


def w10_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference header of each outbound turn: the ids of all earlier turns of its thread, in order."""
    earlier = F.collect_list("id").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    return views.inbound(spark, sf_dir).select("id", "conv_id", "direction", F.array_join(F.transform(earlier, lambda i: F.concat(F.lit("<"), i, F.lit("@mail.example>"))), " ").alias("thread_references")).where("direction = 'OUTBOUND'").drop("direction")


def w11_latest_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest turn of each conversation: direction and the first 60 characters."""
    last = F.max(F.struct("turn", "direction", F.substring("body", 1, 60).alias("preview")))
    return views.inbound(spark, sf_dir).groupBy("conv_id").agg(last.alias("l")).select("conv_id", "l.turn", "l.direction", "l.preview")


FEEDS = (("opened", 25), ("clicked", 20), ("replied", 10), ("bounced", 10))


def activity_feed(events: DataFrame, most: int = 8) -> DataFrame:
    """The newest of four feeds (25, 20, 10, 10 rows), one for each feed, campaign and 5-minute bucket; the newest of these."""
    out = None
    for feed, (kind, size) in enumerate(FEEDS):
        top = events.where(F.col("event_type").isin(kind, f"email.{kind}")).orderBy(F.desc("event_at"), F.desc("id")).limit(size).select(F.lit(feed).alias("feed"), F.lit(kind).alias("kind"), "campaign_id", "id", "event_at")
        out = top if out is None else out.unionByName(top)
    first = F.row_number().over(Window.partitionBy("feed", "campaign_id", C.stored_five_minutes(F.col("event_at"))).orderBy(F.desc("event_at"), F.desc("id")))
    return out.withColumn("_n", first).where("_n = 1").orderBy(F.desc("event_at"), "feed", F.desc("id")).limit(most).select("kind", "campaign_id", "id", "event_at")


def recent_activity(events: DataFrame, today: str) -> DataFrame:
    """Today's activity, or that of all time where today has none."""
    own = activity_feed(events.where(F.col("event_at") >= F.lit(today).cast("timestamp_ntz")))
    none = own.agg(F.count(F.lit(1)).alias("_there"))
    return own.unionByName(activity_feed(events).join(F.broadcast(none), F.col("_there") == 0).drop("_there"))


def o03_activity_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feeds of a day with activity and of one without."""
    e = views.event(spark, sf_dir)
    return recent_activity(e, "2024-01-30").withColumn("asked", F.lit("2024-01-30")).unionByName(recent_activity(e, "2024-03-01").withColumn("asked", F.lit("2024-03-01")))


def d11_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do with a message that already exists for a plan: by status and age in minutes at a given time."""
    age = F.col("contact_id") * 7 % 2000
    action = F.when(F.col("status").isin("sent", "delivered", "opened", "clicked", "replied", "bounced"), "ADVANCE").when(F.col("status").isin("pending", "queued") & (age < 10), "IN_FLIGHT").when(F.col("status").isin("pending", "queued"), "STALE_RETRY").when((F.col("status") == "failed") & (age >= 24 * 60), "RETRY").when(F.col("status") == "failed", "WAIT").otherwise("SKIP")
    return views.message(spark, sf_dir).groupBy("status", action.alias("action")).agg(F.count(F.lit(1)).alias("messages"))


def d10_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an enrollment may still be mailed: the first reason that holds, null if none."""
    n = views.enrollment(spark, sf_dir)
    c = views.contact(spark, sf_dir).select(F.col("id").alias("contact_id"), "do_not_contact")
    flag = lambda df, name: df.distinct().withColumn(name, F.lit(True))
    suppressed = views.contact_email(spark, sf_dir).join(views.suppression(spark, sf_dir), "normalized_email", "left_semi").select("contact_id")
    replied = views.event(spark, sf_dir).where("event_type in ('replied', 'email.replied', 'REPLIED')").select("contact_id")
    bounced = views.message(spark, sf_dir).where("status = 'bounced'").select("campaign_id", "contact_id")
    joined = n.join(c, "contact_id", "left").join(flag(suppressed, "suppressed"), "contact_id", "left").join(flag(replied, "replied"), "contact_id", "left").join(flag(bounced, "bounced"), ["campaign_id", "contact_id"], "left")
    reason = F.when(F.col("status").isin("replied", "bounced", "soft_bounced", "unsubscribed", "stopped", "completed"), F.concat(F.lit("status:"), "status")).when(F.coalesce("do_not_contact", F.lit(False)), "do_not_contact").when(F.col("suppressed"), "suppressed").when(F.col("replied"), "replied").when(F.col("bounced"), "bounced")
    return joined.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("enrollments"))


QUERIES = {f.__name__: f for f in (a13_quota, dt1_buckets, dt5_next_send, dt7_five_minutes, t03_common_days, m03_capacity, a25_step_progress, d08_rotation, a26_send_plan, w08_round_robin, w10_references, w11_latest_preview, o03_activity_feed, d11_reconcile, d10_stop)}

_K = "s_suppkey::INTEGER"
_MINUTES = "INTERVAL 330 MINUTE"
_COUNTED = "status IN ('sent', 'delivered', 'opened', 'clicked', 'bounced') AND sent_at >= TIMESTAMP '1998-03-01 18:30:00' AND sent_at < TIMESTAMP '1998-03-02 18:30:00'"
_HOUR = "count(*) FILTER (WHERE sent_at >= TIMESTAMP '1998-03-02 05:30:00' AND sent_at < TIMESTAMP '1998-03-02 06:30:00') AS this_hour"
_DAYS = lambda x: f"(CASE {x} WHEN 0 THEN ['MON', 'TUE', 'WED'] WHEN 1 THEN ['MON', 'FRI'] WHEN 2 THEN [] ELSE ['MON', 'TUE', 'WED', 'THU', 'FRI'] END)"
ORACLES = {
    "a13_quota": with_views("message", f"SELECT 'mailbox' AS kind, lower(from_email) AS name, count(*) AS today, {_HOUR} FROM message WHERE {_COUNTED} GROUP BY 2 UNION ALL SELECT 'campaign', campaign_id::VARCHAR, count(*), {_HOUR} FROM message WHERE {_COUNTED} GROUP BY 2"),
    "dt1_buckets": with_views("event", f"""SELECT hour(event_at + {_MINUTES})::INTEGER AS local_hour, upper(strftime(event_at + {_MINUTES}, '%a')) AS day, count(*) AS events,
  count(*) FILTER (WHERE dayofweek(event_at + {_MINUTES}) BETWEEN 1 AND 5 AND strftime(event_at + {_MINUTES}, '%H:%M:%S') BETWEEN '09:30:00' AND '17:30:00') AS inside,
  min(date_trunc('day', event_at + {_MINUTES})::TIMESTAMP - {_MINUTES}) AS first_day_start, max(date_trunc('hour', event_at + {_MINUTES}) - {_MINUTES} + INTERVAL 1 HOUR) AS last_hour_end FROM event GROUP BY 1, 2"""),
    "dt5_next_send": with_views("event", f"""WITH l AS (SELECT id, event_at + {_MINUTES} AS c, id % 4 AS d FROM event),
t AS (SELECT *, c::DATE AS today, c - date_trunc('day', c)::TIMESTAMP AS clock, strftime(c, '%H:%M:%S') AS s, list_filter(list_transform(range(1, 50), lambda i: c::DATE + i::INTEGER), lambda x: dayofweek(x) BETWEEN 1 AND 5) AS later FROM l),
r AS (SELECT *, CASE WHEN d > 0 THEN later[d] WHEN dayofweek(today) IN (0, 6) THEN later[1] ELSE today END AS day, later[d + 1] AS following, d = 0 AND dayofweek(today) IN (0, 6) AS off FROM t)
SELECT id, CASE WHEN off OR s < '09:30:00' THEN day + INTERVAL '9 hours 30 minutes' WHEN s > '17:30:00' THEN following + INTERVAL '9 hours 30 minutes' ELSE day + clock END - {_MINUTES} AS next_at FROM r"""),
    "dt7_five_minutes": with_views("event", "SELECT epoch_ms(event_at) // 300000 AS bucket, count(*) AS events FROM event GROUP BY 1"),
    "t03_common_days": with_views("message", f"SELECT campaign_id, box, array_to_string(list_filter({_DAYS('campaign_id')}, lambda x: list_contains(CASE WHEN box % 2 = 0 THEN ['MON', 'WED', 'SAT'] ELSE ['TUE', 'FRI'] END, x)), ',') AS days FROM (SELECT DISTINCT campaign_id, contact_id % 7 AS box FROM message)"),
    "m03_capacity": f"""WITH b AS (SELECT {_K} AS id, greatest(0, 20 + {_K} % 30 - {_K} * 7 % 50) AS mh, greatest(0, 100 + {_K} % 200 - {_K} * 13 % 300) AS md, greatest(0, CASE WHEN {_K} % 4 <> 0 THEN 60 + {_K} % 40 ELSE 999999 END - {_K} * 3 % 100) AS ch,
  greatest(0, CASE WHEN {_K} % 3 <> 0 THEN 400 ELSE 999999 END - {_K} * 29 % 500) AS cd, 20 + {_K} % 30 AS hourly, {_K} % 60 AS minute FROM supplier),
c AS (SELECT *, least(mh, md, ch, cd) AS capacity FROM b)
SELECT id, capacity, CASE WHEN mh = 0 THEN 'MAILBOX_HOURLY_LIMIT' WHEN md = 0 THEN 'MAILBOX_DAILY_LIMIT' WHEN ch = 0 THEN 'CAMPAIGN_HOURLY_LIMIT' WHEN cd = 0 THEN 'CAMPAIGN_DAILY_LIMIT' END AS skip_reason,
  CASE WHEN id % 10 = 0 THEN least(50, capacity) WHEN capacity = 0 THEN 0 ELSE least(capacity, greatest(1, least(greatest(1, least(10, ceil(hourly / 10)::INTEGER)), ceil(capacity / greatest(1, least(60 - minute, 240)))::INTEGER))) END AS batch FROM c""",
    "a25_step_progress": with_views("message enrollment", """WITH
sent AS (SELECT * FROM message WHERE status IN ('sent', 'delivered', 'opened', 'clicked', 'replied', 'bounced') OR (sent_at IS NOT NULL AND status NOT IN ('failed', 'draft', 'pending', 'queued'))),
p AS (SELECT campaign_id, coalesce(enrollment_id, lower(to_email)) AS person, coalesce(max(step_no), 0) + count(*) FILTER (WHERE step_no IS NULL) AS n FROM sent GROUP BY 1, 2
  UNION ALL SELECT campaign_id, id, CASE WHEN status = 'completed' THEN 3 ELSE current_step - 1 END FROM enrollment),
g AS (SELECT campaign_id, person, max(n) AS n FROM p GROUP BY 1, 2),
e AS (SELECT campaign_id, count(*) AS eligible FROM enrollment GROUP BY 1),
s AS (SELECT e.campaign_id, step_no::INTEGER AS step_no, eligible, (SELECT count(*) FROM g WHERE g.campaign_id = e.campaign_id AND g.n >= step_no) AS sent FROM e, (SELECT unnest([1, 2, 3]) AS step_no))
SELECT *, greatest(0, eligible - sent) AS remaining, CASE WHEN sent = 0 THEN 0 WHEN 100.0 * sent / eligible < 1 THEN round(100.0 * sent / eligible, 2) ELSE round(least(100.0, 100.0 * sent / eligible), 1) END::DOUBLE AS percent,
  CASE WHEN sent = 0 THEN 'NOT_STARTED' WHEN sent >= eligible THEN 'COMPLETED' ELSE 'IN_PROGRESS' END AS state FROM s"""),
    "d08_rotation": with_views("enrollment", """WITH l AS (SELECT campaign_id, contact_id, row_number() OVER (PARTITION BY campaign_id ORDER BY contact_id) AS k, count(*) OVER (PARTITION BY campaign_id) AS n FROM enrollment WHERE status = 'active'),
slots AS (SELECT campaign_id, 'box' || position AS mailbox, row_number() OVER (PARTITION BY campaign_id ORDER BY position * 13 % 40 + i, position) AS k
  FROM (SELECT DISTINCT campaign_id, n FROM l), (SELECT unnest(range(5)) AS position), (SELECT unnest(range(20000)) AS i) WHERE i < n AND (position <> 3 OR i < 25))
SELECT campaign_id, contact_id, mailbox FROM l LEFT JOIN slots USING (campaign_id, k)"""),
    "a26_send_plan": with_views("message enrollment", """WITH r AS (SELECT campaign_id, eligible, sent, 200 + campaign_id * 100 AS capacity, campaign_id <> 4 AS active, CASE WHEN campaign_id % 2 = 0 THEN 1 WHEN campaign_id % 3 <> 0 THEN 2 ELSE 3 END AS first
  FROM (SELECT campaign_id, count(*) AS eligible FROM enrollment WHERE status IN ('active', 'pending') GROUP BY 1) JOIN (SELECT campaign_id, count(*) % 300 AS sent FROM message WHERE status IN ('sent', 'delivered') GROUP BY 1) USING (campaign_id)),
q AS (SELECT *, greatest(0, capacity - sent) AS remaining, CASE WHEN active THEN least(eligible, greatest(0, capacity - sent)) ELSE 0 END AS sendable FROM r),
z AS (SELECT *, CASE WHEN active THEN eligible - sendable ELSE 0 END AS rollover, CASE WHEN active THEN sent + sendable ELSE 0 END AS planned FROM q)
SELECT * EXCLUDE (first), CASE WHEN planned > 0 THEN round(100.0 * sent / planned)::INTEGER ELSE 0 END AS progress, CASE WHEN first = 1 THEN rollover ELSE 0 END AS day_1, CASE WHEN first = 2 THEN rollover ELSE 0 END AS day_2, CASE WHEN first = 3 THEN rollover ELSE 0 END AS day_3 FROM z"""),
    "w08_round_robin": with_views("enrollment", "SELECT user_id, id, contact_id, (n // 5)::INTEGER AS turn, (n % 5)::INTEGER AS place FROM (SELECT contact_id % 4 AS user_id, id, contact_id, row_number() OVER (PARTITION BY contact_id % 4 ORDER BY contact_id, id) - 1 AS n FROM enrollment WHERE status = 'pending')"),
    "w10_references": with_views("inbound", "SELECT id, conv_id, coalesce((SELECT string_agg('<' || e.id || '@mail.example>', ' ' ORDER BY e.turn) FROM inbound e WHERE e.conv_id = i.conv_id AND e.turn < i.turn), '') AS thread_references FROM inbound i WHERE direction = 'OUTBOUND'"),
    "w11_latest_preview": with_views("inbound", "SELECT conv_id, turn, direction, left(body, 60) AS preview FROM inbound QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1"),
    "o03_activity_feed": with_views("event", "WITH " + ", ".join(f"k{n} AS (SELECT *, replace(event_type, 'email.', '') AS kind FROM event WHERE event_type <> upper(event_type) AND event_at >= TIMESTAMP '{since}'), t{n} AS (SELECT *, CASE kind WHEN 'opened' THEN 0 WHEN 'clicked' THEN 1 WHEN 'replied' THEN 2 ELSE 3 END AS feed FROM k{n} WHERE kind IN ('opened', 'clicked', 'replied', 'bounced') QUALIFY row_number() OVER (PARTITION BY kind ORDER BY event_at DESC, id DESC) <= CASE kind WHEN 'opened' THEN 25 WHEN 'clicked' THEN 20 ELSE 10 END), d{n} AS (SELECT * FROM t{n} QUALIFY row_number() OVER (PARTITION BY feed, campaign_id, epoch_ms(event_at) // 300000 ORDER BY event_at DESC, id DESC) = 1), f{n} AS (SELECT kind, campaign_id, id, event_at FROM d{n} ORDER BY event_at DESC, feed, id DESC LIMIT 8)" for n, since in ((0, "1970-01-01"), (1, "2024-01-30"), (2, "2024-03-01"))) + " SELECT *, '2024-01-30' AS asked FROM f1 UNION ALL SELECT *, '2024-01-30' FROM f0 WHERE NOT EXISTS (FROM f1) UNION ALL SELECT *, '2024-03-01' FROM f2 UNION ALL SELECT *, '2024-03-01' FROM f0 WHERE NOT EXISTS (FROM f2)"),
    "d11_reconcile": with_views("message", "SELECT status, CASE WHEN status IN ('sent', 'delivered', 'opened', 'clicked', 'replied', 'bounced') THEN 'ADVANCE' WHEN status IN ('pending', 'queued') THEN CASE WHEN contact_id * 7 % 2000 < 10 THEN 'IN_FLIGHT' ELSE 'STALE_RETRY' END WHEN status = 'failed' THEN CASE WHEN contact_id * 7 % 2000 >= 1440 THEN 'RETRY' ELSE 'WAIT' END ELSE 'SKIP' END AS action, count(*) AS messages FROM message GROUP BY 1, 2"),
    "d10_stop": with_views("enrollment contact contact_email suppression event message", """SELECT CASE WHEN status IN ('replied', 'bounced', 'soft_bounced', 'unsubscribed', 'stopped', 'completed') THEN 'status:' || status WHEN (SELECT do_not_contact FROM contact c WHERE c.id = n.contact_id) THEN 'do_not_contact'
  WHEN contact_id IN (SELECT contact_id FROM contact_email JOIN suppression USING (normalized_email)) THEN 'suppressed' WHEN contact_id IN (SELECT contact_id FROM event WHERE event_type IN ('replied', 'email.replied', 'REPLIED')) THEN 'replied'
  WHEN EXISTS (SELECT 1 FROM message m WHERE m.status = 'bounced' AND m.campaign_id = n.campaign_id AND m.contact_id = n.contact_id) THEN 'bounced' END AS reason, count(*) AS enrollments FROM enrollment n GROUP BY 1"""),
}
