"""Inbound mail and event handling: reply correlation, duplicates, bounces, inbox tabs; streams over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlspike import streaming, views
from marlspike.functions import text as X
from marlspike.views import with_views


def _streams(spark: SparkSession, sf_dir: str):
    """What views read tables through: streams of them."""

    class _Streams:
        class read:  # noqa: N801
            parquet = staticmethod(lambda path: streaming.source(spark, sf_dir, path.rsplit("/", 1)[1].removesuffix(".parquet")))

    return _Streams


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """views.event over a stream of its table."""
    return views.event(_streams(spark, sf_dir), sf_dir)


def correlate(inbound: DataFrame, sent: DataFrame) -> DataFrame:
    """inbound_id, message_id: the sent message that any form of the reply header names; primary ids before provider ids, then the latest.

    inbound: inbound_id, header. sent: message_id, internet_id, provider_id, sent_s.
    """
    asked = inbound.select("inbound_id", F.explode(X.header_ids(F.col("header"))).alias("form"))
    names = sent.select("message_id", "sent_s", F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("internet_id").alias("form")), F.struct(F.lit(1).alias("rank"), F.col("provider_id").alias("form")))).alias("n")).select("message_id", "sent_s", "n.*")
    hits = asked.join(names, "form")
    place = F.row_number().over(Window.partitionBy("inbound_id").orderBy("rank", F.desc("sent_s"), "message_id"))
    return hits.withColumn("_n", place).where("_n = 1").select("inbound_id", "message_id", "rank")


def j10_reply_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each inbound turn's header names the turn before it, in changing spellings."""
    mail = views.inbound(spark, sf_dir)
    before = F.lag("id").over(Window.partitionBy("conv_id").orderBy("turn"))
    named = F.concat(F.when(F.col("turn") % 2 == 0, "<MSG").otherwise("msg"), before, F.lit("@mail.example"), F.when(F.col("turn") % 2 == 0, ">").otherwise(""))
    asked = mail.withColumn("header", named).where("direction = 'INBOUND' and header is not null").select(F.col("id").alias("inbound_id"), "header")
    sent = mail.where("direction <> 'INBOUND'").select(F.col("id").alias("message_id"), F.concat(F.lit("<msg"), "id", F.lit("@mail.example>")).alias("internet_id"), F.concat(F.lit("msg"), F.col("id") + 1, F.lit("@mail.example")).alias("provider_id"), F.col("received_s").alias("sent_s"))
    return correlate(asked, sent)


def _mails(inbound: DataFrame) -> DataFrame:
    """Turns as mails; every fourth turn has the provider id of the one two before."""
    return inbound.select("id", F.col("conv_id").alias("sender"), F.col("direction").alias("subject"), "received_s", F.concat(F.lit("p"), F.when(F.col("turn") % 4 == 3, F.col("id") - 2).otherwise(F.col("id"))).alias("provider_id"))


def j12_interval_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.imports(_mails(views.inbound(spark, sf_dir)))


def st6_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mails that a stream imports."""
    return streaming.import_mails(_mails(views.inbound(_streams(spark, sf_dir), sf_dir)), streaming.new_folder(spark))


#: A made-up now, in the seconds of the made-up times (200 of them for each of theirs), and how far a sync looks back.
NOW_S, LOOK_BACK_S, LAST_MAILS = 3_000_000, 14 * 86_400, 50


def s09_last_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 50 mails of each mailbox within two weeks of a given time."""
    box, at = F.col("conv_id") % 5, F.col("received_s") * 200
    place = F.row_number().over(Window.partitionBy(box).orderBy(F.desc("received_s"), F.desc("id")))
    recent = views.inbound(spark, sf_dir).where(at.between(NOW_S - LOOK_BACK_S, NOW_S))
    return recent.withColumn("n", place).where(F.col("n") <= LAST_MAILS).select(box.alias("mailbox"), "id", "n")


def f18_bounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery reports made from suppliers, classified."""
    k = F.col("s_suppkey")
    sender = F.when(k % 3 == 0, "MAILER-DAEMON@mx.example").when(k % 3 == 1, "post@mx.example").otherwise("postmaster@mx.example")
    subject = F.when(k % 4 == 0, "Undelivered Mail Returned").otherwise("Hello")
    body = F.concat(F.lit("Final-Recipient: rfc822; Contact"), k, F.lit("@corp.example; "), F.when(k % 5 == 0, "status: 5.1.1 user unknown").when(k % 5 == 1, "4.2.2 mailbox full").otherwise("please wait"))
    found = X.bounce(sender, subject, body)
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k, found.alias("b")).select("s_suppkey", "b.*")


def a28_sync_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a sync for each mailbox: seen, replies, duplicates."""
    d = j12_interval_dup(spark, sf_dir)
    return d.groupBy((F.col("sender") % 5).alias("mailbox")).agg(F.count(F.lit(1)).alias("seen"), F.count_if("is_duplicate").alias("duplicates"), F.count_if((F.col("subject") == "INBOUND") & ~F.col("is_duplicate")).alias("replies"))


def st1_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider ids (two events share one) after idempotent ingestion, and which event is taken: the earliest."""
    e = _event_stream(spark, sf_dir).select(F.floor(F.col("id") / 2).alias("provider_event_id"), "event_at", "id")
    return streaming.ingest_once(e, streaming.new_folder(spark), order=("event_at", "id"))


def st2_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _event_stream(spark, sf_dir).select("id", (F.col("message_id") * 2).alias("message_id"))
    return streaming.appended(streaming.known_only(e, views.message(spark, sf_dir)))


def st3_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.with_status(streaming.summed(_event_stream(spark, sf_dir), streaming.message_state()))


def st4_hard_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.stops(streaming.summed(_event_stream(spark, sf_dir), streaming.hard_stops()))


def st4_suppressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppression rows for the addresses of bounced messages, those that are known."""
    to = views.message(spark, sf_dir).select(F.col("id").alias("message_id"), "to_email")
    return streaming.suppressed(streaming.summed(_event_stream(spark, sf_dir).join(to, "message_id"), streaming.suppressions()))


def st5_click_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _event_stream(spark, sf_dir).withColumn("message_id", F.floor(F.col("message_id") / 40))
    return streaming.summed(e, streaming.click_counts())


def st_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.summed(_event_stream(spark, sf_dir), streaming.hourly())


QUERIES = {f.__name__: f for f in (j10_reply_match, j12_interval_dup, s09_last_mails, f18_bounce, a28_sync_summary, st1_dedup, st2_known, st3_status, st4_hard_stop, st4_suppressions, st5_click_count, st6_imports, st_hourly)}

# one mail after the other: what was imported so far decides
_DUP = """m AS (SELECT id, conv_id AS sender, direction AS subject, received_s, 'p' || CASE WHEN turn % 4 = 3 THEN id - 2 ELSE id END AS provider_id FROM inbound),
ordered AS (SELECT *, row_number() OVER (PARTITION BY sender ORDER BY received_s, id) AS k FROM m),
fold AS (SELECT *, [provider_id] AS ids, map([subject], [received_s]) AS seen, FALSE AS is_duplicate FROM ordered WHERE k = 1
  UNION ALL SELECT id, sender, subject, received_s, provider_id, k, CASE WHEN hit THEN ids ELSE list_append(ids, provider_id) END, CASE WHEN hit THEN seen ELSE map_concat(seen, map([subject], [received_s])) END, hit
  FROM (SELECT o.*, f.ids, f.seen, list_contains(f.ids, o.provider_id) OR coalesce(o.received_s - f.seen[o.subject] <= 60, FALSE) AS hit FROM fold f JOIN ordered o ON o.sender = f.sender AND o.k = f.k + 1)),
dup AS (SELECT id, sender, subject, received_s, provider_id, is_duplicate FROM fold)"""
_KIND = "replace(lower(event_type), 'email.', '')"
ORACLES = {
    "j10_reply_match": with_views("inbound", "WITH a AS (SELECT * FROM (SELECT id, direction, lag(id) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM inbound) WHERE direction = 'INBOUND' AND before IS NOT NULL), s AS (SELECT id, received_s FROM inbound WHERE direction <> 'INBOUND'), h AS (SELECT a.id AS inbound_id, s.id AS message_id, 0 AS rank, received_s FROM a JOIN s ON s.id = a.before UNION ALL SELECT a.id, s.id, 1, received_s FROM a JOIN s ON s.id + 1 = a.before) SELECT inbound_id, message_id, rank FROM h QUALIFY row_number() OVER (PARTITION BY inbound_id ORDER BY rank, received_s DESC, message_id) = 1"),
    "j12_interval_dup": with_views("inbound", f"WITH {_DUP} SELECT * FROM dup").replace("WITH", "WITH RECURSIVE", 1),
    "st6_imports": with_views("inbound", f"WITH {_DUP} SELECT id, sender, subject, received_s, provider_id FROM dup WHERE NOT is_duplicate").replace("WITH", "WITH RECURSIVE", 1),
    "s09_last_mails": with_views("inbound", f"SELECT conv_id % 5 AS mailbox, id, row_number() OVER (PARTITION BY conv_id % 5 ORDER BY received_s DESC, id DESC)::INTEGER AS n FROM inbound WHERE received_s * 200 BETWEEN {NOW_S - LOOK_BACK_S} AND {NOW_S} QUALIFY n <= {LAST_MAILS}"),
    "f18_bounce": "SELECT s_suppkey, is_bounce, CASE WHEN NOT is_bounce THEN 'unknown' WHEN s_suppkey % 5 = 0 THEN 'hard' WHEN s_suppkey % 5 = 1 THEN 'soft' ELSE 'unknown' END AS kind, CASE WHEN is_bounce THEN 'contact' || s_suppkey || '@corp.example' END AS target, CASE WHEN is_bounce AND s_suppkey % 5 = 0 THEN '5.1.1' WHEN is_bounce AND s_suppkey % 5 = 1 THEN '4.2.2' END AS code FROM (SELECT s_suppkey, s_suppkey % 3 <> 1 OR s_suppkey % 4 = 0 AS is_bounce FROM supplier)",
    "a28_sync_summary": with_views("inbound", f"WITH {_DUP} SELECT sender % 5 AS mailbox, count(*) AS seen, count(*) FILTER (WHERE is_duplicate) AS duplicates, count(*) FILTER (WHERE subject = 'INBOUND' AND NOT is_duplicate) AS replies FROM dup GROUP BY 1").replace("WITH", "WITH RECURSIVE", 1),
    "st1_dedup": "SELECT event_id // 2 AS provider_event_id, ts AS event_at, event_id AS id FROM events QUALIFY row_number() OVER (PARTITION BY event_id // 2 ORDER BY ts, event_id) = 1",
    "st2_known": with_views("message event", "SELECT event.message_id * 2 AS message_id, event.id, message.status AS sent_status FROM event JOIN message ON message.id = event.message_id * 2"),
    "st3_status": with_views("event", f"SELECT *, CASE WHEN bounced_at IS NOT NULL THEN 'bounced' WHEN replied_at IS NOT NULL THEN 'replied' WHEN clicked_at IS NOT NULL THEN 'clicked' WHEN opened_at IS NOT NULL THEN 'opened' ELSE 'sent' END AS status FROM (SELECT message_id, min(event_at) FILTER (WHERE {_KIND} = 'opened') AS opened_at, min(event_at) FILTER (WHERE {_KIND} = 'clicked') AS clicked_at, min(event_at) FILTER (WHERE {_KIND} = 'replied') AS replied_at, min(event_at) FILTER (WHERE {_KIND} = 'bounced') AS bounced_at, max(event_at) AS last_event_at, count(*) AS events FROM event GROUP BY 1)"),
    "st4_hard_stop": with_views("event", f"SELECT enrollment_id, event_at AS stopped_at, {_KIND} AS status, CASE {_KIND} WHEN 'replied' THEN 'REPLY_RECEIVED' ELSE upper({_KIND}) END AS stop_reason FROM event WHERE {_KIND} IN ('bounced', 'complained', 'replied') AND enrollment_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY enrollment_id ORDER BY event_at, {_KIND}) = 1"),
    "st4_suppressions": with_views("message event", f"SELECT to_email AS email, lower(to_email) AS normalized_email, upper({_KIND}) AS reason, 'WEBHOOK' AS source, event_at AS suppressed_at FROM event JOIN message ON message.id = event.message_id WHERE {_KIND} IN ('bounced', 'complained') AND event.contact_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(to_email) ORDER BY event_at, {_KIND}, to_email) = 1"),
    "st5_click_count": with_views("event", f"SELECT message_id // 40 AS message_id, link_no, count(*) AS clicks FROM event WHERE {_KIND} = 'clicked' GROUP BY 1, 2"),
    "st_hourly": with_views("event", f"SELECT date_trunc('hour', event_at) AS hour, {_KIND} AS kind, count(*) AS events FROM event GROUP BY 1, 2"),
}
