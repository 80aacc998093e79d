"""People by day: exact distinct counts over any span of days from bitmaps, one pass over the facts, new days without the old ones.

A fact is (campaign_id, day?, kind, person?). A dictionary gives each person of a campaign a dense number, so that a campaign of up to
32,768 people fills one slot; a day's table has one row for each campaign, day, kind and slot: how many facts, and the bitmap of who.
Bitmaps merge by OR over days and over kinds; nothing is expanded for each distinct count. A bitmap is 4 KB, mostly zeros where few
people act, which Parquet's compression takes away.

Facts without a campaign aren't taken; facts without a person count, but nobody is behind them; facts without a day (states, such as
an enrollment's status) belong to no day and count in spans without bounds alone. Facts that come twice count twice, their people once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlspike import streaming, views
from marlspike.operators import analytics as A
from marlspike.operators.mail import _event_stream as event_stream
from marlspike.plans import delete, written
from marlspike.views import with_views

EVENTS = ("opened", "clicked", "replied", "bounced", "unsubscribed")
KEY = ("campaign_id", "day", "kind", "slot")
IDS = "campaign_id long, person string, id long"
DAYS = "campaign_id long, day date, kind string, slot long, n long, bits binary"
#: Pieces in which the new people of one campaign are numbered.
PIECES = 256


def _facts(rows: DataFrame, day: Column, kinds: Mapping[str, tuple[Column, Column | None]]) -> DataFrame:
    """For each row a fact of each kind whose condition holds, with the person given there."""
    nobody = F.lit(None).cast("string")
    each = [F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(kind).alias("kind"), (nobody if person is None else person.cast("string")).alias("person"))) for kind, (condition, person) in kinds.items()]
    found = rows.select(F.col("campaign_id").cast("long").alias("campaign_id"), day.cast("date").alias("day"), F.explode(F.array_compact(F.array(*each))).alias("f"))
    return found.select("campaign_id", "day", "f.kind", "f.person")


def event_facts(events: DataFrame) -> DataFrame:
    """Five kinds of events, by enrollment; `seen` for every event."""
    who = F.col("enrollment_id")
    return _facts(events, F.col("event_at"), {"seen": (F.lit(True), None)} | {k: (A.is_event(k), who) for k in EVENTS})


def facts(messages: DataFrame, events: DataFrame, enrollments: DataFrame) -> DataFrame:
    """What the campaign surfaces count, by enrollment."""
    status, who, always = F.col("status"), F.col("enrollment_id"), F.lit(True)
    of_messages = {"seen": (always, None), "sent": (status.isin("sent", "delivered"), who), "message_bounced": (status == "bounced", who), "unknown": (status.isin("bounced", "failed", "pending"), None)}
    of_status = {"enrolled": (always, None), "started": (status.isin(*A.STARTED), None)} | {f"status_{k}": (status == k, F.col("id")) for k in ("replied", "unsubscribed")}
    m, n = _facts(messages, F.coalesce("sent_at", "created_at"), of_messages), _facts(enrollments, F.lit(None), of_status)
    return event_facts(events).unionByName(m).unionByName(n)


def contact_facts(messages: DataFrame, events: DataFrame, enrollments: DataFrame) -> DataFrame:
    """What the bulk surface counts, by contact: plain event names and message statuses together."""
    status, kind, who, kinds = F.col("status"), F.col("event_type"), F.col("contact_id"), ("opened", "clicked", "replied")
    m = _facts(messages, F.coalesce("sent_at", "created_at"), {"sent": (status.isin("sent", "delivered", *kinds), None), "failed": (status == "failed", None)} | {k: (status == k, who) for k in kinds})
    n = _facts(enrollments, F.lit(None), {"enrolled": (F.lit(True), None)} | {f"status_{k}": (status == k, None) for k in ("bounced", "soft_bounced", "unsubscribed")})
    return _facts(events, F.col("event_at"), {k: (kind == k, who) for k in kinds}).unionByName(m).unionByName(n)


class PeopleByDay:
    """The dictionary and the days of a folder. Batches have ascending numbers; the last one may be added again and replaces itself."""

    def __init__(self, spark: SparkSession, folder: str, pieces: int = PIECES):
        self.pieces = pieces
        self.ids = streaming.Parts(spark, f"{folder}/ids", IDS)
        self.days = streaming.Parts(spark, f"{folder}/days", DAYS)

    def _new(self, once: DataFrame, known: DataFrame) -> DataFrame:
        """Numbers, behind those of a campaign's known people, for people met first: within pieces by hash, one behind the other."""
        met = once.where("person is not null").select("campaign_id", "person").distinct()
        new = met.join(known, ["campaign_id", "person"], "left_anti").withColumn("piece", F.pmod(F.xxhash64("person"), F.lit(self.pieces)))
        new = new.withColumn("place", F.row_number().over(Window.partitionBy("campaign_id", "piece").orderBy("person")))
        sizes = new.groupBy("campaign_id", "piece").agg(F.count(F.lit(1)).alias("size"))
        before = Window.partitionBy("campaign_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.select("campaign_id", "piece", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
        last = known.groupBy("campaign_id").agg(F.max("id").alias("last"))
        return new.join(starts, ["campaign_id", "piece"]).join(last, "campaign_id", "left").select("campaign_id", "person", (F.coalesce("last", F.lit(0)) + F.col("start") + F.col("place")).cast("long").alias("id"))

    def add(self, rows: DataFrame, number: int) -> None:
        """Adds the facts of a batch. It reads these facts and the dictionary, no earlier days."""
        # equal facts meet first, so that a busy person is one row a day when people are looked up
        once = written(rows.where("campaign_id is not null").groupBy("campaign_id", "day", "kind", "person").agg(F.count(F.lit(1)).alias("n")), "people-facts")
        self.ids.add(self._new(once, self.ids.read(before=number)), number)
        placed = once.join(self.ids.read(before=number + 1), ["campaign_id", "person"], "left").withColumns({"slot": F.bitmap_bucket_number("id"), "position": F.bitmap_bit_position("id")})
        # a slot of a day and kind has at most 32,768 rows here; they travel as positions, not as partial bitmaps of 4 KB
        grouped = placed.repartition(*KEY).groupBy(*KEY).agg(F.sum("n").alias("n"), F.bitmap_construct_agg("position").alias("bits"))
        self.days.add(grouped.withColumn("bits", F.when(F.col("slot").isNotNull(), F.col("bits"))).select(*KEY, "n", "bits"), number)
        delete(rows.sparkSession, once.written_to)

    def read(self) -> DataFrame:
        """Rows of DAYS; several for one key until compact()."""
        return self.days.read()

    def compact(self) -> None:
        self.ids.compact()
        self.days.compact(merged)


def merged(days: DataFrame) -> DataFrame:
    """One row for each key."""
    bits = F.bitmap_or_agg("bits")
    return days.groupBy(*KEY).agg(F.sum("n").alias("n"), bits.alias("bits")).withColumn("bits", F.when(F.col("slot").isNotNull(), F.col("bits"))).select(*KEY, "n", "bits")


def measures(days: DataFrame, by: Sequence[str], people: Mapping[str, Sequence[str]], counts: Mapping[str, Sequence[str]]) -> DataFrame:
    """By group, for each name: distinct people behind any of its kinds; how many facts its kinds have."""
    of = lambda kinds, column: F.when(F.col("kind").isin(*kinds), F.col(column))
    slots = days.groupBy(*by, "slot").agg(
        *[F.bitmap_count(F.bitmap_or_agg(of(kinds, "bits"))).alias(name) for name, kinds in people.items()],
        *[F.coalesce(F.sum(of(kinds, "n")), F.lit(0)).alias(name) for name, kinds in counts.items()],
    )
    return slots.groupBy(*by).agg(*[F.sum(name).alias(name) for name in (*people, *counts)])


def overview(days: DataFrame) -> DataFrame:
    """The campaign overview, from days of facts()."""
    people = {
        "unique_sent": ("sent",), "unique_openers": ("opened",), "unique_clickers": ("clicked",), "unique_bounced": ("bounced", "message_bounced"),
        "unique_replied": ("replied", "status_replied"), "unique_unsubscribed": ("unsubscribed", "status_unsubscribed"),
    }
    counts = {
        "total_enrolled": ("enrolled",), "sequence_started": ("started",), "sent": ("sent",), "bounced_messages": ("message_bounced",), "confidence_unknown": ("unknown",),
        "total_opens": ("opened",), "total_clicks": ("clicked",), "reply_events": ("replied",),
    }
    return A.overview_rates(measures(days, ["campaign_id"], people, counts).where("total_enrolled > 0"))


def bulk(days: DataFrame) -> DataFrame:
    """The bulk surface, from days of contact_facts()."""
    kinds = ("opened", "clicked", "replied")
    counts = {"recipients": ("enrolled",), "hard_bounces": ("status_bounced",), "soft_bounces": ("status_soft_bounced",), "unsubscribes": ("status_unsubscribed",), "sent": ("sent",), "failed": ("failed",)}
    return A.bulk_rates(measures(days, ["campaign_id"], {f"unique_{k}": (k,) for k in kinds}, counts).where("recipients > 0"))


def timeline(days: DataFrame, first_day: str, n_days: int) -> DataFrame:
    """The daily series, from days of facts(): every campaign that has a message or an event, every day of the span."""
    first = F.lit(first_day).cast("date")
    last = F.date_add(first, n_days - 1)
    found = measures(
        days.where(F.col("day").between(first, last)), ["campaign_id", "day"],
        {"unique_opens": ("opened",), "unique_clickers": ("clicked",), "replies": ("replied",)}, {"sent": ("sent",), "total_opens": ("opened",), "total_clicks": ("clicked",)},
    )
    spine = days.where("kind = 'seen'").select("campaign_id").distinct().select("campaign_id", F.explode(F.sequence(first, last)).alias("day"))
    return spine.join(found, ["campaign_id", "day"], "left").na.fill(0).withColumn("delivered", F.col("sent"))


def windows(days: DataFrame, kinds: Sequence[str], first_day: str, n_days: int, width: int = 7) -> DataFrame:
    """For each campaign and kind that has a fact with a day and a person up to the span's end, and each day of the span: people of
    the day, of the width days that end with it, and since ever."""
    first = F.lit(first_day).cast("date")
    last = F.date_add(first, n_days - 1)
    group = ["campaign_id", "kind", "slot"]
    seen = days.where(F.col("kind").isin(*kinds) & F.col("slot").isNotNull() & (F.col("day") <= last))
    known = merged(seen)
    # every slot needs a row on every day of the span: its people of before are still there
    spine = seen.select(*group).distinct().select(*group, F.explode(F.sequence(first, last)).alias("day"), F.lit(None).cast("binary").alias("bits"))
    both = known.select(*group, "day", "bits", F.lit(False).alias("asked")).unionByName(spine.withColumn("asked", F.lit(True)))
    by = Window.partitionBy(*group).orderBy(F.unix_date("day"))
    frames = {"people": by.rangeBetween(0, 0), f"people_{width}_days": by.rangeBetween(1 - width, 0), "people_so_far": by.rangeBetween(Window.unboundedPreceding, 0)}
    slots = both.select(*group, "day", "asked", *[F.bitmap_count(F.bitmap_or_agg("bits").over(w)).alias(name) for name, w in frames.items()]).where("asked")
    return slots.groupBy("campaign_id", "kind", "day").agg(*[F.sum(name).alias(name) for name in frames])


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return views.message(spark, sf_dir), views.event(spark, sf_dir), views.enrollment(spark, sf_dir)


def _built(spark: SparkSession, rows: DataFrame, *turns: str) -> DataFrame:
    """Days of facts that come in turns: those before each day given, then the rest with what has no day."""
    store, after = PeopleByDay(spark, streaming.new_folder(spark)), F.lit(True)
    for number, day in enumerate(turns):
        before = F.coalesce(F.col("day") < F.lit(day).cast("date"), F.lit(False))
        store.add(rows.where(after & before), number)
        after = after & ~before
    store.add(rows.where(after), len(turns))
    return store.read()


def a01_by_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a01_overview from the days."""
    return overview(_built(spark, facts(*_tables(spark, sf_dir))))


def a02_by_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a02_funnel from the days."""
    return A.funnel(a01_by_days(spark, sf_dir))


def a03_by_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a03_timeline from days that come in two turns."""
    days = _built(spark, facts(*_tables(spark, sf_dir)), "2024-01-16")
    return timeline(days, "2024-01-01", 31).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def a08_by_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a08_bulk from the days."""
    return bulk(_built(spark, contact_facts(*_tables(spark, sf_dir))))


def a03_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People of a day, of seven days and so far, for each day of a month."""
    return windows(_built(spark, event_facts(views.event(spark, sf_dir))), EVENTS, "2024-01-01", 31).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def people_stream(events: DataFrame, shape, folder: str) -> PeopleByDay:
    """Advances the people of a folder by the events that have come since; shape makes rows of event_facts() of a batch."""
    store = PeopleByDay(events.sparkSession, f"{folder}/people")
    streaming.advance(events, folder, lambda batch, number: store.add(shape(batch), number))
    return store


def st_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People and events by campaign and kind, from events as a stream."""
    store = people_stream(event_stream(spark, sf_dir), event_facts, streaming.new_folder(spark))
    found = measures(store.read(), ["campaign_id"], {f"{k}_people": (k,) for k in EVENTS}, {f"{k}_events": (k,) for k in EVENTS})
    return found.select("campaign_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_people").alias("people"), F.col(f"{k}_events").alias("n_events")) for k in EVENTS])).alias("k")).select("campaign_id", "k.*")


QUERIES = {f.__name__: f for f in (a01_by_days, a02_by_days, a03_by_days, a08_by_days, a03_windows, st_people)}
_EVENT = "f AS (SELECT campaign_id, replace(event_type, 'email.', '') AS kind, event_at::DATE AS d, enrollment_id AS p FROM event WHERE event_type <> upper(event_type))"
ORACLES = {
    "a01_by_days": A.ORACLES["a01_overview"],
    "a02_by_days": A.ORACLES["a02_funnel"],
    "a03_by_days": A.ORACLES["a03_timeline"],
    "a08_by_days": A.ORACLES["a08_bulk"],
    "a03_windows": with_views("event", f"""WITH {_EVENT},
days AS (SELECT DATE '2024-01-01' + k::INTEGER AS day FROM (SELECT unnest(range(31)) AS k)),
spine AS (SELECT campaign_id, kind, day FROM (SELECT DISTINCT campaign_id, kind FROM f WHERE p IS NOT NULL AND d <= DATE '2024-01-31'), days)
SELECT campaign_id, kind, strftime(day, '%Y-%m-%d') AS day, count(DISTINCT p) FILTER (WHERE d = day) AS people, count(DISTINCT p) FILTER (WHERE d BETWEEN day - 6 AND day) AS people_7_days,
  count(DISTINCT p) FILTER (WHERE d <= day) AS people_so_far FROM spine JOIN f USING (campaign_id, kind) GROUP BY ALL"""),
    "st_people": with_views("event", f"""WITH {_EVENT}
SELECT campaign_id, kind, count(DISTINCT p) AS people, count(f.kind) AS n_events
FROM (SELECT DISTINCT campaign_id, k.kind FROM event, (SELECT unnest(['opened', 'clicked', 'replied', 'bounced', 'unsubscribed']) AS kind) k) LEFT JOIN f USING (campaign_id, kind) GROUP BY 1, 2"""),
}
