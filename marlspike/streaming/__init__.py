"""Structured Streaming forms of the event handlers: idempotent ingestion, message state, hard stops, suppressions, counters, windows, imports of mail.

No watermark, and no state store that grows: what a stream knows is a table in a named folder beside its checkpoint.

- Sums (state of a message, stops, counters) are commutative: each micro-batch adds one immutable set of partial sums, `part=N`, and a
  reader merges them. The result is the same however the events are cut into batches and however late they come.
- Ingestion looks new rows up in the table of what was taken before, by hash bucket, and adds those that aren't there.
- A batch that is run again after a failure replaces its own part; a stream that is started again goes on from its checkpoint.
- compact() merges the parts into `base=N`; it counts as soon as it is complete, and what it replaces goes with the next compaction.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from marlspike.plans import complete, delete, shared_folder, written

#: Kinds of events that stop an enrollment, and those that suppress an address.
TERMINAL = ("bounced", "complained", "replied")
SUPPRESSING = ("bounced", "complained")
KINDS = ("opened", "clicked", "replied", "bounced")
#: Hash buckets of tables of known ids.
BUCKETS = 64


def source(spark: SparkSession, sf_dir: str, name: str, files_at_once: int | None = None) -> DataFrame:
    """A table's files as a stream, with the schema of the table: a folder of parts, or a single file."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def new_folder(spark: SparkSession) -> str:
    """A folder for a stream that nobody goes on with later."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def advance(stream: DataFrame, folder: str, take: Callable[[DataFrame, int], None]) -> None:
    """take(batch, number) for all that has come since the folder's checkpoint; it must be repeatable for one number."""
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


class Parts:
    """Rows in `base=N` and `part=N` folders: those behind the last complete base, and that base."""

    def __init__(self, spark: SparkSession, folder: str, schema):
        self.spark, self.folder, self.schema = spark, folder, schema

    def paths(self, before: int | None = None) -> list[str]:
        bases, parts = complete(self.spark, f"{self.folder}/bases"), complete(self.spark, f"{self.folder}/parts")
        upto = max((n for n in bases if before is None or n < before), default=-1)
        return [*([bases[upto]] if upto >= 0 else []), *[p for n, p in parts.items() if n > upto and (before is None or n < before)]]

    def read(self, before: int | None = None) -> DataFrame:
        """All rows, or those of batches before a number."""
        paths = self.paths(before)
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def add(self, rows: DataFrame, number: int) -> None:
        """The rows of a batch; the same number again replaces them."""
        rows.write.mode("overwrite").parquet(f"{self.folder}/parts/part={number}")

    def compact(self, merged: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
        """One base in place of all parts so far. What an earlier compaction replaced is deleted: readers of then have ended by now."""
        bases, parts = complete(self.spark, f"{self.folder}/bases"), complete(self.spark, f"{self.folder}/parts")
        upto = max([*bases, -1])
        newest = max([*parts, -1])
        if newest > upto:
            merged(self.read()).write.mode("overwrite").parquet(f"{self.folder}/bases/base={newest}")
        for n, path in parts.items():
            if n <= upto:
                delete(self.spark, path)
        for n, path in bases.items():
            if n < upto:
                delete(self.spark, path)


@dataclass(frozen=True)
class Sums:
    """Commutative sums: of the events that rows() picks and shapes, first each batch's aggregates by key, then those merged."""

    keys: tuple[str, ...]
    rows: Callable[[DataFrame], DataFrame]
    partial: dict[str, Column]
    merge: dict[str, Column]

    def of(self, events: DataFrame) -> DataFrame:
        """Partial sums of some events."""
        return self.rows(events).groupBy(*self.keys).agg(*[c.alias(n) for n, c in self.partial.items()])

    def merged(self, parts: DataFrame) -> DataFrame:
        return parts.groupBy(*self.keys).agg(*[c.alias(n) for n, c in self.merge.items()])


def _parts(stream: DataFrame, sums: Sums, folder: str) -> Parts:
    return Parts(stream.sparkSession, folder, sums.of(stream).schema)


def summed(stream: DataFrame, sums: Sums, folder: str | None = None) -> DataFrame:
    """Advances the sums in a folder by what has come since, and returns them over all that ever came."""
    folder = folder or new_folder(stream.sparkSession)
    parts = _parts(stream, sums, folder)
    advance(stream, folder, lambda batch, number: parts.add(sums.of(batch), number))
    return sums.merged(parts.read())


def compact(stream: DataFrame, sums: Sums, folder: str) -> None:
    """Merges the partial sums in a folder; between two advances."""
    _parts(stream, sums, folder).compact(sums.merged)


def plain(event_type: Column) -> Column:
    return F.lower(F.regexp_replace(event_type, r"(?i)^email\.", ""))


def _kind() -> Column:
    return plain(F.col("event_type"))


def message_state() -> Sums:
    """Per message: first open, click, reply and bounce, last event, number of events."""
    firsts = {f"{k}_at": F.min(F.when(_kind() == k, F.col("event_at"))) for k in KINDS}
    merged = {n: F.min(n) for n in firsts}
    return Sums(("message_id",), lambda events: events, firsts | {"last_event_at": F.max("event_at"), "events": F.count(F.lit(1))}, merged | {"last_event_at": F.max("last_event_at"), "events": F.sum("events")})


def hard_stops() -> Sums:
    """Per enrollment the first terminal event by event time (ties by name)."""
    ending = lambda events: events.where(_kind().isin(*TERMINAL) & F.col("enrollment_id").isNotNull())
    return Sums(("enrollment_id",), ending, {"stop": F.min(F.struct(F.col("event_at").alias("at"), _kind().alias("kind")))}, {"stop": F.min("stop")})


def suppressions() -> Sums:
    """Per address (to_email, lower-cased) the first event of a known contact that suppresses it."""
    ending = lambda events: events.where(_kind().isin(*SUPPRESSING) & F.col("contact_id").isNotNull() & F.col("to_email").isNotNull()).withColumn("normalized_email", F.lower("to_email"))
    return Sums(("normalized_email",), ending, {"first": F.min(F.struct(F.col("event_at").alias("at"), _kind().alias("kind"), "to_email"))}, {"first": F.min("first")})


def click_counts() -> Sums:
    return Sums(("message_id", "link_no"), lambda events: events.where(_kind() == "clicked"), {"clicks": F.count(F.lit(1))}, {"clicks": F.sum("clicks")})


def hourly() -> Sums:
    """Extension: events by hour and kind."""
    timed = lambda events: events.select(F.date_trunc("hour", F.col("event_at")).cast("timestamp_ntz").alias("hour"), _kind().alias("kind"))
    return Sums(("hour", "kind"), timed, {"events": F.count(F.lit(1))}, {"events": F.sum("events")})


def with_status(state: DataFrame) -> DataFrame:
    """The status that a message's state leads to: opens and clicks promote alone from sent; the strongest event counts whatever the order of arrival."""
    return state.withColumn("status", F.coalesce(*[F.when(F.col(f"{k}_at").isNotNull(), k) for k in reversed(KINDS)], F.lit("sent")))


def stops(found: DataFrame) -> DataFrame:
    """When and why each enrollment stopped first."""
    return found.select("enrollment_id", F.col("stop.at").alias("stopped_at"), F.col("stop.kind").alias("status"), F.when(F.col("stop.kind") == "replied", "REPLY_RECEIVED").otherwise(F.upper("stop.kind")).alias("stop_reason"))


def suppressed(found: DataFrame) -> DataFrame:
    """Rows of the suppression list."""
    return found.select(F.col("first.to_email").alias("email"), "normalized_email", F.upper("first.kind").alias("reason"), F.lit("WEBHOOK").alias("source"), F.col("first.at").alias("suppressed_at"))


def known_only(events: DataFrame, messages: DataFrame) -> DataFrame:
    """Events of known messages; others are ignored (a stream-static join)."""
    return events.join(messages.select(F.col("id").alias("message_id"), F.col("status").alias("sent_status")), "message_id")


def appended(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows of a stream without aggregates, over all that ever came."""
    folder = folder or new_folder(stream.sparkSession)
    parts = Parts(stream.sparkSession, folder, stream.schema)
    advance(stream, folder, parts.add)
    return parts.read()


def ingest_once(stream: DataFrame, folder: str, key: str = "provider_event_id", order: tuple[str, ...] = ()) -> DataFrame:
    """All rows taken so far, each key once: within a batch the first by order, over batches the first that came. Rows without a key aren't taken.

    The taken rows are the table of known keys: a batch reads the keys alone, of the hash buckets that it touches.
    """
    spark = stream.sparkSession
    schema = stream.withColumn("bucket", F.lit(0)).schema
    parts = Parts(spark, folder, schema)

    def take(batch: DataFrame, number: int) -> None:
        rows = batch.where(F.col(key).isNotNull()).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
        place = F.row_number().over(Window.partitionBy("bucket", key).orderBy(*(order or (key,))))
        first = rows.withColumn("_n", place).where("_n = 1").drop("_n")
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # BUCKETS numbers at most
        known = parts.read(before=number).where(F.col("bucket").isin(touched)).select("bucket", key)
        first.join(known, ["bucket", key], "left_anti").select(schema.names).write.mode("overwrite").parquet(f"{folder}/parts/part={number}")

    advance(stream, folder, take)
    return parts.read().drop("bucket")


def compact_rows(stream: DataFrame, folder: str) -> None:
    """Merges the files of ingest_once; rows of a bucket lie together, so that Parquet's statistics skip the others."""
    Parts(stream.sparkSession, folder, stream.withColumn("bucket", F.lit(0)).schema).compact(lambda rows: rows.repartition("bucket").sortWithinPartitions("bucket"))


class _Observer(StreamingQueryListener):
    """Adds up the observed metrics of the queries that observe a name, as progress arrives."""

    def __init__(self, query: str, combine: dict):
        self.query, self.combine, self.triggers = query, combine, 0
        self.row: dict = dict.fromkeys(combine)
        self.over: set[str] = set()
        self.changed = threading.Condition()

    def onQueryStarted(self, event):  # noqa: N802
        pass

    def onQueryProgress(self, event):  # noqa: N802
        seen = event.progress.observedMetrics.get(self.query)
        if seen is None:
            return
        self.triggers += 1
        for n, f in self.combine.items():
            known = [x for x in (self.row[n], seen[n]) if x is not None]
            self.row[n] = f(known) if known else None

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        with self.changed:
            self.over.add(str(event.runId))
            self.changed.notify_all()

    def wait(self, run: str, seconds: int) -> bool:
        """Whether the run has ended, with all of its progress, which comes behind the query but in order."""
        with self.changed:
            return self.changed.wait_for(lambda: run in self.over, seconds)


def observed(stream: DataFrame, metrics: dict, seconds: int = 600) -> DataFrame:
    """One row of metrics (named aggregates of numbers: counts add up, first_ and last_ are the least and the largest) observed while the
    stream runs over what is available; its rows go nowhere. Every trigger counts, however many there are."""
    spark = stream.sparkSession
    path, name = f"{shared_folder(spark)}/observed-{uuid.uuid4().hex}", f"run-{uuid.uuid4().hex}"
    combine = {n: min if n.startswith("first_") else max if n.startswith("last_") else sum for n in metrics}
    observer = _Observer(name, combine)
    spark.streams.addListener(observer)
    try:
        named = stream.observe(name, *[c.alias(n) for n, c in metrics.items()])
        query = named.writeStream.format("noop").option("checkpointLocation", path).trigger(availableNow=True).start()
        query.awaitTermination()
        if not observer.wait(str(query.runId), seconds):
            raise TimeoutError("the query has ended, but its progress hasn't come")
    finally:
        spark.streams.removeListener(observer)
    row = {n: 0 if v is None and combine[n] is sum else v for n, v in observer.row.items()}
    schema = stream.limit(0).groupBy().agg(*[c.alias(n) for n, c in metrics.items()]).schema
    return spark.createDataFrame([tuple(row[f.name] for f in schema)], schema)


#: Seconds within which a mail of the same sender and subject is the same mail.
SAME_MAIL_S = 60


def _reached(mails: DataFrame, seconds: int) -> DataFrame:
    """The mails that are imported by time alone: the first of a sender and subject, then always the next one more than so many seconds later.

    Runs of mails without a gap beyond that are independent. In a run each mail points at the first one beyond its seconds; those that
    the first mail reaches are found by doubling: as many rounds as the binary logarithm of the most imports of a run.
    """
    group = ["sender", "subject"]
    order = [F.col("received_s"), F.col("id")]
    w = Window.partitionBy(*group).orderBy(*order)
    gap = F.col("received_s") - F.lag("received_s").over(w) > seconds
    # from the latest on, each mail's probe at its limit sees the last mail that came before it there: the next one in time
    nodes = mails.select(*group, "id", "received_s", F.lit(True).alias("is_mail"), F.col("received_s").alias("s"))
    probes = mails.select(*group, "id", "received_s", F.lit(False).alias("is_mail"), (F.col("received_s") + seconds).alias("s"))
    back = Window.partitionBy(*group).orderBy(F.desc("s"), F.col("is_mail").cast("int"), F.desc("id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # of mails at one time the first: the last one seen backwards
    following = F.last(F.when(F.col("is_mail"), F.struct("s", "id")), ignorenulls=True).over(back)
    pointers = nodes.unionByName(probes).withColumn("to", following).where("not is_mail").select("id", F.col("to.id").alias("to"))
    heads = written(mails.withColumn("head", F.coalesce(gap, F.lit(True))).select("id", "head"), "mail-heads")
    reached = heads.where("head").select("id")
    # a pointer out of its run leads to a head, which is reached anyway
    jump = written(pointers.join(heads.where("not head").select(F.col("id").alias("to")), "to", "left_semi").select("id", "to"), "mail-jumps")
    while not jump.isEmpty():
        fresh = reached.join(jump, "id").select(F.col("to").alias("id"))
        reached = written(reached.unionByName(fresh).distinct(), "mail-reached")
        jump = written(jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("next")), "to").select("id", F.col("next").alias("to")), "mail-jumps")
    return reached


def imports(mails: DataFrame, before: DataFrame | None = None, seconds: int = SAME_MAIL_S) -> DataFrame:
    """mails with is_duplicate, as if they came one by one in the order of time (ties by id) behind those that were imported before.

    A mail is a duplicate if an imported one has its provider id, or its sender and subject within so many seconds on either side;
    only imported mails count, so that a duplicate opens no window of its own. mails and before: id, sender, subject, received_s,
    provider_id; ids differ. A null provider id, sender or subject is met by none.
    """
    mails = written(mails, "mails")
    open_ = mails.select("id", F.coalesce(F.col("sender").cast("string"), F.concat(F.lit("\x00"), "id")).alias("sender"), F.coalesce(F.col("subject").cast("string"), F.concat(F.lit("\x00"), "id")).alias("subject"), "received_s", "provider_id")
    if before is not None:
        known = before.select(F.col("sender").cast("string").alias("sender"), F.col("subject").cast("string").alias("subject"), F.col("received_s").alias("at"), "provider_id")
        open_ = open_.join(known.select("provider_id").where("provider_id is not null").distinct(), "provider_id", "left_anti")
        # cells of the window's width: an import within it lies in the mail's cell or one beside it
        cell = lambda c: F.floor(F.col(c) / seconds)
        near = known.select("sender", "subject", "at", F.explode(F.array(cell("at") - 1, cell("at"), cell("at") + 1)).alias("cell")).distinct()
        hit = open_.withColumn("cell", cell("received_s")).join(near, ["sender", "subject", "cell"]).where(F.abs(F.col("at") - F.col("received_s")) <= seconds).select("id").distinct()
        open_ = open_.join(hit, "id", "left_anti")
    open_ = written(open_.select("id", "sender", "subject", "received_s", "provider_id"), "mails-open")
    # copies by provider id: each later one goes if an earlier one is imported
    place = F.row_number().over(Window.partitionBy("provider_id").orderBy("received_s", "id"))
    copies = written(open_.where("provider_id is not null").withColumn("place", place).select("id", "provider_id", "place", F.max("place").over(Window.partitionBy("provider_id")).alias("copies")).where("copies > 1").drop("copies"), "mail-copies")
    # assumed first: every copy but the first goes. Then what the imports say, until both agree: the earliest mistake of a round is mended in the next
    assumed = copies.where("place > 1").select("id")
    while True:
        taken = _reached(open_.join(assumed, "id", "left_anti"), seconds)
        least = copies.join(taken, "id", "left_semi").groupBy("provider_id").agg(F.min("place").alias("first"))
        agreed = written(copies.join(least, "provider_id").where("place > first").select("id"), "mail-assumed")
        wrong = agreed.join(assumed, "id", "left_anti").unionByName(assumed.join(agreed, "id", "left_anti"))
        if wrong.isEmpty():
            break
        assumed = agreed
    return mails.join(taken.withColumn("_taken", F.lit(True)), "id", "left").withColumn("is_duplicate", F.col("_taken").isNull()).select(*mails.columns, "is_duplicate")


_MAIL = ["id", "sender", "subject", "received_s", "provider_id"]


def import_mails(stream: DataFrame, folder: str, seconds: int = SAME_MAIL_S) -> DataFrame:
    """All mails imported so far: each batch is judged against itself and what was imported before, in the order of arrival."""
    parts = Parts(stream.sparkSession, folder, stream.select(*_MAIL).schema)
    advance(stream.select(*_MAIL), folder, lambda batch, number: parts.add(imports(batch, parts.read(before=number), seconds).where("not is_duplicate").select(*_MAIL), number))
    return parts.read()


def stalled(changes: DataFrame, working: tuple[str, ...], seconds: int = 300) -> DataFrame:
    """A stream of batch_id, status, changed_at of the batches that haven't changed for so many seconds of the clock while they were worked on: each
    once, until it changes again. changes: batch_id (string), status, changed_at.

    State is the last change of each batch that is worked on; it goes with the batch's end or when the batch has been named. A change that
    is older than one that came before counts for nothing.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            status, at = state.get
            state.remove()
            yield pd.DataFrame({"batch_id": [key[0]], "status": [status], "changed_at": [pd.Timestamp(at, unit="us")]})
            return
        known = state.get if state.exists else None
        for frame in frames:
            for status, at in zip(frame["status"], frame["changed_at"]):
                at = int(pd.Timestamp(at).value // 1000)
                if known is None or at >= known[1]:
                    known = (status, at)
        if known and known[0] in working:
            state.update(known)
            state.setTimeoutDuration(seconds * 1000)
        elif state.exists:
            state.remove()

    rows = changes.where("batch_id is not null").groupBy("batch_id")
    return rows.applyInPandasWithState(step, "batch_id string, status string, changed_at timestamp_ntz", "status string, at long", "append", GroupStateTimeout.ProcessingTimeTimeout)
