"""Streams: any grouping of the files into triggers gives the batch's result, nothing is lost, restarts go on, every trigger counts."""

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from marlspike import plans, streaming

DAY = datetime.timedelta(days=1)
START = datetime.datetime(2024, 3, 1, 12)
SCHEMA = "message_id long, link_no long, enrollment_id string, event_type string, event_at timestamp_ntz, contact_id long, to_email string"
YEAR_LATE = [
    [(1, 1, "a", "opened", START), (2, 1, "b", "CLICKED", START)],
    [(1, 1, "a", "email.clicked", START + 20 * DAY), (2, 2, "b", "replied", START + 10 * DAY)],
    [(3, 1, "c", "opened", START + 400 * DAY), (3, 1, None, "bounced", START + 400 * DAY), (2, 1, "b", "unsubscribed", START - 400 * DAY)],
    [(1, 1, "a", "bounced", START - 2 * DAY), (2, 1, "b", "clicked", START - 300 * DAY)],
]
FILES = [[(*r, r[0] * 10, f"Contact{r[0]}@X.example") for r in file] for file in YEAR_LATE]
ALL = {
    "state": (streaming.message_state, streaming.with_status),
    "stops": (streaming.hard_stops, streaming.stops),
    "suppressions": (streaming.suppressions, streaming.suppressed),
    "clicks": (streaming.click_counts, lambda x: x),
    "hourly": (streaming.hourly, lambda x: x),
}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def add(spark, path, part, schema=SCHEMA):
    spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/event.parquet")


def stream(spark, path, at_once=1):
    return streaming.source(spark, str(path), "event", files_at_once=at_once)


@pytest.mark.parametrize("name", ALL)
def test_sums_do_not_depend_on_triggers_order_or_lateness(spark, tmp_path, name):
    """Four files one by one, in the other order, in pairs, all at once: always what the batch says, a bounce from before and a click of a year ago included."""
    sums, finish = ALL[name]
    batch = spark.createDataFrame([r for f in FILES for r in f], SCHEMA)
    wanted = rows(finish(sums().merged(sums().of(batch))))
    for k, (files, at_once) in enumerate([(FILES, 1), (FILES[::-1], 1), (FILES, 2), (FILES, 9)]):
        for file in files:
            add(spark, tmp_path / str(k), file)
        assert rows(finish(streaming.summed(stream(spark, tmp_path / str(k), at_once), sums()))) == wanted
    if name == "state":
        state = {r[0]: dict(zip(["message_id", "opened_at", "clicked_at", "replied_at", "bounced_at", "last_event_at", "events", "status"], r)) for r in wanted}
        assert (state[1]["status"], state[1]["events"], state[1]["bounced_at"]) == ("bounced", 3, START - 2 * DAY)
        assert (state[2]["clicked_at"], state[2]["events"]) == (START - 300 * DAY, 4)
    if name == "stops":  # unsubscribing is no event that stops
        assert wanted == [("a", START - 2 * DAY, "bounced", "BOUNCED"), ("b", START + 10 * DAY, "replied", "REPLY_RECEIVED")]
    if name == "suppressions":
        assert [r[:4] for r in wanted] == [(f"Contact{k}@X.example", f"contact{k}@x.example", "BOUNCED", "WEBHOOK") for k in (1, 3)]


def test_a_stream_goes_on_from_its_folder_and_keeps_no_state(spark, tmp_path):
    """Restarts between files, compactions between restarts, a batch written twice; the state lies in the folder, none in a state store."""
    folder, sums = f"file://{tmp_path}/ledger", streaming.message_state()
    for k, file in enumerate(FILES):
        add(spark, tmp_path / "in", file)
        found = streaming.summed(stream(spark, tmp_path / "in"), sums, folder)
        assert rows(found) == rows(sums.merged(sums.of(spark.read.parquet(f"{tmp_path}/in/event.parquet"))))
        if k in (1, 2):
            streaming.compact(stream(spark, tmp_path / "in"), sums, folder)
    assert list(plans.complete(spark, f"{folder}/bases")) == [1, 2] and list(plans.complete(spark, f"{folder}/parts")) == [2, 3]
    again = rows(streaming.summed(stream(spark, tmp_path / "in"), sums, folder))  # nothing new
    assert again == rows(found)
    parts = streaming.Parts(spark, folder, sums.of(found.limit(0).select(F.lit(1).cast("long").alias("message_id"), F.lit("").alias("event_type"), F.lit(START).cast("timestamp_ntz").alias("event_at"))).schema)
    last = spark.createDataFrame(spark.read.schema(parts.schema).parquet(parts.paths()[-1]).collect(), parts.schema)
    parts.add(last, 3)
    assert rows(sums.merged(parts.read())) == again
    query = sums.rows(stream(spark, tmp_path / "in")).writeStream.foreachBatch(lambda batch, n: sums.of(batch).count()).option("checkpointLocation", str(tmp_path / "other")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress.stateOperators == []


def test_ingestion_takes_each_id_once_over_restarts(spark, tmp_path):
    """A copy years later, in another run, after a compaction or in a batch that failed half way is the same id."""
    schema, folder = "provider_event_id string, at long", f"file://{tmp_path}/ids"
    rng = random.Random(1)
    files = [[(rng.choice([None, *"abcdefghij"]), k * 100 + j) for j in range(12)] for k in range(5)]
    first: dict = {}
    for k, file in enumerate(files):
        add(spark, tmp_path / "in", file, schema)
        for i, at in sorted(file, key=lambda r: r[1]):
            if i is not None:
                first.setdefault(i, at)
        if k == 2:  # a run that stops before its batch is complete
            def broken(batch, number):
                batch.withColumn("bucket", F.lit(0)).write.mode("overwrite").parquet(f"{folder}/parts/part={number}")
                raise RuntimeError("stopped")

            with pytest.raises(Exception, match="stopped"):
                streaming.advance(stream(spark, tmp_path / "in"), folder, broken)
        found = streaming.ingest_once(stream(spark, tmp_path / "in"), folder, order=("at",))
        assert dict(tuple(r) for r in found.collect()) == first and found.count() == len(first)
        if k == 3:
            streaming.compact_rows(stream(spark, tmp_path / "in"), folder)


def test_every_trigger_is_observed(spark, tmp_path):
    """More triggers than a query's list of recent progress holds."""
    for part in range(3):
        spark.range(part * 50, part * 50 + 50, 1, 50).select(F.col("id").alias("message_id"), F.lit("opened").alias("event_type")).write.mode("append").parquet(f"{tmp_path}/event.parquet")
    row = streaming.observed(stream(spark, tmp_path), {"events": F.count(F.lit(1)), "first_id": F.min("message_id"), "last_id": F.max("message_id")}).first()
    assert tuple(row) == (150, 0, 149)


MAILS = "id long, sender string, subject string, received_s long, provider_id string"


def one_by_one(mails, seconds=60):
    """The ids imported when mails come in this order."""
    imported = []
    for m in mails:
        same = lambda o: (m[4] is not None and m[4] == o[4]) or (None not in m[1:3] and m[1:3] == o[1:3] and abs(m[3] - o[3]) <= seconds)
        if not any(same(o) for o in imported):
            imported.append(m)
    return sorted(m[0] for m in imported)


def test_only_imported_mails_open_a_window(spark, tmp_path):
    mails = [(k, "s", "re", at, None) for k, at in enumerate((0, 50, 100, 150))]
    found = streaming.imports(spark.createDataFrame(mails, MAILS))
    assert [r["is_duplicate"] for r in found.orderBy("id").collect()] == [False, True, False, True]
    for m in mails:
        add(spark, tmp_path, [m], MAILS)
    assert sorted(r["id"] for r in streaming.import_mails(stream(spark, tmp_path), f"file://{tmp_path}/mail").collect()) == [0, 2]


@pytest.mark.parametrize("seed", [1, 2])
def test_imports_equal_one_by_one(spark, tmp_path, seed):
    """Long runs, ties, provider ids shared within and across senders, nulls; in batch by time, in the stream by arrival."""
    rng = random.Random(seed)
    mails = [(k, rng.choice(["a", "b", None]), rng.choice(["x", "y"]), rng.randrange(2500), rng.choice([None, None, f"p{rng.randrange(12)}"])) for k in range(160)]
    mails += [(1000 + k, "long", "run", 30 * k, None) for k in range(60)]
    by_time = sorted(mails, key=lambda m: (m[3], m[0]))
    found = streaming.imports(spark.createDataFrame(mails, MAILS).repartition(3))
    assert sorted(r["id"] for r in found.where("not is_duplicate").collect()) == one_by_one(by_time) and found.count() == len(mails)
    arrived = [sorted(part, key=lambda m: (m[3], m[0])) for part in (mails[0::3], mails[1::3], mails[2::3])]
    for part in arrived:
        add(spark, tmp_path, part, MAILS)
    imported = streaming.import_mails(stream(spark, tmp_path), f"file://{tmp_path}/mail")
    orders = {tuple(one_by_one(list(itertools.chain(*order)))) for order in itertools.permutations(arrived)}  # files of one second come in any order
    assert tuple(sorted(r["id"] for r in imported.collect())) in orders
    assert streaming.imports(spark.createDataFrame([], MAILS)).count() == 0


def test_stalled_batches_fire_once_by_the_clock(spark, tmp_path):
    """A batch that stays as it is fires once; one that goes on or ends doesn't; a change arms it again."""
    import time

    schema = "batch_id string, status string, changed_at timestamp_ntz"
    at = lambda s: START + datetime.timedelta(seconds=s)
    add(spark, tmp_path, [("stays", "EXTRACTING", at(0)), ("ends", "EXTRACTING", at(0)), ("stays", "QUEUED", at(-9)), (None, "QUEUED", at(0))], schema)
    add(spark, tmp_path, [("ends", "COMPLETED", at(1))], schema)
    folder, fired = str(tmp_path / "checkpoint"), []
    found = streaming.stalled(stream(spark, tmp_path), ("QUEUED", "EXTRACTING"), seconds=4)
    query = found.writeStream.foreachBatch(lambda batch, n: fired.extend(map(tuple, batch.collect()))).option("checkpointLocation", folder).trigger(processingTime="1 second").start()
    try:
        def until(n):
            limit = time.time() + 90
            while len(fired) < n and time.time() < limit:
                time.sleep(1)

        until(1)
        time.sleep(6)
        assert fired == [("stays", "EXTRACTING", at(0))]
        add(spark, tmp_path, [("stays", "QUEUED", at(5))], schema)
        until(2)
        time.sleep(6)
        assert fired[1:] == [("stays", "QUEUED", at(5))]
    finally:
        query.stop()
