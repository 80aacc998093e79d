"""People by day against sets."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from marlspike import plans, streaming
from marlspike.operators import people as P

SCHEMA = "campaign_id long, day date, kind string, person string"
FIRST = datetime.date(2024, 1, 1)


def some_facts(n, seed):
    rng = random.Random(seed)
    day = lambda: None if rng.random() < 0.1 else FIRST + datetime.timedelta(days=rng.randrange(-3, 12))
    # every third row is of one campaign and of one person
    one = lambda: (1, day(), rng.choice("abc"), "busy")
    any_row = lambda: (rng.choice([None, 1, 2, 3]), day(), rng.choice("abc"), rng.choice([None, "", *map(str, range(40))]))
    return [one() if i % 3 == 0 else any_row() for i in range(n)]


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def expected(rows):
    out = {}
    for campaign, _, kind, person in rows:
        if campaign is not None:
            who, n = out.setdefault(campaign, ({"a": set(), "b": set(), "c": set()}, {"a": 0, "b": 0, "c": 0}))
            n[kind] += 1
            who[kind] |= {person} - {None}
    return sorted((c, len(w["a"]), len(w["a"] | w["b"]), len(w["c"]), n["a"], n["a"] + n["c"]) for c, (w, n) in out.items())


def measured(days):
    return rows_of(P.measures(days, ["campaign_id"], {"a": ("a",), "ab": ("a", "b"), "c": ("c",)}, {"n_a": ("a",), "n_ac": ("a", "c")}))


@pytest.fixture
def store(spark, tmp_path):
    return P.PeopleByDay(spark, f"file://{tmp_path}/people", pieces=4)


def test_batches_equal_sets_and_a_batch_may_come_again(spark, store):
    rows = some_facts(600, 1)
    for number, part in enumerate((rows[:200], [], rows[200:450], rows[450:])):
        store.add(spark.createDataFrame(part, SCHEMA), number)
        if number == 2:  # a run that failed behind its write comes again
            store.add(spark.createDataFrame(part, SCHEMA), number)
    assert measured(store.read()) == expected(rows)
    ids = [(r["campaign_id"], r["id"]) for r in store.ids.read().collect()]
    for campaign in (1, 2, 3):  # dense from 1, one number a person
        assert sorted(i for c, i in ids if c == campaign) == list(range(1, 1 + len({r[3] for r in rows if r[0] == campaign} - {None})))
    store.compact()
    store.compact()
    assert len(store.days.paths()) == 1 and measured(store.read()) == expected(rows)
    assert store.read().groupBy(*P.KEY).count().where("count > 1").count() == 0
    more = some_facts(80, 2)
    store.add(spark.createDataFrame(more, SCHEMA), 4)
    assert measured(store.read()) == expected(rows + more)


def test_a_new_day_reads_no_old_ones(spark, store):
    rows = some_facts(120, 3)
    store.add(spark.createDataFrame(rows, SCHEMA), 0)
    old = store.days.paths()
    kept = spark.read.schema(P.DAYS).parquet(*old).collect()
    plans.delete(spark, old[0])  # whoever reads them now fails
    store.add(spark.createDataFrame([(1, FIRST, "a", "new"), (1, FIRST, "a", "busy")], SCHEMA), 1)
    both = spark.createDataFrame(kept, P.DAYS).unionByName(store.read())
    assert measured(both) == expected([*rows, (1, FIRST, "a", "new"), (1, FIRST, "a", "busy")])


def test_windows_equal_sets(spark, store):
    rows = some_facts(500, 4)
    store.add(spark.createDataFrame(rows[:300], SCHEMA), 0)
    store.add(spark.createDataFrame(rows[300:], SCHEMA), 1)
    found = rows_of(P.windows(store.read(), ["a", "b"], "2024-01-01", 10, width=3))
    wanted = []
    for campaign in (1, 2, 3):
        for kind in "ab":
            mine = [(r[1], r[3]) for r in rows if r[0] == campaign and r[2] == kind and None not in (r[1], r[3])]
            for d in (FIRST + datetime.timedelta(days=i) for i in range(10)):
                age = [((d - day).days, who) for day, who in mine]
                wanted.append((campaign, kind, d, len({w for a, w in age if a == 0}), len({w for a, w in age if 0 <= a < 3}), len({w for a, w in age if a >= 0})))
    assert found == sorted(wanted)


def test_people_of_several_slots(spark, store):
    ids = lambda low, high, kind: spark.range(low, high).select(F.lit(9).cast("long").alias("campaign_id"), F.lit(FIRST).alias("day"), F.lit(kind).alias("kind"), F.col("id").cast("string").alias("person"))
    store.add(ids(0, 40_000, "a").unionByName(ids(0, 10, "a")), 0)
    store.add(ids(30_000, 75_000, "b").unionByName(ids(74_000, 76_000, "c")), 1)
    assert measured(store.read()) == [(9, 40_000, 75_000, 2_000, 40_010, 42_010)]
    assert store.read().select("slot").distinct().count() == 3


def test_empty(spark, store):
    none = spark.createDataFrame([], SCHEMA)
    assert measured(store.read()) == []
    store.add(none, 0)
    assert measured(store.read()) == [] and rows_of(P.windows(store.read(), ["a"], "2024-01-01", 3)) == []
    store.add(spark.createDataFrame([(None, FIRST, "a", "x"), (1, None, "a", None)], SCHEMA), 1)
    assert measured(store.read()) == [(1, 0, 0, 0, 1, 1)]
    assert rows_of(P.windows(store.read(), ["a"], "2024-01-01", 3)) == []


def test_a_stream_goes_on_and_takes_late_events(spark, tmp_path):
    schema = "campaign_id long, event_type string, event_at timestamp, enrollment_id string"
    when = datetime.datetime(2024, 1, 5, 12)
    files = [
        [(1, "opened", when, "p"), (1, "email.opened", when, "p"), (1, "OPENED", when, "q")],
        [(1, "opened", when - datetime.timedelta(days=400), "q"), (1, "clicked", when, None)],
        [(2, "replied", when, "p"), (1, "opened", None, "r")],
    ]
    folder, state = f"file://{tmp_path}/in", f"file://{tmp_path}/state"
    for i, part in enumerate(files):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        store = P.people_stream(stream, P.event_facts, state)
        assert len(store.days.paths()) == i + 1
    found = rows_of(P.measures(store.read(), ["campaign_id"], {"o": ("opened",), "c": ("clicked",), "r": ("replied",)}, {"seen": ("seen",), "n": ("opened", "clicked")}))
    assert found == [(1, 3, 0, 0, 6, 5), (2, 0, 0, 1, 1, 0)]
    assert streaming.Parts(spark, f"{state}/people/days", P.DAYS).read().where("kind = 'opened' and day < '2023-01-01'").count() == 1
