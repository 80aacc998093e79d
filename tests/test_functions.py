"""Golden vectors of the functions, and loops in plain Python against operators that decide row by row."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marlspike.functions import calendar as C
from marlspike.functions import text as X
from marlspike.operators import leads as L
from marlspike.operators import planning as P
from marlspike.operators.audience import upsert


def values(spark, function, inputs, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("function", "vectors"),
    [
        (X.company_name, {"Acme Corp.": "acme", "Global Travel, LLC": "global travel", "Alpha   Beta   Holdings": "alpha beta", "Global Software GmbH & Co. KG": "global software", "München Präzision GmbH": "münchen präzision", "日本語技術株式会社": "日本語技術株式会社", "Orion Technologies Pvt. Ltd.": "orion technologies"}),
        (X.domain, {"https://www.example.com/about?ref=nav": "example.com", "www.sub.example.co.uk/path/": "sub.example.co.uk", "http://sub.domain.co.uk:8080/path": "sub.domain.co.uk", "WWW.EXAMPLE.COM": "example.com", "invalid-domain": None, "": None}),
        (X.email, {"mailto:contact@acme.org": "contact@acme.org", "not-an-email": None, "@missingusername.com": None}),
        (X.phone, {"+1 (555) 234-5678": "+15552345678", "080-1234567": "0801234567", "123": None}),
        (X.is_restricted_ip, {"127.0.0.1": True, "10.0.1.5": True, "172.16.0.1": True, "172.31.255.255": True, "192.168.1.1": True, "169.254.169.254": True, "0.0.0.0": True, "::1": True, "8.8.8.8": False, "142.250.190.46": False}),
        (X.root_domain, {"a.b.example.co.uk": "example.co.uk", "www.example.com": "example.com", "localhost": "localhost"}),
        (X.string_hash, {"": 0, "a": 97, "polygenelubricants": -2147483648, "a\U0001f600": 1866116}),
        (X.capital_words, {"o'neil-smith 2nd": "O'Neil-Smith 2nd", "élan vital": "éLan Vital", "a_b c": "A_b C"}),
        (X.name_from_email, {"JO.van@x.example": "Jo Van", "jo1.van@x.example": None, "jo.van.x@y.example": None, "jo": None}),
        (X.clean_url, {"HTTP://Site.Example/Path/?utm_source=a&x=1&REF=2#top": "http://site.example/Path?x=1", "site.example": "https://site.example", "": None}),
    ],
)
def test_vectors(spark, function, vectors):
    assert dict(zip(vectors, values(spark, function, vectors), strict=True)) == vectors


def test_division(spark):
    wanted = {"Nova (A Division of Digital Infotech Pvt Ltd)": ("Nova", "Digital Infotech Pvt Ltd", "DIVISION"), "Acme Dynamics [Div. of Apex Global]": ("Acme Dynamics", "Apex Global", "DIVISION"), "Simple Enterprise Ltd": ("Simple Enterprise Ltd", None, None), "Amada America Inc (Laser & Sheet Metal Machinery Division)": ("Amada America Inc", "Amada America Inc", "DIVISION"), "Agrayan - A Division of Digite Infotech": ("Agrayan", "Digite Infotech", "DIVISION"), "Acme Corp (Subsidiary of Global Conglomerate)": ("Acme Corp", "Global Conglomerate", "SUBSIDIARY"), "NexGen Travel (formerly Orbitz Media)": ("NexGen Travel", None, "FORMER_NAME")}
    assert dict(zip(wanted, map(tuple, values(spark, X.company_division, wanted)), strict=True)) == wanted


def test_dice(spark):
    pairs = spark.createDataFrame([("acme", "Acme"), ("Google LLC", "Microsoft Corp"), ("acme dynamics", "acme dynamic"), ("a", "b")], "a string, b string")
    same, other, near, short = (r[0] for r in pairs.select(X.dice(F.col("a"), F.col("b"))).collect())
    assert same == 1.0 and other < 0.2 and near == pytest.approx(20 / 21, abs=0.01) and short == 0.0


KOLKATA = [
    ("2026-09-07 10:00", 1, "MON,TUE,WED,THU,FRI", "2026-09-08 10:00"), ("2026-09-07 10:00", 5, "MON,TUE,WED,THU,FRI", "2026-09-14 10:00"), ("2026-09-10 10:00", 2, "MON,TUE,WED,THU,FRI", "2026-09-14 10:00"),
    ("2026-09-11 10:00", 1, "MON,TUE,WED,THU,FRI", "2026-09-14 10:00"), ("2026-09-12 14:25", 1, "MON,TUE,WED,THU,FRI", "2026-09-14 14:25"), ("2026-09-13 14:25", 2, "MON,TUE,WED,THU,FRI", "2026-09-15 14:25"),
    ("2026-09-07 11:00", 3, "MON,WED,FRI", "2026-09-14 11:00"), ("2026-09-10 10:00", 1, "TUE,THU", "2026-09-15 10:00"),
]


def next_send(spark, zone, local, delay, days, window=(None, None)):
    frame = spark.createDataFrame([(dt.datetime.fromisoformat(local), delay, days, *window)], "t timestamp_ntz, d int, days string, a string, b string")
    at = C.instant(F.col("t"), F.lit(zone))
    return frame.select(C.local(C.next_send_time(at, F.col("d"), C.normalize_days(F.col("days")), F.lit(zone), F.col("a"), F.col("b")), F.lit(zone))).first()[0]


@pytest.mark.parametrize(("local", "delay", "days", "wanted"), KOLKATA)
def test_business_days(spark, local, delay, days, wanted):
    assert next_send(spark, "Asia/Kolkata", local, delay, days) == dt.datetime.fromisoformat(wanted)


def test_business_days_over_clock_changes_and_windows(spark):
    week = "MON,TUE,WED,THU,FRI"
    assert next_send(spark, "America/New_York", "2026-10-30 10:00", 1, week) == dt.datetime(2026, 11, 2, 10)
    assert next_send(spark, "America/Los_Angeles", "2026-03-06 14:00", 1, week) == dt.datetime(2026, 3, 9, 14)
    assert next_send(spark, "Asia/Kolkata", "2026-09-10 14:25:14.695", 2, week, ("09:30", "17:30")) == dt.datetime(2026, 9, 14, 14, 25, 14, 695000)
    assert next_send(spark, "Asia/Kolkata", "2026-09-10 18:00", 0, week, ("09:30", "17:30")) == dt.datetime(2026, 9, 11, 9, 30)
    assert next_send(spark, "Asia/Kolkata", "2026-09-10 10:00", -1, week) is None
    assert next_send(spark, "Asia/Kolkata", "2026-09-10 10:00", 1, "MON,XYZ") == dt.datetime(2026, 9, 14, 10)
    assert next_send(spark, "Asia/Kolkata", "2026-09-10 10:00", 1, "XYZ") is None


@pytest.mark.parametrize(("loads", "rooms", "n"), [((0, 0, 0, 0), (999,) * 4, 101), ((0, 0, 0, 0), (10, 0, 10, 10), 30), ((5, 5, 0, 5), (99,) * 4, 15), ((3, 3, 0, 3), (99,) * 4, 3), ((12, 12, 11), (99,) * 3, 1), ((2, 0), (1, 1), 5)])
def test_rotation_is_the_loop(spark, loads, rooms, n):
    leads = spark.createDataFrame([(0, i) for i in range(n)], "campaign_id int, id int")
    boxes = spark.createDataFrame([(0, f"m{i}", i, load, room) for i, (load, room) in enumerate(zip(loads, rooms, strict=True))], "campaign_id int, mailbox string, position int, load int, room int")
    got = {r["id"]: r["mailbox"] for r in P.rotate(leads, boxes).collect()}
    now, left = list(loads), list(rooms)
    for i in range(n):
        free = [k for k in range(len(now)) if left[k] > 0]
        best = min(free, key=lambda k: (now[k], k)) if free else None
        assert got[i] == (None if best is None else f"m{best}")
        if best is not None:
            now[best] += 1
            left[best] -= 1


@pytest.mark.parametrize(
    ("capacity", "sent", "eligible", "active", "wanted"),
    [(400, 277, 1011, True, (123, 123, 888, 400, 69)), (200, 200, 350, True, (0, 0, 350, 200, 100)), (1000, 500, 500, True, (500, 500, 0, 1000, 50)), (400, 0, 100, False, (400, 0, 0, 0, 0))],
)
def test_send_plan(spark, capacity, sent, eligible, active, wanted):
    rows = spark.createDataFrame([(capacity, sent, eligible, active, [True, True, True])], "capacity int, sent int, eligible int, active boolean, next_allowed array<boolean>")
    r = P.send_plan(rows).first()
    assert (r["remaining"], r["sendable"], r["rollover"], r["planned"], r["progress"]) == wanted


def test_step_progress_is_the_loop(spark):
    """Passes in order: explicit steps with all before, then unmapped messages to the earliest free step, then the position."""
    import random

    rng = random.Random(4)
    people = [f"0-{i}" for i in range(60)]
    state = [(p, 0, rng.choice(["active", "completed"]), rng.randint(1, 3)) for p in people]
    messages = [(p, 0, rng.choice([None, 1, 2, 3, 7]), rng.choice(["sent", "failed", "bounced"])) for p in people for _ in range(rng.randint(0, 3))]
    got = {k: set() for k in people}
    for p, _, step, status in messages:
        if status != "failed" and step is not None and step <= 3:
            got[p] |= set(range(1, step + 1))
    for p, _, step, status in messages:
        if status != "failed" and (step is None or step > 3):
            free = [s for s in (1, 2, 3) if s not in got[p]]
            got[p] |= set(free[:1])
    for p, _, status, step in state:
        got[p] |= {1, 2, 3} if status == "completed" else set(range(1, step))
    m = spark.createDataFrame([(p, c, s, st, "x@y.example") for p, c, s, st in messages], "enrollment_id string, campaign_id int, step_no long, status string, to_email string").withColumn("sent_at", F.lit(None).cast("timestamp_ntz"))
    e = spark.createDataFrame([(p, c, s, n) for p, c, s, n in state], "id string, campaign_id int, status string, current_step long")
    found = {r["step_no"]: r["sent"] for r in P.step_progress(m, e).collect()}
    assert found == {s: sum(s in x for x in got.values()) for s in (1, 2, 3)}


EXISTING = [(1, 0, "acme industries", "acmeindustries.com", "sales@acmeindustries.com", "+15551234567", "chicago")]


@pytest.mark.parametrize(
    ("probe", "status", "confidence"),
    [
        ((9, 0, "other", "acmeindustries.com", None, None, None), "DUPLICATE", 1.0),
        ((9, 0, "other", None, "sales@acmeindustries.com", None, None), "DUPLICATE", 1.0),
        ((9, 0, "acme industries", None, None, None, "chicago"), "DUPLICATE", 0.95),
        ((9, 0, "zeta", None, None, "+15551234567", None), "POSSIBLE_DUPLICATE", 0.85),
        ((9, 0, "acme industrie", None, None, None, None), "POSSIBLE_DUPLICATE", 0.96),
        ((9, 0, "zeta", "zeta.com", "a@zeta.com", "+1999999999", "oslo"), "UNIQUE", None),
        ((9, 1, "other", "acmeindustries.com", None, None, None), "UNIQUE", None),
    ],
)
def test_entity_tiers(spark, probe, status, confidence):
    schema = "row_number long, user_id long, name string, domain string, email string, phone string, city string"
    r = L.match_existing(spark.createDataFrame([probe], schema), spark.createDataFrame(EXISTING, schema)).first()
    assert (r["status"], r["confidence"]) == (status, confidence)


def bigrams(s):
    s = "".join(s.split()).lower()
    return s, [s[i : i + 2] for i in range(len(s) - 1)]


def alike(a, b):
    (x, p), (y, q) = bigrams(a), bigrams(b)
    if x == y:
        return 1.0
    if len(x) < 2 or len(y) < 2:
        return 0.0
    left, hits = list(q), 0
    for g in p:
        if g in left:
            left.remove(g)
            hits += 1
    return 2 * hits / (len(p) + len(q))


def test_greedy_batch_is_the_loop(spark):
    import random

    rng = random.Random(11)
    rows = []
    for i in range(160):
        rows.append((i, i % 2, f"nova {rng.choice(['alpha', 'alphas', 'beta', 'betas', 'gamma'])} {rng.randint(0, 40)}", rng.choice([None, f"d{rng.randint(0, 60)}.com"]), rng.choice([None, f"a{rng.randint(0, 60)}@b.com"]), rng.choice([None, f"+1555{rng.randint(1000000, 1000030)}"]), rng.choice([None, "oslo", "rome"])))
    schema = "row_number long, user_id long, name string, domain string, email string, phone string, city string"
    got = {r["row_number"]: (r["status"], r["match"]) for r in L.dedupe_batch(spark.createDataFrame(rows, schema)).collect()}
    kept: list[tuple] = []
    for row in rows:
        i, user, name, domain, email, phone, city = row
        mine = [k for k in kept if k[1] == user]
        exact = [k for k in mine if (domain and k[3] == domain) or (email and k[4] == email) or (city and k[2] == name and k[6] == city)]
        if exact:
            assert got[i] == ("DUPLICATE", exact[0][0])
            continue
        phones = [k for k in mine if phone and k[5] == phone]
        block = [k for k in mine if k[2][:3] == name[:3]][:50]
        fuzzy = [k for k in block if alike(k[2], name) >= 0.88]
        if phones or fuzzy:
            assert got[i] == ("POSSIBLE_DUPLICATE", (phones or fuzzy)[0][0])
        else:
            assert got[i] == ("UNIQUE", None)
        kept.append(row)


def test_greedy_rounds_follow_a_chain(spark):
    """Each row shares a key with the next one alone: every second row is kept, in as many rounds as half the chain has rows."""
    n = 24
    pairs = spark.createDataFrame([(i, f"k{j}") for i in range(n) for j in (i, i + 1)], "row_number long, key string")
    found = {r["row_number"]: r["match"] for r in L.greedy_duplicates(pairs).collect()}
    assert found == {i: i - 1 for i in range(1, n, 2)}


def test_upsert_takes_the_later_row(spark):
    old = spark.createDataFrame([("a", 1, "old"), ("b", 5, "old")], "k string, at int, v string")
    new = spark.createDataFrame([("a", 1, "new"), ("b", 4, "new"), ("c", 1, "new")], "k string, at int, v string")
    assert {(r["k"], r["v"]) for r in upsert(old, new, ["k"], "at").collect()} == {("a", "new"), ("b", "old"), ("c", "new")}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_five_minutes_do_not_depend_on_the_session(spark, zone):
    """Also in hours that the session's zone has twice or never, and before 1970."""
    times = [dt.datetime(2024, 1, 1, 0, 4, 59, 999999), dt.datetime(2024, 3, 10, 2, 30), dt.datetime(2024, 11, 3, 1, 30), dt.datetime(1970, 1, 1), dt.datetime(1969, 12, 31, 23, 59, 59, 999999)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = [r["b"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t timestamp_ntz").select("i", C.five_minutes(F.col("t")).alias("b")).orderBy("i").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [(t - dt.datetime(1970, 1, 1)) // dt.timedelta(minutes=5) for t in times]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_five_minute_query_equals_its_sql_at_limits(spark, tmp_path, zone):
    import duckdb

    from marlspike import catalog

    con = duckdb.connect()
    # microseconds around the limits of buckets, on both sides of the epoch; far times; none
    con.execute("CREATE TABLE events AS SELECT i AS event_id, make_timestamp(us) AS ts, i AS user_id, 'view' AS event_type, 1.0 AS value, '{}' AS props FROM (SELECT row_number() OVER () AS i, b::BIGINT * 300000000 + d AS us FROM (SELECT unnest([-200000000, -3, -2, -1, 0, 1, 2, 6000000]) AS b), (SELECT unnest([-1000, -999, -501, -500, -499, -1, 0, 1, 499, 500, 501, 999, 1000, 150000000]) AS d))")
    con.execute("INSERT INTO events VALUES (1000, NULL, 1, 'view', 1.0, '{}')")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = [tuple(r) for r in catalog.queries()["dt7_five_minutes"](spark, str(tmp_path)).select("bucket", "events").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    wanted = con.execute(catalog.oracle_sql()["dt7_five_minutes"]).fetchall()
    assert sorted(got, key=str) == sorted(wanted, key=str)
