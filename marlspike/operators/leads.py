"""Lead processing: normalisation, tiered entity resolution, greedy de-duplication, domain resolution, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlspike import views
from marlspike.functions import text as X
from marlspike.plans import written
from marlspike.plans.components import components
from marlspike.views import with_views

BLOCK, SIMILAR, CANDIDATES = 3, 0.88, 50


def normalize(leads: DataFrame) -> DataFrame:
    """row_number, user_id and the comparable forms of a lead's fields, with their completeness."""
    site = X.domain(F.col("website"))
    out = leads.select("row_number", "user_id", "company", X.company_name(F.col("company")).alias("name"), F.when(~X.is_shared_host(site), site).alias("domain"), X.email(F.col("email")).alias("email"), X.phone(F.col("phone")).alias("phone"), F.lower(F.trim("city")).alias("city"))
    return out.withColumn("completeness", X.completeness(company=F.col("company"), site=F.col("domain"), email=F.col("email"), phone=F.col("phone"), city=F.col("city")))


def _keys() -> dict[str, Column]:
    """Keys of the exact tiers; null where the tier doesn't apply."""
    return {
        "domain_key": F.when(F.length("domain") > 3, F.col("domain")),
        "email_key": F.when(F.contains(F.col("email"), F.lit("@")), F.col("email")),
        "name_key": F.when((F.length("name") >= 3) & (F.length("city") >= 2), F.concat_ws("|", "name", "city")),
    }


def match_existing(probes: DataFrame, existing: DataFrame) -> DataFrame:
    """row_number, status, confidence, match of each probe against the leads of its tenant that are there already.

    Tiers: domain, address, name with city (DUPLICATE 1, 1, 0.95), phone (POSSIBLE 0.85), then the first of the 50
    earliest names with the same first three characters that is at least 0.88 alike. Each tier is an equi-join against
    one row for each key (the earliest lead).
    """
    keys = _keys() | {"phone_key": F.regexp_replace("phone", r"\D", "")}
    p, e = probes.withColumns(keys), existing.withColumns(keys)
    for key in keys:
        first = e.where(F.col(key).isNotNull()).groupBy("user_id", key).agg(F.min("row_number").alias(f"m_{key}"))
        p = p.join(first, ["user_id", key], "left")
    place = F.row_number().over(Window.partitionBy("user_id", "block").orderBy("row_number"))
    block = F.when(F.length("name") >= 4, F.substring("name", 1, BLOCK))
    firsts = existing.withColumn("block", F.substring("name", 1, BLOCK)).withColumn("place", place).where(F.col("place") <= CANDIDATES)
    # one comparison for each different name, whatever the number of its rows
    names = p.select("user_id", "name", block.alias("block")).where("block is not null").distinct()
    alike = _alike(names, firsts.select("user_id", "block", F.col("name").alias("other"), F.col("row_number").alias("other_row")))
    best = alike.groupBy("user_id", "name").agg(F.min(F.struct("other_row", "likeness")).alias("best"))
    p = p.join(best, ["user_id", "name"], "left")
    exact = F.coalesce("m_domain_key", "m_email_key", "m_name_key")
    status = F.when(exact.isNotNull(), "DUPLICATE").when(F.col("m_phone_key").isNotNull() | F.col("best").isNotNull(), "POSSIBLE_DUPLICATE").otherwise("UNIQUE")
    confidence = F.when(F.coalesce("m_domain_key", "m_email_key").isNotNull(), 1.0).when(F.col("m_name_key").isNotNull(), 0.95).when(F.col("m_phone_key").isNotNull(), 0.85).otherwise(F.round("best.likeness", 2))
    return p.select("row_number", status.alias("status"), confidence.alias("confidence"), F.coalesce(exact, "m_phone_key", "best.other_row").alias("match"))


def _alike(names: DataFrame, firsts: DataFrame) -> DataFrame:
    """user_id, name, other_row, likeness of names (user_id, name, block) and the firsts (user_id, block, other, other_row) of
    their block that are SIMILAR. Bigrams are made once for each name; lengths too different for the likeness go before."""
    left = names.withColumn("grams", X.bigrams(F.col("name")))
    right = firsts.withColumn("other_grams", X.bigrams(F.col("other")))
    a, b = F.size("grams"), F.size("other_grams")
    close = left.join(right, ["user_id", "block"]).where(2.0 * F.least(a, b) >= SIMILAR * (a + b))
    return close.withColumn("likeness", X.dice_of(F.col("grams"), F.col("other_grams"))).where(F.col("likeness") >= SIMILAR).select("user_id", "name", "other_row", "likeness")


#: Rows and keys of a component that one task goes through; larger ones are decided in rounds.
FOLD_PAIRS = 1 << 17


def greedy_duplicates(pairs: DataFrame) -> DataFrame:
    """row_number, match: rows that share a key with an earlier kept row, as if rows were taken one by one, from pairs (row_number, key).

    A row that is a duplicate isn't itself compared with later ones. Rows that no chain of keys connects don't concern each other: rows that
    share keys are put into components, and each component is gone through in order by one task. Components of over FOLD_PAIRS
    pairs, such as that of a key which a third of the rows have, are decided in rounds.
    """
    pairs = written(pairs.where("row_number is not null and key is not null").distinct(), "greedy-keys")
    firsts = pairs.groupBy("key").agg(F.min("row_number").alias("first"))
    edges = pairs.join(firsts, "key").select(F.col("row_number").alias("a"), F.col("first").alias("b"))
    placed = written(pairs.join(components(edges), pairs["row_number"] == F.col("node")).select("component", "row_number", "key"), "greedy-components")
    large = placed.groupBy("component").count().where(F.col("count") > FOLD_PAIRS).select("component")
    folded = _folded(placed.join(large, "component", "left_anti"))
    rest = placed.join(large, "component", "left_semi").select("row_number", "key")
    return folded if large.isEmpty() else folded.unionByName(_by_rounds(rest))


def _folded(placed: DataFrame) -> DataFrame:
    """greedy_duplicates of components: each one's rows in order, with the keys of the kept ones in memory."""
    import pyarrow as pa

    def run(batches):
        component, row, keys, owner, out = None, None, [], {}, ([], [])

        def decide():
            known = [owner[k] for k in keys if k in owner]
            if known:
                out[0].append(row)
                out[1].append(min(known))
            else:
                owner.update(dict.fromkeys(keys, row))

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["row_number", "match"])
            for x in out:
                x.clear()
            return batch

        for batch in batches:
            for c, r, k in zip(*[batch.column(n).to_pylist() for n in ("component", "row_number", "key")]):
                if r != row or c != component:
                    decide()
                    if c != component:
                        component, owner = c, {}
                    row, keys = r, []
                keys.append(k)
            if out[0]:
                yield flush()
        decide()
        if out[0]:
            yield flush()

    return placed.repartition("component").sortWithinPartitions("component", "row_number").mapInArrow(run, "row_number long, match long")


def _by_rounds(pairs: DataFrame) -> DataFrame:
    """greedy_duplicates in rounds: a row that is the first open one under each of its keys is kept; open rows that share a key with it are
    duplicates. As many rounds as the longest chain of decisions; a row behind a hot key leaves in the first."""
    pairs = written(pairs, "greedy-pairs")
    kept, open_pairs = None, pairs
    while not open_pairs.isEmpty():
        first = open_pairs.groupBy("key").agg(F.min("row_number").alias("first"))
        judged = written(open_pairs.join(first, "key"), "greedy-round")
        winners = written(judged.groupBy("row_number").agg(F.bool_and(F.col("row_number") == F.col("first")).alias("won")).where("won").select("row_number"), "greedy-kept")
        kept = winners if kept is None else kept.unionByName(winners)
        hit = judged.join(winners.select(F.col("row_number").alias("first")), "first").select("row_number").distinct()
        open_pairs = written(open_pairs.join(hit, "row_number", "left_anti"), "greedy-open")
    if kept is None:
        return pairs.select("row_number", F.col("row_number").alias("match")).where("false")
    # a key has one kept row at most; of those before a row the first is its match
    owners = pairs.join(kept, "row_number", "left_semi").select("key", F.col("row_number").alias("match"))
    return pairs.join(kept, "row_number", "left_anti").join(owners, "key").where("match < row_number").groupBy("row_number").agg(F.min("match").alias("match"))


def dedupe_batch(leads: DataFrame) -> DataFrame:
    """row_number, status, match within one batch, as if rows were taken one by one.

    A row that shares a key of the exact tiers with an earlier accepted row is a DUPLICATE and is not itself compared
    with later ones; accepted rows may be POSSIBLE_DUPLICATEs of earlier accepted ones.
    """
    long = F.explode(F.array_compact(F.array(*[F.when(c.isNotNull(), F.concat_ws("=", F.lit(k), F.col("user_id").cast("string"), c)) for k, c in _keys().items()])))
    gone = written(greedy_duplicates(leads.select("row_number", long.alias("key"))), "dedupe-gone")
    possible = _possible(leads.join(gone.select("row_number"), "row_number", "left_anti"))
    return possible.unionByName(gone.select("row_number", F.lit("DUPLICATE").alias("status"), "match"))


def _possible(accepted: DataFrame) -> DataFrame:
    """row_number, status, match of accepted rows: POSSIBLE_DUPLICATE with an earlier one by phone, else by a likeness of names.

    The first row of a phone, and the first alike row among a block's first 50, decide; they count if they come earlier.
    """
    digits = F.regexp_replace("phone", r"\D", "")
    block = F.when(F.length("name") >= BLOCK + 1, F.substring("name", 1, BLOCK))
    rows = accepted.select("row_number", "user_id", "name", digits.alias("phone_key"), block.alias("block"))
    phones = rows.where("phone_key is not null").groupBy("user_id", "phone_key").agg(F.min("row_number").alias("by_phone"))
    place = F.row_number().over(Window.partitionBy("user_id", "prefix").orderBy("row_number"))
    firsts = rows.withColumn("prefix", F.substring("name", 1, BLOCK)).withColumn("place", place).where(F.col("place") <= CANDIDATES).select("user_id", F.col("prefix").alias("block"), F.col("name").alias("other"), F.col("row_number").alias("other_row"))
    names = rows.where("block is not null").select("user_id", "name", "block").distinct()
    alike = _alike(names, firsts).groupBy("user_id", "name").agg(F.min("other_row").alias("by_name"))
    joined = rows.join(phones, ["user_id", "phone_key"], "left").join(alike, ["user_id", "name"], "left")
    earlier = lambda c: F.when(F.col(c) < F.col("row_number"), F.col(c))
    match = F.coalesce(earlier("by_phone"), earlier("by_name"))
    return joined.select("row_number", F.when(match.isNull(), "UNIQUE").otherwise("POSSIBLE_DUPLICATE").alias("status"), match.alias("match"))


def resolve(leads: DataFrame, organizations: DataFrame, prior: DataFrame, search: DataFrame) -> DataFrame:
    """row_number, resolved, source, resolution: a company's domain from its first own site, the known organizations, leads that were
    resolved before, or the search table.

    One decision for each tenant and name, taken by the name's first row, and joined back to all its rows. Known names are
    met by any of the name's variants (as given, without its relation, each also in comparable form), whatever the case.
    organizations, prior: user_id, name, domain. search: name, domain, score.
    """
    base = X.company_division(F.col("company"))["base"]
    variants = F.array_distinct(F.array(F.lower(F.trim("company")), "name", F.lower(base), X.company_name(base)))
    first = leads.withColumn("_n", F.row_number().over(Window.partitionBy("user_id", "name").orderBy("row_number"))).where("_n = 1").select("user_id", "name", F.col("domain").alias("own"), variants.alias("variants"))
    forms = first.select("user_id", "name", F.explode("variants").alias("form"))

    def met(known: DataFrame, to: str) -> DataFrame:
        usable = known.withColumn("form", F.lower("name")).where(~X.is_shared_host(F.col("domain"))).groupBy("user_id", "form").agg(F.min("domain").alias(to))
        return forms.join(usable, ["user_id", "form"]).groupBy("user_id", "name").agg(F.min(to).alias(to))

    found = search.groupBy("name").agg(F.max(F.struct("score", "domain")).alias("top"), F.count(F.lit(1)).alias("candidates"))
    joined = first.join(met(organizations, "known"), ["user_id", "name"], "left").join(met(prior, "before"), ["user_id", "name"], "left").join(found, "name", "left")
    weak = (F.col("candidates") == 1) & (F.col("top.score") < 0.75)
    stored = F.coalesce("known", "before")
    source = F.when(F.col("own").isNotNull(), "DIRECTORY").when(stored.isNotNull(), "DATABASE").when(F.col("top").isNotNull(), "SEARCH")
    level = F.when(F.coalesce(F.col("own"), stored).isNotNull(), "RESOLVED_HIGH").when(F.col("top").isNull(), "UNRESOLVED").when(weak, "REVIEW_REQUIRED").when(F.col("top.score") >= 0.9, "RESOLVED_MEDIUM").otherwise("RESOLVED_LOW")
    domain = F.coalesce(F.col("own"), stored, F.when(level != "REVIEW_REQUIRED", F.col("top.domain")))
    decided = joined.select("user_id", "name", domain.alias("resolved"), source.alias("source"), level.alias("resolution"))
    return leads.select("row_number", "user_id", "name").join(decided, ["user_id", "name"]).drop("user_id", "name")


def _leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(views.lead(spark, sf_dir))


def f08_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leads(spark, sf_dir)


def f09_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of each lead's name, as given, with that of the lead seven rows on."""
    n = views.lead(spark, sf_dir).select("row_number", "company")
    other = n.select((F.col("row_number") - 7).alias("row_number"), F.col("company").alias("other"))
    return n.join(other, "row_number").select("row_number", F.round(X.dice(F.col("company"), F.col("other")), 6).alias("likeness"))


def f10_root_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leads(spark, sf_dir).where("domain is not null").groupBy(X.root_domain(F.col("domain")).alias("root")).agg(F.count(F.lit(1)).alias("leads"))


def f17_header_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "<").otherwise(" "), F.lit("Msg"), "s_suppkey", F.lit("@Mail.example"), F.when(F.col("s_suppkey") % 2 == 0, ">").otherwise(" "))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.explode(X.header_ids(raw)).alias("form"))


def f20_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", X.string_hash(F.col("c_name")).alias("hashed"))


def normalized_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leads in normal form as a table, for queries that use them more than once."""
    return written(_leads(spark, sf_dir), "normalized")


def _matched(leads: DataFrame) -> DataFrame:
    return match_existing(leads.where("row_number % 3 = 0"), leads.where("row_number % 3 <> 0"))


def j13_er_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(_leads(spark, sf_dir))


def a27_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of an ingest run: possible duplicates are valid."""
    s = F.col("status")
    return j13_er_tiers(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), F.count_if(s != "DUPLICATE").alias("valid"), F.count_if(s == "DUPLICATE").alias("duplicate"), F.count_if(s == "POSSIBLE_DUPLICATE").alias("possible"))


def d03_dedupe_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe_batch(_leads(spark, sf_dir))


def _resolved(leads: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    label = F.concat(F.lit("nova "), F.element_at(F.array(*[F.lit(x) for x in ("textile", "software", "global", "marine", "solar")]), (k % 5 + 1).cast("int")), F.lit(" "), k % 211)
    spelled = F.when(k % 8 == 4, F.concat(F.upper(label), F.lit(" LTD"))).otherwise(label)
    organizations = part.where("p_partkey % 4 = 0").select((k % 2).alias("user_id"), spelled.alias("name"), F.when(k % 20 == 0, "www.facebook.com").otherwise(F.concat(F.lit("org"), k % 17, F.lit(".example"))).alias("domain"))
    prior = part.where("p_partkey % 4 = 3").select((k % 2).alias("user_id"), label.alias("name"), F.concat(F.lit("prior"), k % 13, F.lit(".example")).alias("domain"))
    search = part.where("p_partkey % 4 = 1").select(label.alias("name"), F.concat(F.lit("found"), k % 19, F.lit(".example")).alias("domain"), ((k * 37 % 100) / 100.0).alias("score"))
    return resolve(leads, organizations, prior, search)


def d04_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(_leads(spark, sf_dir), spark, sf_dir)


def resolved_leads(spark: SparkSession, sf_dir: str, matched: bool = False) -> DataFrame:
    """Leads in normal form with their resolution and, if asked for, their status against the known ones (probes alone then): normalised once."""
    leads = normalized_once(spark, sf_dir)
    out = leads.join(_resolved(leads, spark, sf_dir), "row_number")
    return out.join(_matched(leads), "row_number") if matched else out


def d15_rerun_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a rerun that stay: neither name nor domain is in the batch, and no earlier row of the run has them."""
    leads = _leads(spark, sf_dir)
    before, run = leads.where("row_number < 100"), leads.where("row_number >= 100")
    fresh = run.join(before.select("name").distinct(), "name", "left_anti").join(before.where("domain is not null").select("domain").distinct(), "domain", "left_anti")
    keys = F.explode(F.array_compact(F.array(F.concat(F.lit("n:"), "name"), F.concat(F.lit("d:"), "domain"))))
    earlier = Window.partitionBy("key")
    pairs = fresh.select("row_number", keys.alias("key")).withColumn("first", F.min("row_number").over(earlier))
    return pairs.groupBy("row_number").agg(F.bool_and(F.col("row_number") == F.col("first")).alias("kept")).where("kept").select("row_number")


def d14_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known leads (even rows) completed from the next row: only empty fields are filled."""
    leads = _leads(spark, sf_dir)
    old = leads.where("row_number % 2 = 0")
    new = leads.where("row_number % 2 = 1").select((F.col("row_number") - 1).alias("row_number"), *[F.col(c).alias(f"new_{c}") for c in ("domain", "email", "phone")])
    return old.join(new, "row_number", "left").select("row_number", *[F.coalesce(X.blank_to_null(F.col(c)), F.col(f"new_{c}")).alias(c) for c in ("domain", "email", "phone")])


QUERIES = {f.__name__: f for f in (f08_normalize, f09_dice, f10_root_domain, f17_header_ids, f20_hash, j13_er_tiers, a27_ingest, d03_dedupe_batch, d04_resolve, d15_rerun_guard, d14_merge)}

_NORMAL = """
z AS (SELECT *, lower(trim(regexp_replace(regexp_replace(regexp_replace(company, '(, LLC| GmbH & Co. KG| Pvt. Ltd.| Ltd)$', ''), '[^a-zA-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))) AS raw_name FROM lead),
n AS (SELECT row_number, user_id, company, raw_name AS name, nullif(regexp_extract(coalesce(website, ''), 'nova[0-9]+[.]example[.]co[.]uk'), '') AS domain, replace(lower(email), 'mailto:', '') AS email,
  '+' || regexp_replace(phone, '[^0-9]', '', 'g') AS phone, lower(trim(city)) AS city,
  (25 + CASE WHEN website IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN email IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN phone IS NOT NULL THEN 10 ELSE 0 END + 5) / 100.0::DOUBLE AS completeness FROM z)"""
_TIERS = f"WITH {_NORMAL}," + """
e AS (SELECT * FROM n WHERE row_number % 3 <> 0), p AS (SELECT * FROM n WHERE row_number % 3 = 0),
f AS (SELECT user_id, left(name, 3) AS block, name, row_number AS r FROM e QUALIFY row_number() OVER (PARTITION BY user_id, left(name, 3) ORDER BY row_number) <= 50),
g AS (SELECT s, count(*) AS c, bg FROM (SELECT s, substr(t, i::INTEGER, 2) AS bg FROM (SELECT DISTINCT s, t, unnest(range(1, length(t))) AS i FROM (SELECT name AS s, replace(name, ' ', '') AS t FROM n))) GROUP BY ALL),
d AS (SELECT q.user_id, q.name, f.r, CASE WHEN replace(q.name, ' ', '') = replace(f.name, ' ', '') THEN 1.0 ELSE 2.0 * coalesce((SELECT sum(least(a.c, b.c)) FROM g a JOIN g b USING (bg) WHERE a.s = q.name AND b.s = f.name), 0) / (length(replace(q.name, ' ', '')) + length(replace(f.name, ' ', '')) - 2) END AS likeness
  FROM (SELECT DISTINCT user_id, name FROM p WHERE length(name) >= 4) q JOIN f ON f.user_id = q.user_id AND f.block = left(q.name, 3)),
b AS (SELECT user_id, name, min(r) AS r, arg_min(likeness, r) AS likeness FROM d WHERE likeness >= 0.88 GROUP BY 1, 2),
m AS (SELECT p.row_number, (SELECT min(e.row_number) FROM e WHERE e.user_id = p.user_id AND e.domain = p.domain) AS a1, (SELECT min(e.row_number) FROM e WHERE e.user_id = p.user_id AND e.email = p.email) AS a2,
  (SELECT min(e.row_number) FROM e WHERE e.user_id = p.user_id AND e.name = p.name AND e.city = p.city) AS a3, (SELECT min(e.row_number) FROM e WHERE e.user_id = p.user_id AND e.phone = p.phone) AS a4, b.r AS a5, b.likeness FROM p LEFT JOIN b ON b.user_id = p.user_id AND b.name = p.name),
matched AS (SELECT row_number, CASE WHEN coalesce(a1, a2, a3) IS NOT NULL THEN 'DUPLICATE' WHEN coalesce(a4, a5) IS NOT NULL THEN 'POSSIBLE_DUPLICATE' ELSE 'UNIQUE' END AS status,
  CASE WHEN coalesce(a1, a2) IS NOT NULL THEN 1.0 WHEN a3 IS NOT NULL THEN 0.95 WHEN a4 IS NOT NULL THEN 0.85 ELSE round(likeness, 2) END::DOUBLE AS confidence, coalesce(a1, a2, a3, a4, a5) AS match FROM m)"""
_RESOLVED = """
l AS (SELECT p_partkey AS k, 'nova ' || (['textile', 'software', 'global', 'marine', 'solar'])[p_partkey % 5 + 1] || ' ' || (p_partkey % 211) AS name FROM part),
o AS (SELECT k % 2 AS user_id, CASE WHEN k % 8 = 4 THEN name || ' ltd' ELSE name END AS name, min('org' || (k % 17) || '.example') AS known FROM l WHERE k % 4 = 0 AND k % 20 <> 0 GROUP BY 1, 2),
w AS (SELECT k % 2 AS user_id, name, min('prior' || (k % 13) || '.example') AS before FROM l WHERE k % 4 = 3 GROUP BY 1, 2),
s AS (SELECT name, max((k * 37 % 100) / 100.0::DOUBLE) AS score, count(*) AS c FROM l WHERE k % 4 = 1 GROUP BY 1),
t AS (SELECT l.name, max('found' || (k % 19) || '.example') AS domain FROM l JOIN s ON s.name = l.name AND (k * 37 % 100) / 100.0::DOUBLE = s.score WHERE k % 4 = 1 GROUP BY 1),
first AS (SELECT user_id, name, domain AS own, lower(company) AS given FROM n QUALIFY row_number() OVER (PARTITION BY user_id, name ORDER BY row_number) = 1),
v AS (SELECT f.user_id, f.name, min(own) AS own, min(known) AS known, min(before) AS before FROM first f LEFT JOIN o ON o.user_id = f.user_id AND o.name IN (f.name, f.given) LEFT JOIN w ON w.user_id = f.user_id AND w.name IN (f.name, f.given) GROUP BY 1, 2),
r AS (SELECT v.*, score, c, t.domain AS found, CASE WHEN coalesce(own, known, before) IS NOT NULL THEN 'RESOLVED_HIGH' WHEN score IS NULL THEN 'UNRESOLVED' WHEN c = 1 AND score < 0.75 THEN 'REVIEW_REQUIRED' WHEN score >= 0.9 THEN 'RESOLVED_MEDIUM' ELSE 'RESOLVED_LOW' END AS resolution
  FROM v LEFT JOIN s ON s.name = v.name LEFT JOIN t ON t.name = v.name),
resolutions AS (SELECT n.row_number, coalesce(own, known, before, CASE WHEN resolution <> 'REVIEW_REQUIRED' THEN found END) AS resolved, CASE WHEN own IS NOT NULL THEN 'DIRECTORY' WHEN coalesce(known, before) IS NOT NULL THEN 'DATABASE' WHEN score IS NOT NULL THEN 'SEARCH' END AS source, resolution FROM n JOIN r ON r.user_id = n.user_id AND r.name = n.name)"""
ORACLES = {
    "f08_normalize": with_views("lead", f"WITH {_NORMAL} SELECT * FROM n"),
    "f10_root_domain": with_views("lead", "SELECT 'example.co.uk' AS root, count(*) AS leads FROM lead WHERE website IS NOT NULL"),
    "f17_header_ids": "SELECT DISTINCT s_suppkey, unnest([CASE WHEN s_suppkey % 2 = 0 THEN '<Msg' || s_suppkey || '@Mail.example>' ELSE 'Msg' || s_suppkey || '@Mail.example' END, 'Msg' || s_suppkey || '@Mail.example', 'msg' || s_suppkey || '@mail.example', '<Msg' || s_suppkey || '@Mail.example>', '<msg' || s_suppkey || '@mail.example>']) AS form FROM supplier",
    "f20_hash": "SELECT c_custkey, (CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END)::INTEGER AS hashed FROM (SELECT c_custkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) AS h FROM customer)",
    "j13_er_tiers": with_views("lead", _TIERS + " SELECT * FROM matched"),
    "a27_ingest": with_views("lead", _TIERS + " SELECT count(*) AS total, count(*) FILTER (WHERE status <> 'DUPLICATE') AS valid, count(*) FILTER (WHERE status = 'DUPLICATE') AS duplicate, count(*) FILTER (WHERE status = 'POSSIBLE_DUPLICATE') AS possible FROM matched"),
    "f09_dice": with_views("lead", """WITH t AS (SELECT row_number AS r, lower(replace(company, ' ', '')) AS t FROM lead), g AS (SELECT r, bg, count(*) AS c FROM (SELECT r, substr(t, unnest(range(1, length(t)))::INTEGER, 2) AS bg FROM t) GROUP BY 1, 2),
s AS (SELECT a.r, sum(least(a.c, b.c)) AS n FROM g a JOIN g b ON b.r = a.r + 7 AND b.bg = a.bg GROUP BY 1) SELECT a.r AS row_number, round(CASE WHEN a.t = b.t THEN 1 ELSE 2.0 * coalesce(n, 0) / (length(a.t) + length(b.t) - 2) END, 6)::DOUBLE AS likeness FROM t a JOIN t b ON b.r = a.r + 7 LEFT JOIN s ON s.r = a.r"""),
    # one row after the other for the keys, then phones and names of those that were kept
    "d03_dedupe_batch": with_views("lead", f"WITH {_NORMAL}," + """
ks AS (SELECT row_number, row_number() OVER (ORDER BY row_number) AS k, list_filter([CASE WHEN length(domain) > 3 THEN 'd' || user_id || domain END, CASE WHEN contains(email, '@') THEN 'e' || user_id || email END, CASE WHEN length(name) >= 3 AND length(city) >= 2 THEN 'n' || user_id || name || '|' || city END], lambda x: x IS NOT NULL) AS keys FROM n),
fold AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS row_number, []::VARCHAR[] AS seen, []::BIGINT[] AS owner, NULL::BIGINT AS match
  UNION ALL SELECT k, row_number, CASE WHEN hit IS NULL THEN list_concat(seen, keys) ELSE seen END, CASE WHEN hit IS NULL THEN list_concat(owner, list_transform(keys, lambda x: row_number)) ELSE owner END, hit
  FROM (SELECT s.*, fold.seen, fold.owner, list_min(list_transform(s.keys, lambda x: fold.owner[list_position(fold.seen, x)])) AS hit FROM fold JOIN ks s ON s.k = fold.k + 1)),
a AS (SELECT * FROM n WHERE row_number IN (SELECT row_number FROM fold WHERE match IS NULL AND k > 0)),
first AS (SELECT user_id, left(name, 3) AS block, name, row_number AS r FROM a QUALIFY row_number() OVER (PARTITION BY user_id, left(name, 3) ORDER BY row_number) <= 50),
g AS (SELECT s, count(*) AS c, bg FROM (SELECT s, substr(t, i::INTEGER, 2) AS bg FROM (SELECT DISTINCT s, t, unnest(range(1, length(t))) AS i FROM (SELECT name AS s, replace(name, ' ', '') AS t FROM a))) GROUP BY ALL),
likeness AS (SELECT q.user_id, q.name, f.r, CASE WHEN replace(q.name, ' ', '') = replace(f.name, ' ', '') THEN 1.0 ELSE 2.0 * coalesce((SELECT sum(least(x.c, y.c)) FROM g x JOIN g y USING (bg) WHERE x.s = q.name AND y.s = f.name), 0) / (length(replace(q.name, ' ', '')) + length(replace(f.name, ' ', '')) - 2) END AS alike
  FROM (SELECT DISTINCT user_id, name FROM a WHERE length(name) >= 4) q JOIN first f ON f.user_id = q.user_id AND f.block = left(q.name, 3)),
m AS (SELECT a.row_number, (SELECT min(b.row_number) FROM a b WHERE b.user_id = a.user_id AND b.phone = a.phone) AS by_phone, (SELECT min(r) FROM likeness l WHERE l.user_id = a.user_id AND l.name = a.name AND alike >= 0.88) AS by_name FROM a),
e AS (SELECT row_number, coalesce(CASE WHEN by_phone < row_number THEN by_phone END, CASE WHEN by_name < row_number THEN by_name END) AS match FROM m)
SELECT row_number, CASE WHEN match IS NULL THEN 'UNIQUE' ELSE 'POSSIBLE_DUPLICATE' END AS status, match FROM e UNION ALL SELECT row_number, 'DUPLICATE', match FROM fold WHERE match IS NOT NULL""").replace("WITH lead AS", "WITH RECURSIVE lead AS", 1),
    "d04_resolve": with_views("lead", f"WITH {_NORMAL}, {_RESOLVED} SELECT * FROM resolutions"),
    "d15_rerun_guard": with_views("lead", f"WITH {_NORMAL}, o AS (SELECT * FROM n WHERE row_number < 100), f AS (SELECT * FROM n WHERE row_number >= 100 AND name NOT IN (SELECT name FROM o) AND (domain IS NULL OR domain NOT IN (SELECT domain FROM o WHERE domain IS NOT NULL))) SELECT row_number FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.row_number < f.row_number AND (g.name = f.name OR g.domain = f.domain))"),
    "d14_merge": with_views("lead", f"WITH {_NORMAL} SELECT a.row_number, coalesce(a.domain, b.domain) AS domain, coalesce(a.email, b.email) AS email, coalesce(a.phone, b.phone) AS phone FROM n a LEFT JOIN n b ON b.row_number = a.row_number + 1 WHERE a.row_number % 2 = 0"),
}
