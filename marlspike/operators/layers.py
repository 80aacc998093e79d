"""Layers of an ingest as tables that change: raw rows, normalised leads, leads that are new; writes by key over such tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike import views
from marlspike.operators import audience as A
from marlspike.operators import leads as L
from marlspike.operators import rules as R
from marlspike.plans import shared_folder
from marlspike.plans.tables import BUCKETS, Table, delete_cascade

BRONZE = "row_number long, user_id long, company string, website string, email string, phone string, city string, parse_status string"
SILVER = "row_number long, user_id long, company string, name string, domain string, email string, phone string, city string, completeness double"
GOLD = "row_number long, status string, confidence double, match long"


def _schema(spark: SparkSession, text: str):
    return spark.createDataFrame([], text).schema


def layers(spark: SparkSession, folder: str, buckets: int = BUCKETS) -> dict[str, Table]:
    return {n: Table(spark, f"{folder}/{n}", _schema(spark, s), ["row_number"], buckets) for n, s in (("bronze", BRONZE), ("silver", SILVER), ("gold", GOLD))}


def ingest(raw: DataFrame, folder: str, is_probe: Column, buckets: int = BUCKETS) -> dict[str, Table]:
    """Enters raw rows (as BRONZE, without its status) and brings the layers behind up to date.

    Each layer is written after the one that it comes from, and what it takes are the buckets that differ from the version it last
    took: a run that failed half way is made up by the next. Leads that is_probe picks are matched against the others.
    """
    spark = raw.sparkSession
    t = layers(spark, folder, buckets)
    bronze, silver, gold = t["bronze"], t["silver"], t["gold"]
    bronze.upsert(raw.withColumn("parse_status", F.when(F.col("company").isNull(), "FAILED").otherwise("PARSED")))
    # the version of bronze that silver has taken is the key of its own table of marks
    marks = Table(spark, f"{folder}/marks", _schema(spark, "name string, version long"), ["name"], buckets=1)
    taken = {r["name"]: r["version"] for r in marks.read().collect()}  # one row
    now = bronze.version()
    changed = bronze.changed_since(taken.get("silver", -1))
    if changed:
        rows = bronze.read(buckets=changed)
        silver.delete(rows.where("parse_status = 'FAILED'").select("row_number"))
        silver.upsert(L.normalize(rows.where("parse_status = 'PARSED'")))
        leads = silver.read()
        probes, existing = leads.where(is_probe), leads.where(~is_probe)
        gold.delete(gold.read().join(probes, "row_number", "left_anti").select("row_number"))
        gold.upsert(L.match_existing(probes, existing))
        marks.upsert(spark.createDataFrame([("silver", now)], "name string, version long"))
    return t


def counters(t: dict[str, Table]) -> DataFrame:
    """layer, n_rows, accepted, refused."""
    good = {"bronze": F.col("parse_status") == "PARSED", "silver": F.col("completeness") >= 0.3, "gold": F.col("status") != "DUPLICATE"}
    parts = [t[n].read().agg(F.lit(n).alias("layer"), F.count(F.lit(1)).alias("n_rows"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("refused")) for n, ok in good.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"


def d01_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the layers after two runs: the second mends the companies of every 29th row."""
    raw = views.lead(spark, sf_dir).withColumn("company", F.when(F.col("row_number") % 23 != 0, F.col("company")))
    folder, is_probe = _folder(spark), F.col("row_number") % 3 == 0
    ingest(raw.withColumn("company", F.when(F.col("row_number") % 29 != 0, F.col("company"))), folder, is_probe, buckets=8)
    return counters(ingest(raw.where("row_number % 29 = 0"), folder, is_probe, buckets=8))


def s17_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s17_insert_ignore in a table."""
    old = views.enrollment(spark, sf_dir).where(F.col("campaign_id") == A.CAMPAIGN).select("campaign_id", "contact_id", "status")
    t = Table(spark, _folder(spark), old.schema, ["campaign_id", "contact_id"], buckets=8)
    t.upsert(old)
    t.insert_ignore(A.union_lists(views.list_member(spark, sf_dir), A.LISTS).select(F.lit(A.CAMPAIGN).cast("long").alias("campaign_id"), "contact_id", F.lit("pending").alias("status")))
    return t.read()


def s18_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s18_upsert in a table."""
    old = views.suppression(spark, sf_dir).select("normalized_email", "reason", F.lit(1).alias("at"))
    t = Table(spark, _folder(spark), old.schema, ["normalized_email"], buckets=8)
    t.upsert(old)
    t.upsert(views.contact_email(spark, sf_dir).where("bounce_count > 0").groupBy("normalized_email").agg(F.lit("hard_bounce").alias("reason"), F.max("bounce_count").alias("at")), order="at")
    return t.read()


def s19_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts, their addresses and memberships as tables, after every seventh contact is deleted."""
    rows = {"contact": (views.contact(spark, sf_dir), ["id"]), "contact_email": (views.contact_email(spark, sf_dir), ["id"]), "list_member": (views.list_member(spark, sf_dir), ["list_id", "contact_id"])}
    tables = {}
    for name, (df, keys) in rows.items():
        tables[name] = Table(spark, _folder(spark), df.schema, keys, buckets=8)
        tables[name].upsert(df)
    delete_cascade(rows["contact"][0].where("id % 7 = 0").select("id"), tables["contact"], (tables["contact_email"], "contact_id"), (tables["list_member"], "contact_id"))
    parts = [t.read().agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows")) for name, t in tables.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUERIES = {f.__name__: f for f in (d01_tables, s17_table, s18_table, s19_table)}
ORACLES = {
    "d01_tables": R.ORACLES["d01_layers"],
    "s17_table": A.ORACLES["s17_insert_ignore"],
    "s18_table": A.ORACLES["s18_upsert"],
    "s19_table": views.with_views("contact contact_email list_member", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t} WHERE {c} NOT IN (SELECT id FROM contact WHERE id % 7 = 0)" for t, c in (("contact", "id"), ("contact_email", "contact_id"), ("list_member", "contact_id")))),
}
