"""The registered queries opN_<name>: thin uses of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.llm import bpe, host_rules, licenses, mixing, negatives, ngram_lm, oracles, prefix_trie, simhash, substrings, syncmers, token_edits, toxicity, warc
from marlspike.llm.common import crc_mod, documents, table

RANK_FILE = "byte_bpe_50k.tiktoken"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(crc_mod("doc_id", 3) != 1)
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.successor_edits(documents(spark, sf_dir).select("doc_id", "text"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank_file, pattern = public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN
    return bpe.round_trip(documents(spark, sf_dir).select("doc_id", "text"), rank_file, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, folder = warc.archive(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    whole = warc.read_archives(spark, manifest, folder).where("last")
    return whole.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.assign(documents(spark, sf_dir).select("doc_id", "source", "text")).select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", "taken", F.array_join(F.col("shards").cast("array<string>"), ",").alias("shards"))


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", *host_rules.MEASURED]
    measured = table(host_rules.measure(documents(spark, sf_dir).select("doc_id", "source", "text")).select("source", *columns), "quality")
    return host_rules.judge(measured, host_rules.hosts(measured)).select(*[c for c in columns if c != "n_lines"], "kept", "n_lines")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(simhash.fingerprints(documents(spark, sf_dir).select("doc_id", "text")), "simhash-found")
    return simhash.components(found).select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir).select("doc_id", "text")).withColumn("score", F.round("score", 9))


def op9_token_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text before and after three edits: from a third of its characters on a twentieth is
    replaced by its first 40 characters; then the text gets " edited" at its end; then its first character goes."""
    rank_file, pattern = public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN
    n = F.length("text")

    def edit(start, removed, inserted):
        return F.struct(start.cast("int").alias("start"), removed.cast("int").alias("removed"), inserted.alias("inserted"))

    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    middle, taken = F.floor(n / 3), F.floor(n / 20)
    grown = n - taken + F.least(n, F.lit(40))
    edits = F.array(edit(middle, taken, F.substring("text", 1, 40)), edit(grown, F.lit(0), F.lit(" edited")), edit(F.lit(0), F.lit(1), F.lit("")))
    edited = token_edits.apply_edits(token_edits.build_trees(docs.withColumn("edits", edits), rank_file, pattern), rank_file, pattern)
    return edited.select("doc_id", n.cast("long").alias("n_chars"), "n_tokens", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), "edited_tokens", F.size("tree.tokens").cast("long").alias("n_leaves"), "encoded_chars")


def op10_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = ngram_lm.fit(docs.where(crc_mod("doc_id", 10) != 0))
    return ngram_lm.score(docs, model).select("doc_id", F.coalesce(crc_mod("doc_id", 10) == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substrings.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda vec_id: vec_id % 100 == 0, label=label)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = prefix_trie.sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    nodes = prefix_trie.nodes(prefix_trie.rebuilt(found))
    return nodes.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_toxicity, op2_syncmers, op3_byte_bpe, op4_warc, op5_mixing, op6_host_rules, op7_simhash, op8_licenses, op9_token_edits, op10_ngram_lm, op11_substrings, op12_negatives, op13_prefix_trie)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
