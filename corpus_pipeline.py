"""A corpus pipeline: toxicity, quality rules, near-duplicates, mixing, BPE. Each stage reads what its predecessor kept.

All stages but the last return the columns of documents, others that docs may have included, whatever their names; the last
returns the token counts and digests.

Cases: a null text is an empty one: it has the score of the bias, fails the quality rules, and otherwise (as a stage's own
input) is a copy of other empty texts, comes into the mix along with its block, and has no tokens. Texts may be of any length. Rows without an id
aren't learned from and aren't judged as copies; rows of equal id and text are copies of each other, and share one fate in
the mix. A null source is a host and a source of its own. An empty table gives an empty result at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.llm import bpe, host_rules, mixing, near_copies, toxicity
from marlspike.llm.common import table
from marlspike.llm.queries import RANK_FILE

#: Columns that the stages work on; the others travel as one, so that no result column clashes with them.
USED, REST = ("doc_id", "source", "text"), "_rest_of_row"


def _packed(docs: DataFrame) -> DataFrame:
    others = [c for c in docs.columns if c not in USED]
    return docs.select(*USED, F.struct(F.lit(True).alias("there"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(others)]).alias(REST))


def _unpacked(packed: DataFrame, docs: DataFrame) -> DataFrame:
    place = {c: f"c{i}" for i, c in enumerate(c for c in docs.columns if c not in USED)}
    return packed.select(*[F.col(REST)[place[c]].alias(c) if c in place else F.col(c) for c in docs.columns])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the classifier, fitted on the labelled rows of docs, doesn't predict to be toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = toxicity.score(_packed(docs), toxicity.fit(docs.select("doc_id", "text"), labels))
    return _unpacked(scored.where("predicted = 0"), docs)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the base rules and whose host isn't rejected."""
    verdicts = host_rules.hosts(host_rules.measure(docs.select("source", "text")))
    return _unpacked(host_rules.judge(host_rules.measure(_packed(docs)), verdicts).where("kept"), docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return near_copies.deduplicate(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, in the order of its shard."""
    return _unpacked(mixing.mix(_packed(docs)), docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids' count and digests of each row; the decoded bytes are those of the text."""
    rank_file, pattern = public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN
    return bpe.round_trip(docs.select("doc_id", "source", "text"), rank_file, pattern).select(
        "doc_id",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality rules", quality_stage),
    ("near-duplicates", dedup_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: The classifier's training can't be expressed in SQL; tests compare the stages with brute force (tests/llm).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
