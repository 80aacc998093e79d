"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, adjacent word pairs and pairs with one word between. Shards of
a sample of labelled rows, bounded in rows and in features, are trained side by side, each by FTRL-proximal (a learning rate of its own for each
coordinate, L1 for sparsity); the shards' weights are averaged. What is broadcast are the non-zero weights: at most
2**bits pairs of index and weight, in practice some thousands.

Cases: a null or empty text has no feature and gets the score of the bias; rows without an id can't be labelled; of
several labels of one id the largest holds; without labelled rows every score is 0.5; repeated rows score alike; input
columns named like a result column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlspike.llm import textvec
from marlspike.llm.common import map_arrow, table, without

BITS = 22
#: Bound of the sample of labelled rows that a model is fitted on (expected number of rows).
FIT_ROWS = 16_384
#: Bound of the features (distinct in their row) of all rows of that sample.
FIT_FEATURES = 1 << 25
#: Rows of the sample that one shard should hold, at most SHARDS shards.
SHARD_ROWS, SHARDS = 2_048, 8
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.0
#: One row of so many is kept from training and calibrates the scores.
CALIBRATION = 5
THRESHOLD = 0.7


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature index of each word, pair and skip-pair; repeats included."""
    h, at = textvec.words(data, offsets)
    row = textvec.row_of(at)
    shift = np.uint64(64 - bits)
    rows, index = [row], [h >> shift]
    for gap, salt in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        if len(h) > gap:
            same = row[gap:] == row[:-gap]
            index.append(textvec.mix(h[:-gap][same] * np.uint64(salt) + h[gap:][same]) >> shift)
            rows.append(row[gap:][same])
    return np.concatenate(rows), np.concatenate(index).astype(np.int64)


def _distinct(rows: np.ndarray, index: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique((rows.astype(np.int64) << bits) | index)
    return key >> bits, key & ((1 << bits) - 1)


def row_features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> list[np.ndarray]:
    """The distinct feature indices of each row, ascending."""
    out: list[np.ndarray] = []
    for first, last in textvec.slices(offsets):
        part = offsets[first : last + 1]
        rows, index = _distinct(*features(data[part[0] : part[-1]], part - part[0], bits), bits)
        out += np.split(index.astype(np.int32), np.searchsorted(rows, np.arange(1, last - first)))
    return out


def train_shard(examples: list[np.ndarray], labels: list[int], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over rows of feature indices in the given order: indices and weights that aren't zero, and the bias.

    State is kept for the features that the rows have, not for all that there could be.
    """
    own, place = np.unique(np.concatenate([np.zeros(0, np.int32), *examples]), return_inverse=True)
    examples = np.split(place.astype(np.int32), np.cumsum([len(e) for e in examples])[:-1])
    z, n = np.zeros(len(own)), np.zeros(len(own))
    bias_z = bias_n = 0.0

    def weight(zi, ni):
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(epochs):
        for index, label in zip(examples, labels, strict=True):
            zi, ni = z[index], n[index]
            w = weight(zi, ni)
            bias = -bias_z / ((BETA + bias_n**0.5) / ALPHA)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30)))
            g = p - label
            root = np.sqrt(ni + g * g)
            z[index] = zi + g - (root - np.sqrt(ni)) / ALPHA * w
            n[index] = ni + g * g
            bias_root = (bias_n + g * g) ** 0.5
            bias_z += g - (bias_root - bias_n**0.5) / ALPHA * bias
            bias_n += g * g
    kept = np.flatnonzero(np.abs(z) > L1)
    return own[kept].astype(np.int64), weight(z[kept], n[kept]), float(-bias_z / ((BETA + bias_n**0.5) / ALPHA))


def margins(data: np.ndarray, offsets: np.ndarray, index: np.ndarray, weight: np.ndarray, bias: float, bits: int = BITS) -> np.ndarray:
    """The model's log-odds of each row, before calibration; index ascends."""
    total = np.full(len(offsets) - 1, bias)
    known = np.zeros(1 << bits, bool)
    known[index] = True
    for first, last in textvec.slices(offsets):
        part = offsets[first : last + 1]
        rows, found = features(data[part[0] : part[-1]], part - part[0], bits)
        hit = known[found]
        rows, found = _distinct(rows[hit], found[hit], bits)
        total[first:last] += np.bincount(rows, weight[np.searchsorted(index, found)], last - first)
    return total


def calibrate(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through rows that weren't trained on, with targets smoothed by the class sizes."""
    toxic, clean = int(label.sum()), int(len(label) - label.sum())
    if not toxic or not clean:
        return 1.0, 0.0
    target = np.where(label > 0, (toxic + 1) / (toxic + 2), 1 / (clean + 2))
    theta, x = np.array([1.0, 0.0]), np.stack([margin, np.ones(len(margin))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2), x @ (p - target) + 1e-3 * (theta - [1.0, 0.0]))
        theta = theta - np.clip(step, -1, 1)
    return (float(theta[0]), float(theta[1])) if theta[0] > 0 else (1.0, 0.0)


Model = tuple[np.ndarray, np.ndarray, float, float, float]
NO_MODEL: Model = (np.zeros(0, np.int64), np.zeros(0), 0.0, 1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_features: int = FIT_FEATURES, bits: int = BITS) -> Model:
    """Weights averaged over shards and a calibrated curve, from labels (doc_id, toxic) joined with docs (doc_id, text).

    The sample holds the rows whose id hashes below fit_rows / labelled rows; its ids and labels are what is broadcast. A
    CALIBRATION-th of it calibrates the margins, the rest trains; where its texts have more than fit_features features
    in all, the sample is thinned once more in proportion. A shard's rows are trained in one task, as arrays of features.
    """
    spark = docs.sparkSession
    labelled = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = labelled.count()
    if not total:
        return NO_MODEL
    order = F.xxhash64(F.lit("toxicity-fit"), F.col("doc_id"))
    ranked = F.pmod(order, F.lit(1 << 30))
    share = min(1.0, fit_rows / total)
    sample = labelled.where(ranked < F.lit(int(share * (1 << 30))))
    texts = F.broadcast(sample).join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id")

    def to_features(batches):
        for batch in batches:
            found = row_features(*textvec.text_buffers(batch.column("text")), bits)
            limits = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(limits), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lists], names=[*names, "features"])

    names = ["rank", "toxic", "shard"]
    shards = min(SHARDS, max(1, min(fit_rows, total) // SHARD_ROWS))
    shard = F.when(F.pmod(F.shiftright(order, 48), F.lit(CALIBRATION)) == 0, F.lit(-1)).otherwise(F.pmod(F.shiftright(order, 32), F.lit(shards)))
    numbered = texts.select(ranked.alias("rank"), F.col("toxic").cast("int").alias("toxic"), shard.cast("int").alias("shard"), "text")
    rows = table(map_arrow(numbered, to_features, "rank long, toxic int, shard int, features array<int>"), "toxicity-sample")
    held = rows.agg(F.sum(F.size("features"))).first()[0] or 0
    if held > fit_features:
        rows = rows.where(F.col("rank") < F.lit(int(share * (1 << 30) * fit_features / held)))

    def train(batches):
        at, examples, toxic = None, [], []

        def trained():
            index, weight, bias = train_shard(examples, toxic)
            return pa.RecordBatch.from_arrays([pa.array(np.append(index, -1)), pa.array(np.append(weight, bias)), pa.array(np.ones(len(index) + 1, np.int64))], names=["feature", "weight", "shards"])

        for batch in batches:
            lists, numbers, marks = batch.column("features"), batch.column("shard").to_pylist(), batch.column("toxic").to_pylist()
            limits, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            for i in range(batch.num_rows):
                if numbers[i] != at and examples:
                    yield trained()
                    examples, toxic = [], []
                at = numbers[i]
                examples.append(values[limits[i] : limits[i + 1]])
                toxic.append(marks[i])
        if examples:
            yield trained()

    dealt = rows.where("shard >= 0").repartition(shards, "shard").sortWithinPartitions("shard", "rank")
    learned = map_arrow(dealt, train, "feature long, weight double, shards long").groupBy("feature").agg(F.sum("weight").alias("weight"), F.sum("shards").alias("shards"))
    found = learned.toArrow().sort_by("feature")
    if not found.num_rows:
        return NO_MODEL
    count = found["shards"][0].as_py()
    feature, weight = found["feature"].to_numpy(), found["weight"].to_numpy() / count
    raw: Model = (feature[1:], weight[1:], float(weight[0]), 1.0, 0.0)
    sent = spark.sparkContext.broadcast(raw)

    def held_out(batches):
        index, weight, bias, _, _ = sent.value
        for batch in batches:
            lists = batch.column("features")
            limits, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            at = np.minimum(np.searchsorted(index, values), max(len(index) - 1, 0))
            sums = np.concatenate([[0.0], np.cumsum(np.where(index[at] == values, weight[at], 0.0))]) if len(index) else np.zeros(len(values) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(sums[limits[1:]] - sums[limits[:-1]] + bias), batch.column("toxic")], names=["margin", "toxic"])

    # as many rows as the sample's bound at most
    margin = map_arrow(rows.where("shard < 0").select("features", "toxic"), held_out, "margin double, toxic int").toArrow()
    return (*raw[:3], *calibrate(margin["margin"].to_numpy(), margin["toxic"].to_numpy()))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """docs with score (double, 0 to 1) and predicted (int)."""
    docs = without(docs, "score", "predicted")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        index, weight, bias, slope, shift = sent.value
        for batch in batches:
            total = margins(*textvec.text_buffers(batch.column("text")), index, weight, bias, bits)
            p = 1 / (1 + np.exp(-np.clip(slope * total + shift, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return map_arrow(docs, run, schema)
