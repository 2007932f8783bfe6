"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, their stems (first bytes, so that inflected forms of a word share a feature), pairs of
neighbours, and pairs with one or two words between them, hashed into 2**BITS buckets. Training is online with a learning rate for each coordinate; the L1 term leaves few weights that are
not zero, so what is broadcast is a small list of buckets and weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.cluster import ship
from docspark.llm.common import Words, append_columns, batches_of, fresh, give_back, mix64, slices, texts_of, thinned, words_of

BITS = 20
#: Labelled rows that are learned from, at most: those with the smallest hashes of their id.
TRAIN_ROWS = 12_000
#: Distinct features of all these rows that are learned from, at most; rows from the first that exceeds it on are not.
TRAIN_FEATURES = 40 << 20
#: Rows of an Arrow batch of features.
FIT_ROWS = 500
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 8.0, 1.0
#: Bytes of a word that make a stem.
STEMS = (4, 5, 6, 7, 8)
#: Distance of the two words of a pair, and the multiplier that sets its kind apart.
GAPS = {1: 0x9E3779B97F4A7C15, 2: 0xC2B2AE3D27D4EB4F, 3: 0x165667B19E3779F9}


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of each feature, repeats counted."""
    text = np.repeat(np.arange(len(w.counts)), w.counts)
    buckets, owners = [w.hash], [text]
    for size in STEMS:
        long, h = w.prefix_hash(size)
        buckets.append(h)
        owners.append(text[long])
    for gap, seed in GAPS.items():
        if len(text) > gap:
            same = text[gap:] == text[:-gap]
            buckets.append(mix64(w.hash[:-gap] * np.uint64(seed) + w.hash[gap:])[same])
            owners.append(text[gap:][same])
    return (np.concatenate(buckets) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(owners)


@dataclass
class Model:
    """Weights of the buckets that have one, and the bias."""

    bucket: np.ndarray
    weight: np.ndarray
    bias: float

    def scorer(self):
        dense = np.zeros(1 << BITS)
        dense[self.bucket] = self.weight
        known = dense != 0

        def score(texts: list[bytes]) -> np.ndarray:
            bucket, text = features(words_of(texts))
            some = known[bucket]
            pairs = np.unique((text[some] << BITS) | bucket[some])
            margin = self.bias + np.bincount(pairs >> BITS, weights=dense[pairs & ((1 << BITS) - 1)], minlength=len(texts))
            return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))

        return score


def distinct_features(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct buckets of each text, sorted."""
    bucket, text = features(words_of(texts))
    pairs = np.unique((text << BITS) | bucket)
    return np.split((pairs & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(pairs >> BITS, np.arange(1, len(texts))))


def fit(examples: list[tuple[np.ndarray, int]], epochs: int = EPOCHS, consume: bool = False) -> Model:
    """A model of (distinct buckets, 0 or 1) examples, taken in their order. Of one class only, it learns that class's rate;
    without examples nothing is toxic.

    A gradient is at most 1, so a bucket of so few examples that its gradients cannot sum up to L1 would keep the weight 0;
    such buckets are left out from the start. consume: the list is used up, so that memory is given back on the way.
    """
    if not examples:
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0), -35.0)
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    seen = np.zeros(1 << BITS, dtype=np.int32)
    for bucket, _ in examples:
        seen[bucket] += 1
    useful = seen * epochs >= L1
    examples = examples if consume else list(examples)
    for k, (bucket, label) in enumerate(examples):  # one by one, so that what is left out is freed
        examples[k] = (np.append(bucket[useful[bucket]], 1 << BITS).astype(np.int32), label)
    weight = lambda i: np.where(np.abs(z[i]) <= L1 * (i < 1 << BITS), 0, -(z[i] - np.sign(z[i]) * L1 * (i < 1 << BITS)) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))
    for _ in range(epochs):
        for i, label in examples:
            w = weight(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    final = weight(np.arange((1 << BITS) + 1))
    bucket = np.flatnonzero(final[:-1])
    return Model(bucket, final[bucket], float(final[-1]))


def _order(c: str = "doc_id"):
    return (F.xxhash64(c, F.lit(8)), c)


def sample(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id and label of at most `most` labelled ids of documents with a text, those with the smallest hashes.

    An id is labelled if labels has it with toxic 0 or 1; the larger label of a repeated id counts. Held-out and null ids
    are left out. Only ids are read and moved.
    """
    some = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("doc_id")).select("doc_id", "toxic")
    some = thinned(some, "doc_id", 2 * most, 8).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    # twice as many as are wanted, since a label may have no document
    some = some.orderBy(*_order()).limit(2 * most)
    return docs.where("text is not null").select("doc_id").join(F.broadcast(some), "doc_id").distinct().orderBy(*_order()).limit(most)


def held_out(doc_id: str):
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, room: int = TRAIN_FEATURES) -> Model:
    """A model of the sample's documents, in the order of their ids' hashes, up to the first whose features exceed `room`.

    Texts stay where they lie: tasks hash them, and only buckets go to the one task that learns. Of documents that repeat
    an id, the one with the smallest buckets counts. Null texts are left out; an empty text has no features but the bias.
    Without labelled documents nothing is toxic. Other columns of either table are not read.
    """
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(sample(docs, labels, most)), "doc_id").select("doc_id", "label", "text")

    def hashed(batches):
        for batch in batches:
            for part in slices(batch, 2):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x.tobytes() for x in distinct_features(texts_of(part.column(2)))], pa.binary())], ["doc_id", "label", "buckets"])
        give_back()

    def learn(batches):
        examples, before, left = [], None, room
        for batch in batches:
            for doc_id, label, buckets in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if doc_id != before and left >= 0:
                    left -= len(buckets) // 4
                    if left >= 0:
                        examples.append((np.frombuffer(buckets, dtype=np.int32), label))
                before = doc_id
        model = fit(examples, consume=True)
        examples.clear()
        yield pa.RecordBatch.from_arrays([pa.array([*model.bucket.tolist(), -1], pa.int32()), pa.array([*model.weight.tolist(), model.bias], pa.float64())], ["bucket", "weight"])
        give_back()

    ship(docs.sparkSession)
    with batches_of(docs.sparkSession, FIT_ROWS):
        kind = rows.schema["doc_id"].dataType
        sparse = rows.mapInArrow(hashed, T.StructType([T.StructField("doc_id", kind), T.StructField("label", T.IntegerType()), T.StructField("buckets", T.BinaryType())]))
        # one task, of a bounded sample
        weights = sparse.repartition(1).sortWithinPartitions(*_order(), "buckets").mapInArrow(learn, "bucket int, weight double").collect()
    found = {r.bucket: r.weight for r in weights}
    bias = found.pop(-1, -35.0)
    bucket = np.array(sorted(found), dtype=np.int64)
    return Model(bucket, np.array([found[k] for k in bucket.tolist()]), bias)


def score(docs: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, str]:
    """docs with a score from 0 to 1, and that column's name ("score" unless docs has it).

    A null, empty or wordless text scores what the bias gives. Each row is scored for itself, over its whole text.
    """
    name = fresh(docs, "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        f = sent.value.scorer()
        return lambda _, texts: [f(texts)]

    return append_columns(docs, text, [T.StructField(name, T.DoubleType())], make), name


def keep_civil(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score under the threshold, as they are.

    Null and empty texts score what the bias gives. Repeated rows stay or go together. Without labels all rows stay; an
    empty table gives an empty table.
    """
    out, name = score(docs, train(docs, labels))
    return out.where(F.col(name) < threshold).drop(name)
