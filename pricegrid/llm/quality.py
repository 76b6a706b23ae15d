"""A quality classifier on averaged subword vectors, trained by stochastic gradient descent in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricegrid.llm.common import Prefixes, byte_column, chunks, mixed, sent_by_value, word_hashes, words

sent_by_value(__name__)

#: Labelled rows of each class that the classifier is trained on, at most: the first in the order of a hash.
SAMPLE_A_CLASS = 2000

BUCKETS_BITS = 17
NGRAMS = (3, 4)
DIMENSION = 16
EPOCHS, RATE = 5, 0.2

_AGAIN = 0  # the bucket of a word that repeats the one before it


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For words and each length of n-grams: buckets, and each text's first and last + 1 place among them.

    Words are lower-cased; n-grams are of bytes, with case, marks and spaces. A word like the one before it is the
    word "again", whatever it is.
    """
    shift, out = np.uint64(64 - BUCKETS_BITS), []
    low, starts, ends, before = words(data, offsets)
    hashed = word_hashes(low, starts, ends)
    bucket = (mixed(hashed + np.uint64(1)) >> shift).astype(np.int32)
    if len(hashed):
        again = np.zeros(len(hashed), bool)
        again[1:] = hashed[1:] == hashed[:-1]
        again[before[:-1][before[:-1] < len(hashed)]] = False
        bucket[again] = _AGAIN
    out.append((bucket, before[:-1], before[1:]))
    prefixes = Prefixes(data.astype(np.uint64) + np.uint64(1))
    for n in NGRAMS:
        at = np.arange(max(0, len(data) - n + 1))
        bucket = (mixed(prefixes.of(at, at + n) + np.uint64(n)) >> shift).astype(np.int32)
        last = np.maximum(offsets[1:] - n + 1, offsets[:-1])
        out.append((bucket, offsets[:-1], last))
    return out


def training_rows(texts: DataFrame) -> DataFrame:
    """label, buckets and shares (packed arrays) for each row of ``texts`` (label, text): its distinct features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_column(batch.column(1))
            for a, b in chunks(offsets):
                kinds = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                packed = []
                for k in range(b - a):
                    every = np.concatenate([bucket[first[k] : last[k]] for bucket, first, last in kinds])
                    bucket, count = np.unique(every, return_counts=True)
                    share = (count / max(1, len(every))).astype("<f4")
                    packed.append((bucket.astype("<i4").tobytes(), share.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([p[0] for p in packed], pa.binary()),
                        pa.array([p[1] for p in packed], pa.binary()),
                    ],
                    ["label", "buckets", "shares"],
                )

    return texts.select("label", "text").mapInArrow(run, "label int, buckets binary, shares binary")


@dataclass
class Model:
    vectors: np.ndarray  # buckets x dimension
    output: np.ndarray  # classes x dimension
    bias: np.ndarray

    def feature_scores(self) -> tuple[np.ndarray, float]:
        """What each feature adds, on average, to the log odds of class 1, and the constant: softmax of two classes."""
        return (self.vectors @ (self.output[1] - self.output[0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> Model:
    """Averaged vectors and a softmax output, by gradient descent one text at a time, with a falling rate."""
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1, 1, (1 << BUCKETS_BITS, DIMENSION)).astype(np.float32) / DIMENSION
    output, bias = np.zeros((2, DIMENSION), np.float32), np.zeros(2, np.float32)
    steps, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for k in random.permutation(len(rows)):
            label, bucket, share = rows[k]
            step = np.float32(rate * (1 - done / steps))
            done += 1
            mean = share @ vectors[bucket]
            logits = output @ mean + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ output
            output -= step * np.outer(p, mean)
            bias -= np.float32(0.05) * step * p
            # Vectors get the whole gradient of a feature's share of the largest one, so that long texts teach as much.
            vectors[bucket] -= step * np.outer(share / max(share.max(initial=0), np.float32(1e-9)), back)
    return Model(vectors, output, bias)


def fit(documents: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE_A_CLASS, **settings) -> Model:
    """A model of ``labels[label]`` (0 or 1) from whole texts of ``documents``, joined by doc_id.

    At most ``sample`` rows of each class are used, the first in the order of a hash of their doc_id; their features
    are worked out by the executors, one of which trains on them. Rows without a doc_id, text or
    label teach nothing; a class without rows leaves a model that knows only the other.
    """
    spark = documents.sparkSession
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)").distinct()
    chosen: list[tuple[int, int]] = []
    for k in (0, 1):
        first = known.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen += [(r["doc_id"], k) for r in first.collect()]
    chosen_rows = F.broadcast(spark.createDataFrame(chosen, "doc_id bigint, label int"))  # 2 * sample rows at most
    texts = documents.select("doc_id", "text").filter("text IS NOT NULL").join(chosen_rows, "doc_id").select("label", "text")
    return trained_in_a_task(training_rows(texts), settings)


def trained_in_a_task(features_of_rows: DataFrame, settings: dict) -> Model:
    """The model of at most ``2 * sample`` rows of features, trained where an executor holds them.

    The driver gets the weights alone (8 MB), however long the sampled texts are; a lost executor trains again, to the
    same model.
    """

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [
            (label, np.frombuffer(bucket, "<i4"), np.frombuffer(share, "<f4"))
            for batch in batches
            for label, bucket, share in zip(*[column.to_pylist() for column in batch.columns])
        ]
        rows.sort(key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))  # whatever order the tasks ended in
        model = train(rows, **settings)
        weights = [pa.array([x.astype("<f4").tobytes()], pa.binary()) for x in (model.vectors, model.output, model.bias)]
        yield pa.RecordBatch.from_arrays(weights, ["vectors", "output", "bias"])

    schema = "vectors binary, output binary, bias binary"
    weights = features_of_rows.repartition(1).mapInArrow(learn, schema).head()
    if weights is None:  # no rows, and no task either
        return train([], **settings)
    vectors, output, bias = [np.frombuffer(bytes(w), "<f4") for w in weights]
    return Model(vectors.reshape(-1, DIMENSION), output.reshape(-1, DIMENSION), bias)


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """Every row of ``documents`` with score (0 to 1: how likely label 1 is) and predicted (1 from a score of 0.5).

    Needs text, of which nothing but the text itself counts; all columns stay, and columns of these names are
    replaced. A null or empty text has no feature and gets the model's constant. Equal texts have equal scores.
    """
    rows = documents.drop("score", "predicted")
    text = rows.columns.index("text")
    out = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = documents.sparkSession.sparkContext.broadcast(model.feature_scores())  # half a megabyte

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, constant = shared.value
        for batch in batches:
            data, offsets = byte_column(batch.column(text))
            for a, b in chunks(offsets):
                total, count = np.zeros(b - a), np.zeros(b - a, np.int64)
                for bucket, first, last in features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                    # Rounded to whole millionths, so that sums do not depend on what else is in the batch.
                    sums = np.concatenate([[0], np.cumsum(np.rint(table[bucket] * 1e6).astype(np.int64))])
                    total += sums[last] - sums[first]
                    count += last - first
                odds = np.clip(total / 1e6 / np.maximum(count, 1) + constant, -30, 30)
                score = 1 / (1 + np.exp(-odds))
                part = batch.slice(a, b - a)
                added = [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], out.names)

    return rows.mapInArrow(run, out)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of its doc_id as text leaves 1 when divided by 3; a null one's does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classify(documents: DataFrame, labels: DataFrame, label: str = "quality", **settings) -> DataFrame:
    """Every row of ``documents`` with held_out, score and predicted by a model of the labels that are not held out."""
    model = fit(documents, labels.filter(~held_out(F.col("doc_id"))), label, **settings)
    return scored(documents.withColumn("held_out", held_out(F.col("doc_id"))), model)
