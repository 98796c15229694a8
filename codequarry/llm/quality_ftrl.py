"""Quality classifier: hashed word n-grams, logistic regression by FTRL-proximal.

Features are hashed into 2**20 places: words, pairs of words, and the same of
word shapes (letters by case, digits as 9, marks as they are, a repeated word as
such), each family as frequencies, so that length does not matter.  The model
learns from ``SAMPLE_ROWS`` labelled rows at most, whole texts, taken by hash
order; one executor task streams them once per epoch and keeps only the model's
accumulators.  Scoring is a sparse dot product of a document's places with the
weights, over the input partitions.

Defined results: null is empty, and an empty text is scored by the constant term
alone; without a labelled row all scores are 0.5; null labels teach nothing and
of several labels of a document the highest counts, and of several texts of a
number one is learned; repeated rows are scored
alike; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import map_batches

BITS, SAMPLE_ROWS, EPOCHS = 20, 4096, 3
ALPHA, BETA, L1, L2 = 2.0, 0.02, 1e-4, 1e-3
THRESHOLD = 0.3
CONSTANT = 0  # the place of the constant term
_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")
_MOST_WORDS = 200_000


def _shape(word: str) -> str:
    case = lambda m: "X" if len(m[0]) > 1 and m[0].isupper() else "Xx" if m[0][0].isupper() else "x"
    return _DIGITS.sub("9", _LETTERS.sub(case, word))


class _Words(dict):
    """Word to its hash (upper half) and its shape's hash (lower half), of bounded size."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _MOST_WORDS:
            self.clear()
        value = zlib.crc32(word.encode("utf-8", "replace")) << 32 | zlib.crc32(_shape(word).encode("utf-8", "replace"))
        self[word] = value
        return value


_WORDS = _Words()


def _place(values: np.ndarray, family: int) -> np.ndarray:
    mixed = (values + np.uint64(family)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def families(text: str | None) -> list[np.ndarray]:
    """The places of words, shapes, word pairs and shape pairs."""
    tokens = (text or "").split()
    if not tokens:
        return []
    both = np.fromiter(map(_WORDS.__getitem__, tokens), np.uint64, len(tokens))
    words, shapes = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    shapes[1:][words[1:] == words[:-1]] = 0x9E3779B9
    out = [_place(words, 1), _place(shapes, 2)]
    if len(tokens) > 1:
        out += [_place(x[:-1] * np.uint64(31) + x[1:] * np.uint64(1_000_003), k) for k, x in ((3, words), (4, shapes))]
    return out


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sparse vector: distinct places and values."""
    found = families(text)
    places = np.concatenate([*found, np.array([CONSTANT])])
    values = np.concatenate([*(np.full(len(f), 1 / len(f)) for f in found), np.ones(1)])
    distinct, which = np.unique(places, return_inverse=True)
    return distinct, np.bincount(which, values)


class Ftrl:
    """Follow-the-regularised-leader for logistic loss, one sparse row at a time."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(self, places: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[places]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(self.n[places])) / ALPHA + L2))

    def update(self, places: np.ndarray, values: np.ndarray, label: int) -> None:
        weights, before = self.weights(places), self.n[places]
        slope = (sigmoid(float(weights @ values)) - label) * values
        after = before + slope * slope
        self.z[places] += slope - (np.sqrt(after) - np.sqrt(before)) / ALPHA * weights
        self.n[places] = after


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def fit(documents: DataFrame, labels: DataFrame, teaches: Column, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> np.ndarray:
    """Weights from the labelled rows (of ``labels``) that teach; float32, one for each place."""
    known = labels.where(teaches & F.col(id_column).isNotNull() & F.col(label_column).isNotNull()).groupBy(F.col(id_column).alias("i")).agg(F.max(label_column).cast("int").alias("y"))
    # a few thousand ids and labels at most, so this side may be broadcast
    sample = known.withColumn("draw", F.xxhash64("i", F.lit(3))).orderBy("draw", "i").limit(SAMPLE_ROWS)
    texts = documents.select(F.col(id_column).alias("d"), F.col(text_column).cast("string").alias("text"))
    found = texts.join(F.broadcast(sample), F.col("d") == F.col("i"))
    # of a repeated number one text, the one of the least hash: no number brings more than one row to the learner
    rows = found.groupBy("draw", "i", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    passes = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(EPOCHS))).alias("epoch"))
    ordered = passes.repartition(1).sortWithinPartitions("epoch", F.xxhash64("draw", "epoch"), "i", "text").select("y", "text")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ftrl()
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                model.update(*features(text.as_py()), int(y > 0))
        weights = model.weights().astype("<f4")
        used = np.flatnonzero(weights).astype("<i4")
        yield pa.RecordBatch.from_arrays([pa.array([used.tobytes()], pa.binary()), pa.array([weights[used].tobytes()], pa.binary())], ["places", "weights"])

    out = np.zeros(1 << BITS, np.float32)
    for row in map_batches(ordered, train, "places binary, weights binary").collect():  # one row, 8 MB at most
        out[np.frombuffer(row["places"], "<i4")] = np.frombuffer(row["weights"], "<f4")
    return out


def score_text(text: str | None, weights: np.ndarray) -> float:
    """The dot product of ``features`` and ``weights``, without building the sparse vector."""
    return sigmoid(float(weights[CONSTANT]) + sum(float(weights[f].mean(dtype=np.float64)) for f in families(text)))


def score(documents: DataFrame, weights: np.ndarray, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, score: the probability of label 1."""
    shared = documents.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [score_text(x.as_py(), shared.value) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    chosen = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return map_batches(chosen, run, "doc_id long, score double")


def keep_good(documents: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD, text_column: str = "text") -> DataFrame:
    """The rows of ``documents`` that score at least ``threshold``, all columns; nothing is shuffled."""
    shared, schema = documents.sparkSession.sparkContext.broadcast(weights), documents.schema
    at = documents.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([score_text(x.as_py(), shared.value) >= threshold for x in batch.column(at)], pa.bool_()))

    return documents.mapInArrow(run, schema)
