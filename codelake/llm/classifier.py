"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader (FTRL-proximal) updates.

Features of a text are its words and pairs of neighbouring words, and the same of the words' shapes (letters, digits and runs folded), hashed
into 2**BITS places and weighted by their share among the text's words. A score is a sparse dot product with the weights, through a sigmoid.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, mix64, text_groups


@dataclass(frozen=True)
class FtrlConfig:
    """bits: log2 of the feature places. train_rows: the bound on labelled rows that are learnt from (those of the smallest id hashes)."""

    bits: int = 18
    train_rows: int = 8_000
    epochs: int = 2
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.001
    scale: float = 10.0


#: Longer words have the shapes of their consecutive pieces of so many characters, all of them.
PIECE = 64


class _Words(dict):
    """word or piece -> position in the arrays of word and shape hashes, for up to `limit` of them."""

    _FOLD = (re.compile(r"[a-z\x80-\U0010ffff]+"), "a"), (re.compile(r"[A-Z]+"), "A"), (re.compile(r"\d+"), "0"), (re.compile(r"([^\w\s])\1+"), r"\1\1")

    def __init__(self, limit: int = 400_000):
        import xxhash

        self._hash, self._limit = xxhash.xxh3_64_intdigest, limit
        self.word, self.shape = np.empty(limit, np.uint64), np.empty(limit, np.uint64)

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        raw = word.encode("utf-8", "surrogatepass")
        self.word[at] = self._hash(raw.lower())
        shape = word
        for pattern, by in self._FOLD:
            shape = pattern.sub(by, shape)
        self.shape[at] = self._hash(shape.encode("utf-8", "surrogatepass"), 1)
        return at

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of a text's words, and those of their shapes, of which long words have several."""
        words = _ASCII_SPACE.split(text)
        long = max(map(len, words)) > PIECE
        pieces = [w[i : i + PIECE] for w in words for i in range(0, len(w), PIECE)] if long else []
        size = len(words) + len(pieces)
        if len(self) + size > self._limit:
            self.clear()
            if size > len(self.word):
                self.word, self.shape = np.empty(size, np.uint64), np.empty(size, np.uint64)
        at = np.fromiter(map(self.__getitem__, filter(None, words)), np.int64)
        return self.word[at], self.shape[np.fromiter(map(self.__getitem__, pieces), np.int64) if long else at]


_ASCII_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_SALTS = np.array([0x51, 0x52, 0x53, 0x54], np.uint64)


def features(words: _Words, text: str, bits: int) -> np.ndarray:
    """Places of all features of a text, with repetition; four families of about equal size."""
    word, shape = words.of(text)
    shift = np.uint64(64 - bits)
    parts = [mix64(word ^ _SALTS[0]), mix64(shape ^ _SALTS[1])]
    for of, salt in ((word, _SALTS[2]), (shape, _SALTS[3])):
        if len(of) > 1:
            parts.append(mix64(mix64(of[:-1] ^ salt) + of[1:]))
    return (np.concatenate(parts) >> shift).astype(np.int32)


def _sigmoid(x: float) -> float:
    return 1 / (1 + np.exp(-min(max(x, -40.0), 40.0)))


class Ftrl:
    """FTRL-proximal for logistic loss with one learning rate a place; the last place is the bias, which isn't regularised."""

    def __init__(self, config: FtrlConfig):
        self.c = config
        size = 2**config.bits + 1
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, c = self.z[at], self.c
        w = -(z - np.sign(z) * c.l1) / ((c.beta + np.sqrt(self.n[at])) / c.alpha + c.l2)
        w[np.abs(z) <= c.l1] = 0
        return w

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        bias = len(self.z) - 1
        at, x = np.append(at, bias), np.append(x, 1.0)
        w = self.weights(at)
        g = (_sigmoid(float(w @ x)) - label) * x
        square = g * g
        self.z[at] += g - (np.sqrt(self.n[at] + square) - np.sqrt(self.n[at])) / self.c.alpha * w
        self.n[at] += square

    def all_weights(self) -> np.ndarray:
        return self.weights(np.arange(len(self.z))).astype(np.float32)


def train(examples: DataFrame, config: FtrlConfig = FtrlConfig()) -> bytes:  # noqa: B008
    """The weights (32-bit floats, the bias last) learnt from examples(key long, text string, label int), in the order of key, ties by text.

    The examples must be bounded (see FtrlConfig.train_rows): features are taken on all executors, the updates run in one task that streams
    over them and holds only the weights. Without examples all weights are 0 and every score is a half.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch, texts in text_groups(batches):
            places, shares = [], []
            for t in texts:
                at, n = np.unique(features(words, t, config.bits), return_counts=True)
                places.append(at.tobytes())
                shares.append((n * (config.scale / max(1, n.sum()))).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(places, pa.binary()), pa.array(shares, pa.binary())], names=["key", "label", "at", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ftrl(config)
        for batch in batches:
            for label, at, x in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True):
                model.learn(np.frombuffer(at.as_py(), np.int32).astype(np.int64), np.frombuffer(x.as_py(), np.float32).astype(float), label.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([model.all_weights().tobytes()], pa.binary())], names=["weights"])

    counted = map_arrow(examples.select("key", "text", "label"), count, "key long, label int, at binary, x binary")
    epochs = counted.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(config.epochs))))
    ordered = epochs.repartition(1).sortWithinPartitions("epoch", "key", "at", "label").select("key", "label", "at", "x")
    got = map_arrow(ordered, learn, "weights binary").collect()
    return bytes(got[0].weights) if got else np.zeros(2**config.bits + 1, np.float32).tobytes()


def training_rows(docs: DataFrame, labels: DataFrame, keep, config: FtrlConfig, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, text, label) of the labelled documents for which keep(id column) holds: at most config.train_rows of them, by the hash of their id.

    Rows with a null id or label are passed over; of repeated ids the least label and the least text count. The chosen ids are bounded by
    config.train_rows and so are broadcast. key is the id if it is a number, else its hash.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & keep(F.col(id_col)))
    chosen = usable.groupBy(F.col(id_col).alias("key")).agg(F.min(label).cast("int").alias("label")).orderBy(F.xxhash64("key"), "key").limit(config.train_rows)
    rows = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "key")
    once = rows.groupBy("key").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    number = F.coalesce(F.col("key").try_cast("long"), F.xxhash64("key"))
    return once.select(number.alias("key"), "text", F.when(F.col("label") >= 1, 1).otherwise(0).alias("label"))


def _score(w: np.ndarray, words: _Words, text: str, config: FtrlConfig) -> float:
    at = features(words, text, config.bits)
    return _sigmoid(float(w[-1] + (w[at].sum() * config.scale / len(at) if len(at) else 0.0)))


def score(docs: DataFrame, weights: bytes, config: FtrlConfig = FtrlConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """(id_col, score): the probability of label 1 for each whole text; null and empty texts get that of the bias alone."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, words = np.frombuffer(sent.value, np.float32).astype(float), _Words()
        for batch, texts in text_groups(batches):
            out = [_score(w, words, t, config) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["id", "score"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = map_arrow(source, run, f"id {source.schema['id'].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(id_col), "score")


def keep_scored(docs: DataFrame, weights: bytes, least: float, config: FtrlConfig = FtrlConfig(), text_col: str = "text") -> DataFrame:  # noqa: B008
    """The rows of docs whose text scores at least `least` (see score), all columns as they were. Each row is judged where it is, by its text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, words = np.frombuffer(sent.value, np.float32).astype(float), _Words()
        for batch, texts in text_groups(batches, text_col):
            yield batch.filter(pa.array([_score(w, words, t, config) >= least for t in texts], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
