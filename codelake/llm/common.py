"""Helpers shared by the training-data operators: intermediate tables in the shared folder, word splitting and hashing."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder (tests, a laptop).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"

#: A group is hot if it holds more than 1 / HOT of all rows; so fewer than HOT groups are, and they can be broadcast whatever the table's size.
HOT = 4096

#: Raw bytes of text whose keys make a shard of packed requests; a task holds one shard at a time.
SHARD_BYTES = 32_000_000

#: Texts are handled in groups of at most so many characters, which bounds a worker's memory whatever the Arrow batch holds.
GROUP_CHARS = 4_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where the session sets it, else the context's, else one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = LOCAL_CHECKPOINTS
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder."""
    return f"{shared_dir(spark)}/codelake/{name}-{uuid.uuid4().hex}"


def delete_dir(spark: SparkSession, path: str) -> None:
    """Deletes a folder by the file system that Spark would use for it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def ship(spark: SparkSession) -> None:
    """Makes this package importable on the executors, once per session's context."""
    context = spark.sparkContext
    if getattr(context, "_codelake_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="codelake-")
    shutil.copytree(package, os.path.join(folder, "src", os.path.basename(package)), ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(os.path.join(folder, f"codelake-{uuid.uuid4().hex[:8]}"), "zip", os.path.join(folder, "src")))
    context._codelake_shipped = True


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow with this package on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def stage_table(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_groups(rows: DataFrame, groups: DataFrame, key: Column, total: int, columns: list[str]) -> DataFrame:
    """rows with `columns` of groups(group, n, ...), null where there is no such group; n is the number of the group's rows, total that of all.

    Rows of hot groups, of which there are fewer than HOT, meet them in a broadcast join and don't move; all others meet theirs in a shuffle in
    which no key holds more than 1 / HOT of the rows. A null key has no group.
    """
    hot = groups.where(F.col("n") * HOT > total).select(F.col("group").alias("__hot"), *(F.col(c).alias(f"__hot_{c}") for c in columns))
    cold = groups.where(F.col("n") * HOT <= total).select(F.col("group").alias("__cold"), *(F.col(c).alias(f"__cold_{c}") for c in columns))
    keyed = rows.withColumn("__key", key).join(F.broadcast(hot), F.col("__key") == F.col("__hot"), "left")
    # What has met its group already, or has none, is dealt by a number of its own, which no group has.
    spread = F.when(F.col("__hot").isNull() & F.col("__key").isNotNull(), F.col("__key").cast("string")).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")))
    both = keyed.withColumn("__spread", spread).join(cold, F.col("__spread") == F.col("__cold"), "left")
    return both.select(*rows.columns, *(F.coalesce(f"__hot_{c}", f"__cold_{c}").alias(c) for c in columns))


def join_salted(rows: DataFrame, groups: DataFrame, key: str, spread: int = 256) -> DataFrame:
    """The inner join of rows and groups (few rows a key) on key, a null key meeting nothing; keys that hold more than 1 / spread of the rows are dealt
    over salts, so that no task gets more of one key's rows, and their groups are repeated for each salt. Fewer than spread keys are such."""
    counts = rows.groupBy(F.col(key).alias("__hot")).agg(F.count("*").alias("n")).where("__hot is not null")
    counts = stage_table(counts, "salts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") * spread > total).select("__hot", F.expr(f"cast(n * {spread} div {max(total, 1)} as int) + 1").alias("__salts"))
    salted = rows.join(F.broadcast(hot), rows[key] == F.col("__hot"), "left")
    salted = salted.withColumn("__salt", F.when(F.col("__salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*rows.columns), F.col("__salts")).cast("int"))).drop("__hot", "__salts")
    repeated = groups.join(F.broadcast(hot), groups[key] == F.col("__hot"), "left")
    repeated = repeated.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__hot", "__salts")
    return salted.join(repeated, [key, "__salt"]).drop("__salt")


def shard_count(texts: DataFrame, text: str = "text") -> int:
    """How many shards the packed keys of texts are dealt over: by their bytes, and at least the session's shuffle partitions."""
    size = texts.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return min(max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES)), 1 << 20)


def text_groups(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = GROUP_CHARS, rows: int = 1 << 30) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the Arrow batches with their texts (null: empty), each of at most `chars` characters or one row, and at most `rows` rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        start, size, texts = 0, 0, []
        for i in range(batch.num_rows):
            t = column[i].as_py() or ""
            if texts and (size + len(t) > chars or len(texts) >= rows):
                yield batch.slice(start, i - start), texts
                start, size, texts = i, 0, []
            texts.append(t)
            size += len(t)
        yield batch.slice(start), texts


_K1, _K2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _K1
    x = (x ^ (x >> np.uint64(27))) * _K2
    return x ^ (x >> np.uint64(31))


#: Bytes of a long text whose words are hashed at a time.
PART = 1_000_000
_BLANK = re.compile(rb"[\x20\x09-\x0d]")


class WordHashes(dict):
    """word bytes -> 64-bit hash, remembered up to `limit` words."""

    def __init__(self, limit: int = 200_000):
        import xxhash

        self._hash, self._limit = xxhash.xxh3_64_intdigest, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self._limit:
            self.clear()
        value = self[word] = self._hash(word)
        return value

    def of(self, text: str) -> np.ndarray:
        """Hashes of the words of a text: A-Z lower-cased, split at the characters of [\\x20\\x09-\\x0D]."""
        raw = text.encode("utf-8", "surrogatepass").lower()
        if len(raw) <= PART:
            return self._of(raw)
        parts, start = [], 0
        while start < len(raw):  # only a part's words are objects at a time
            blank = _BLANK.search(raw, start + PART)
            end = blank.end() if blank else len(raw)
            parts.append(self._of(raw[start:end]))
            start = end
        return np.concatenate(parts)

    def _of(self, raw: bytes) -> np.ndarray:
        words = raw.split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    size = len(words) - n + 1
    out = mix64(words[:size] + np.uint64(n))
    for i in range(1, n):
        out = mix64(out ^ words[i : i + size])
    return out


LOW48 = np.uint64(2**48 - 1)


def shard_order(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, list[int]]:
    """The order that brings hashes together by shard (a range of their first 16 bits; at most 2**15 shards), and each shard's end in it."""
    shard = ((hashes >> np.uint64(48)) * np.uint64(shards) >> np.uint64(16)).astype(np.uint16)
    return np.argsort(shard, kind="stable"), np.cumsum(np.bincount(shard, minlength=shards)).tolist()


def pack48(values: np.ndarray) -> np.ndarray:
    """Integers below 2**48, six bytes each."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def unpack48(data: bytes, count: int) -> np.ndarray:
    out = np.zeros((count, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8, count * 6).reshape(-1, 6)
    return out.view("<u8").ravel()


def shard_ends(keys: np.ndarray, shards: int) -> list[int]:
    """Where each shard ends in ascending 64-bit keys; a shard is a range of their first 32 bits."""
    bounds = ((np.arange(1, shards, dtype=np.uint64) << np.uint64(32)) + np.uint64(shards - 1)) // np.uint64(shards)
    return [*np.searchsorted(keys, bounds << np.uint64(32)).tolist(), len(keys)]


#: Bytes of a gap that are stored as they are; the higher ones are nearly all zero and are compressed.
_LOW = 5


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys, all of their bits, by their gaps: about as long as 46 bits each where a block has half a million of them."""
    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    high = pa.compress(np.ascontiguousarray(gaps[:, _LOW:].T).tobytes(), codec="zstd", asbytes=True)
    return len(keys).to_bytes(4, "little") + len(high).to_bytes(4, "little") + high + np.ascontiguousarray(gaps[:, :_LOW]).tobytes()


def unpack_keys(data: bytes) -> tuple[np.ndarray, int]:
    """The keys at the beginning of data, and where they end in it."""
    count, size = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:8], "little")
    if not count:
        return np.empty(0, np.uint64), 8 + size
    gaps = np.zeros((count, 8), np.uint8)
    gaps[:, _LOW:] = np.frombuffer(pa.decompress(data[8 : 8 + size], decompressed_size=(8 - _LOW) * count, codec="zstd", asbytes=True), np.uint8).reshape(8 - _LOW, -1).T
    gaps[:, :_LOW] = np.frombuffer(data, np.uint8, _LOW * count, 8 + size).reshape(-1, _LOW)
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64), 8 + size + _LOW * count


#: Bytes of a packed count.
_COUNT = 6


def packed_planes(values: np.ndarray) -> bytes:
    """Integers below 2**48 as six planes of bytes, compressed: the high ones are nearly all zero and cost next to nothing."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_COUNT].T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def from_packed_planes(data: bytes, count: int) -> np.ndarray:
    if not count:
        return np.empty(0, np.int64)
    out = np.zeros((count, 8), np.uint8)
    out[:, :_COUNT] = np.frombuffer(pa.decompress(data, decompressed_size=_COUNT * count, codec="zstd", asbytes=True), np.uint8).reshape(_COUNT, -1).T
    return out.view("<i8").ravel()
