"""WARC archives: a deterministic sharded writer and a reader that checks what it reads.

Records are range-sorted by id into shards of about equal payload, each shard's files are rolled by compressed size, and headers and digests are
made anew from the payload. A file is written under a temporary name and renamed when it is whole; a manifest names the files of the archive,
its renaming to its final place is what commits the archive, and a reader opens only the files that it names. The same rows give the same bytes in any run, so a task that runs twice leaves the same file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups, map_arrow, new_dir, stage_table


@dataclass(frozen=True)
class WarcConfig:
    """file_bytes: compressed size from which on a file is closed. shard_bytes: payload a shard should have. revisit_bytes: payloads of fewer
    bytes are written in full even if they repeat. date: the WARC-Date of every record. shards: about so many at most; the sizes of
    some ranges of ids for each are all that the driver gathers."""

    file_bytes: int = 32_000_000
    shard_bytes: int = 64_000_000
    revisit_bytes: int = 0
    date: str = "2020-01-01T00:00:00Z"
    shards: int = 8192
    level: int = 6


PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")  # noqa: S324


def _clean(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {_clean(v)}\r\n" for k, v in [*headers, ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def record_id(page_id: int | None, digest: str, repetition: int = 0) -> str:
    """repetition: the number of records with the same id and payload before this one."""
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}{f':{repetition}' if repetition else ''}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool, config: WarcConfig, repetition: int = 0) -> bytes:
    """A response with its payload, or a revisit with the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode("ascii")
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest, repetition)), ("WARC-Date", config.date)]
    if url is not None:
        headers.append(("WARC-Target-URI", url))
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest))]
    return _record(headers, http if revisit else http + payload)


class ShardWriter:
    """Files of one shard, one after the other; finished() tells what was written."""

    def __init__(self, root: str, shard: int, tag: str, config: WarcConfig):
        self._fs, self._dir = pafs.FileSystem.from_uri(root)
        self._fs.create_dir(self._dir, recursive=True)
        self._shard, self._tag, self._config, self._number, self._out, self.done = shard, tag, config, 0, None, []

    def add(self, record: bytes) -> None:
        if self._out is None:
            self._name = f"part-{self._shard:06d}-{self._number:05d}.warc.gz"
            self._temp = f"{self._dir}/.{self._name}.{self._tag}.tmp"
            self._out, self._size, self._records, self._sum = self._fs.open_output_stream(self._temp, compression=None), 0, 0, hashlib.sha256()
            info = f"software: codelake\r\nformat: WARC File Format 1.1\r\nisPartOf: {self._name}\r\n".encode()
            self._put(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{self._name}>"), ("WARC-Date", self._config.date), ("Content-Type", "application/warc-fields")], info))
        self._put(record)
        self._records += 1
        if self._size >= self._config.file_bytes:
            self.close()

    def _put(self, record: bytes) -> None:
        packer = zlib.compressobj(self._config.level, zlib.DEFLATED, 31)  # a gzip member of its own, without a time stamp
        data = packer.compress(record) + packer.flush()
        self._out.write(data)
        self._sum.update(data)
        self._size += len(data)

    def close(self) -> None:
        if self._out is not None:
            self._out.close()
            self._fs.move(self._temp, f"{self._dir}/{self._name}")
            self.done.append((self._shard, self._number, self._name, self._records, self._size, self._sum.hexdigest()))
            self._out, self._number = None, self._number + 1


#: The folder of the manifest's rows, below the archive's; an archive without it isn't committed.
COMMITTED = "manifest"
MANIFEST = "shard int, number int, name string, records long, bytes long, sha256 string"


def _payload(html):
    return F.coalesce(html.cast("string"), F.lit("")).cast("binary")


def write_warc(pages: DataFrame, root: str, config: WarcConfig = WarcConfig(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:  # noqa: B008
    """Writes a record per row of pages below root and gives the manifest, which is stored beside the files.

    The payload is the html in UTF-8, null as empty. Of records with equal payloads of at least config.revisit_bytes bytes the one with the
    largest id (null: smallest of all) is the response, the others revisit it; repeated rows of that id are responses, too. A null url leaves
    its header out. An empty table gives an empty manifest. Payloads cross the network once, by shard. Shards hold about equally many
    bytes; an id that alone fills several is dealt over them by payload (so rows equal in both stay together). A committed archive isn't written again:
    that is an error.
    """
    spark = pages.sparkSession
    committed = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{COMMITTED}")
    files = committed.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(committed):
        raise FileExistsError(f"{root} holds a committed archive")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), _payload(F.col(html_col)).alias("payload"))
    narrow = stage_table(rows.select("id", F.sha1("payload").alias("sha"), F.octet_length("payload").cast("long").alias("size")), "warc-rows")
    first = F.max(F.struct(F.col("id").isNotNull().alias("known"), "id")).alias("first")
    copies = narrow.where(F.col("size") >= config.revisit_bytes).groupBy(F.col("sha").alias("group")).agg(first, F.count("*").alias("n")).where("n > 1")
    copies = stage_table(copies.select("group", F.col("first.id").alias("first"), "n"), "warc-copies")
    among = narrow.where(F.col("size") >= config.revisit_bytes).select("id", "sha").distinct()
    met = join_groups(among, copies, F.col("sha"), copies.agg(F.sum("n")).first()[0] or 0, ["first", "n"])
    revisits = met.where(F.col("n").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))).select("id", "sha", "first")

    by_shard, shards = _shards(narrow, config)

    pages_in = rows.withColumn("sha", F.sha1("payload")).select(by_shard, "id", "sha", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("first"))
    notes = revisits.select(by_shard, "id", "sha", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "first")
    sorted_ = pages_in.unionByName(notes).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "id", "sha", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        tag, writer, at, note, done, last, repetition = f"{task.partitionId()}-{task.taskAttemptId()}", None, None, None, [], None, 0
        for batch in batches:
            for shard, id_, sha, kind, url, payload, first in zip(*batch.columns, strict=True):
                key = (id_.as_py(), sha.as_py())
                if not kind.as_py():
                    note = (key, first.as_py())
                    continue
                if shard.as_py() != at:
                    if writer:
                        writer.close()
                        done += writer.done
                    at = shard.as_py()
                    writer = ShardWriter(root, at, tag, config)
                data = payload.as_py()
                digest = base64.b32encode(bytes.fromhex(key[1])).decode("ascii")
                revisit = note is not None and note[0] == key
                last, repetition = key, repetition + 1 if key == last else 0
                writer.add(page_record(key[0], url.as_py(), data, len(data), digest, note[1] if revisit else None, revisit, config, repetition))
        if writer:
            writer.close()
            done += writer.done
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["shard", "number", "name", "records", "bytes", "sha256"])

    temp = f"{root}/.{COMMITTED}-{uuid.uuid4().hex}"
    map_arrow(sorted_, run, MANIFEST).write.parquet(temp)
    if not files.rename(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(temp), committed):
        raise OSError(f"the manifest of {root} can't be put in its place")
    return read_manifest(spark, root)


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """The files of a committed archive."""
    return spark.read.schema(MANIFEST).parquet(f"{root}/{COMMITTED}")


def _shards(rows: DataFrame, config: WarcConfig) -> tuple[Column, int]:
    """The shard of rows(id, sha, size), and how many there are. Ranges of ids are counted and the large ones cut until none is larger than a
    shard or all are single ids; neighbouring ranges fill a shard. The same rows give the same shards."""
    low, high, total = rows.agg(F.min("id"), F.max("id"), F.sum(F.col("size") + 500)).first()
    low, high, most = low or 0, high or 0, max(config.shard_bytes, (total or 0) // config.shards)
    none = max(low - 1, -(2**63))  # where null ids stand
    key, bounds = F.coalesce("id", F.lit(none)), sorted({none, low})
    while True:
        range_ = _reached(rows.sparkSession, key, bounds)
        sizes = {r.range: r.size for r in rows.groupBy(range_.alias("range")).agg(F.sum(F.col("size") + 500).alias("size")).collect()}
        ends = [*bounds[1:], high + 1]
        large = [i for i, (a, b) in enumerate(zip(bounds, ends, strict=True)) if sizes.get(i, 0) > most and b - a > 1]
        if not large:
            break
        parts = max(16, 4096 // len(large))
        bounds = sorted({*bounds, *(bounds[i] + (ends[i] - bounds[i]) * k // parts for i in large for k in range(1, parts))})
    first, dealt, shard, filled = [], [], 0, 0
    for i in range(len(bounds)):
        size = sizes.get(i, 0)
        if filled and filled + size > most:
            shard, filled = shard + 1, 0
        first.append(shard)
        dealt.append(max(1, -(-size // most)))
        filled += size
        if dealt[-1] > 1:
            shard, filled = shard + dealt[-1], 0
    sent = rows.sparkSession.sparkContext.broadcast((np.array(bounds), np.array(first), np.array(dealt)))

    @F.pandas_udf("int")
    def shard_of(keys: pd.Series, hashes: pd.Series) -> pd.Series:
        bounds, first, dealt = sent.value
        at = np.searchsorted(bounds, keys.to_numpy(), side="right") - 1
        return pd.Series((first[at] + np.mod(hashes.to_numpy(), dealt[at])).astype(np.int32))

    return shard_of(key, F.xxhash64("sha")).alias("shard"), shard + 1


def _reached(spark: SparkSession, key: Column, bounds: list[int]) -> Column:
    """The last of the ascending bounds that isn't above the key; the first one never is."""
    sent = spark.sparkContext.broadcast(np.array(bounds))

    @F.pandas_udf("int")
    def reached(keys: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(sent.value, keys.to_numpy(), side="right") - 1).astype(np.int32))

    return reached(key)


def read_members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, each unpacked."""
    unpack, parts, data = zlib.decompressobj(31), [], b""
    while data or (data := stream.read(chunk)):
        parts.append(unpack.decompress(data))
        if unpack.eof:
            yield b"".join(parts)
            data, parts, unpack = unpack.unused_data, [], zlib.decompressobj(31)
        else:
            data = b""
    if any(parts):
        raise ValueError("the file ends within a record")


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if lines[0] != "WARC/1.1" or len(rest) != len(block) + 4 or headers["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"damaged record {headers.get('WARC-Record-ID')}")
    return headers, block


def read_warc(manifest: DataFrame, root: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload): the page records of the files that the manifest names.

    payload is null for revisits. A damaged file or record, a digest that doesn't fit or a wrong number of records is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out, size, seen = [], 0, 0
                with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for member in read_members(stream):
                        headers, block = parse_record(member)
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        full = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
                        page, digest = headers["WARC-Record-ID"].strip("<>").split(":")[2:4]
                        kind = headers["WARC-Type"]
                        if kind == "response" and (len(payload) != full or base32_sha1(payload) != digest):
                            raise ValueError(f"wrong payload of {headers['WARC-Record-ID']}")
                        to = headers.get("WARC-Refers-To", ":::").strip("<>").split(":")[2]
                        out.append((int(page) if page else None, headers.get("WARC-Target-URI"), full, digest, kind, int(to) if to else None, payload if kind == "response" else None))
                        size, seen = size + len(payload), seen + 1
                        if size > 8_000_000 or len(out) >= 5_000:
                            yield _rows(out)
                            out, size = [], 0
                if seen != records:
                    raise ValueError(f"{name} has {seen} records, the manifest says {records}")
                if out:
                    yield _rows(out)

    files = manifest.select("name", "records")
    files = files.repartition(max(1, manifest.count()), "name")
    return map_arrow(files, run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def round_trip(pages: DataFrame, config: WarcConfig = WarcConfig()) -> DataFrame:  # noqa: B008
    """Writes pages to a new archive in the shared folder and reads it back."""
    root = new_dir(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, root, config), root)
