"""Tables in versioned folders: what a repository's tables hold is told by one small file, and a change is committed by renaming it.

Rows of a repository lie in hash buckets of a key. A change writes the buckets that it touches into a folder of its own and then a head, the
list of each table's buckets and the folders that hold them. Readers resolve the newest head, so they see all of a change or nothing of it; what
fails before the rename leaves no trace but files that vacuum takes away. All work on rows is Spark's; heads are as small as the buckets are few.
"""

from __future__ import annotations

import json
import re
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Used only where neither the session nor the context names a shared folder and everything runs in one process.
LOCAL = "/tmp/checkpoints"

BUCKETS = 32


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's; a local one only for a session in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL
    return base.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, so that its lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/codelake/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Conflict(RuntimeError):
    """Somebody else committed since the change began."""


class Store:
    """Tables below a root, each partitioned by repo_id; schemas: name -> (columns without repo_id, key that rows are bucketed by)."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, tuple[str, str]], buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.tables = {name: (StructType.fromDDL(columns), key) for name, (columns, key) in tables.items()}
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _path(self, *parts: str):
        path = self._hadoop.Path("/".join((self.root, *parts)))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, *parts: str) -> list[str]:
        fs, path = self._path(*parts)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    @staticmethod
    def _valid(repo_id: str) -> str:
        if not re.fullmatch(r"[a-zA-Z0-9_-]{1,200}", repo_id):
            raise ValueError("a repository's id is made of letters, digits, _ and -")
        return repo_id

    def versions(self, repo_id: str) -> list[int]:
        """The committed versions of a repository that are still there, ascending."""
        return [int(n[:-5]) for n in self._names("_heads", self._valid(repo_id)) if re.fullmatch(r"\d+\.json", n)]

    def repos(self) -> list[str]:
        return [r for r in self._names("_heads") if self.versions(r)]

    def head(self, repo_id: str, version: int | None = None) -> tuple[int, dict[str, dict[str, str]]]:
        """A version's number and its tables' buckets with the folders that hold them; the newest, or 0 and nothing."""
        known = self.versions(repo_id)
        version = (known[-1] if known else 0) if version is None else version
        if not version:
            return 0, {}
        fs, path = self._path("_heads", repo_id, f"{version:010d}.json")
        stream = fs.open(path)
        try:
            return version, json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, table: str, repo_id: str | None = None, version: int | None = None) -> DataFrame:
        """A table's rows of one repository or of all; of the newest version, or of one that is still there."""
        return self._frame(table, {repo: self.head(repo, version)[1].get(table, {}) for repo in (self.repos() if repo_id is None else [repo_id])})

    def _frame(self, table: str, held: dict[str, dict[str, str]]) -> DataFrame:
        """Rows of the buckets that are held, by repository."""
        schema = StructType(list(self.tables[table][0].fields)).add("repo_id", "string")
        paths = [f"{self.root}/{table}/repo_id={repo}/{folder}/bucket={b}" for repo, folders in held.items() for b, folder in folders.items()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        # The folders name the repository, so a filter on it reads no other's files.
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*paths).select(schema.names)

    def bucket(self, key: str | Column) -> Column:
        return F.pmod(F.xxhash64(F.col(key) if isinstance(key, str) else key), F.lit(self.buckets)).cast("int")

    @contextmanager
    def change(self, repo_id: str):
        """A Change of a repository; it is committed when the block ends, and leaves nothing behind if that fails."""
        change = Change(self, self._valid(repo_id))
        try:
            yield change
            change._commit()
        except BaseException:
            change._undo()
            raise

    def restore(self, repo_id: str, version: int) -> int:
        """Commits an earlier version's content as the newest one."""
        return self._put_head(repo_id, self.head(repo_id)[0] + 1, self.head(repo_id, version)[1])

    def drop(self, repo_id: str) -> None:
        """Takes a repository away, its heads first."""
        for parts in [("_heads", self._valid(repo_id)), *((t, f"repo_id={repo_id}") for t in self.tables)]:
            fs, path = self._path(*parts)
            fs.delete(path, True)

    def vacuum(self, repo_id: str, keep: int = 2) -> int:
        """Deletes all but the last `keep` versions and every folder that none of them names, how many; no change may be under way."""
        for version in self.versions(repo_id)[:-keep]:
            fs, path = self._path("_heads", repo_id, f"{version:010d}.json")
            fs.delete(path, False)
        heads, gone = [self.head(repo_id, v)[1] for v in self.versions(repo_id)], 0
        for table in self.tables:
            used = {folder for h in heads for folder in h.get(table, {}).values()}
            for folder in self._names(table, f"repo_id={repo_id}"):
                if folder.startswith("version=") and folder not in used:
                    fs, path = self._path(table, f"repo_id={repo_id}", folder)
                    fs.delete(path, True)
                    gone += 1
        return gone

    def _put_head(self, repo_id: str, version: int, held: dict[str, dict[str, str]]) -> int:
        fs, target = self._path("_heads", repo_id, f"{version:010d}.json")
        _, temporary = self._path("_heads", repo_id, f".{uuid.uuid4().hex}")
        stream = fs.create(temporary, True)
        stream.write(json.dumps(held, sort_keys=True).encode())
        stream.close()
        # A rename onto a file that is there fails on the file systems that Spark writes to, but for local ones; hence the look before.
        if fs.exists(target) or not fs.rename(temporary, target):
            fs.delete(temporary, False)
            raise Conflict(f"{repo_id} has a version {version} by now")
        return version


class Change:
    """Buckets that are written but not committed, in folders named after the change. read gives a table as it will be, was how it has been."""

    def __init__(self, store: Store, repo_id: str):
        self.store, self.repo_id = store, repo_id
        self.base, self._before = store.head(repo_id)
        self._after = {t: dict(b) for t, b in self._before.items()}
        self._name, self._written, self.version = f"version={self.base + 1}-{uuid.uuid4().hex[:12]}", 0, None
        #: Rows and buckets that were written, by table; counted while writing.
        self.metrics: dict[str, dict[str, int]] = {}

    def was(self, table: str) -> DataFrame:
        return self.store._frame(table, {self.repo_id: self._before.get(table, {})})

    def read(self, table: str) -> DataFrame:
        return self.store._frame(table, {self.repo_id: self._after.get(table, {})})

    def _write(self, table: str, rows: DataFrame, touched: list[int] | None) -> None:
        """Writes rows, whose buckets replace the touched ones, or all."""
        store, folder, seen = self.store, f"{self._name}-{self._written}", Observation()
        self._written += 1
        schema, key = store.tables[table]
        rows = rows.select(schema.names).withColumn("bucket", store.bucket(key))
        counted = rows.observe(seen, F.count("*").alias("rows"), F.collect_set("bucket").alias("buckets"))
        counted.repartition("bucket").write.partitionBy("bucket").parquet(f"{store.root}/{table}/repo_id={self.repo_id}/{folder}")
        # Where Spark finds while it runs that there are no rows, it leaves the counting out with them.
        some = any(n.startswith("bucket=") for n in store._names(table, f"repo_id={self.repo_id}", folder))
        got = seen.get if some else {"rows": 0, "buckets": []}
        present = sorted(got["buckets"])
        held = {} if touched is None else {b: f for b, f in self._after.get(table, {}).items() if int(b) not in touched}
        self._after[table] = held | {str(b): folder for b in present}
        self.metrics[table] = {"rows": got["rows"], "buckets": len(present)}

    def replace(self, table: str, rows: DataFrame) -> DataFrame:
        """rows take the place of all of the repository's; gives them as written."""
        self._write(table, rows, None)
        return self.read(table)

    def upsert(self, table: str, rows: DataFrame, gone: DataFrame | None = None) -> DataFrame:
        """rows take the place of those with the same key, the column that the table is bucketed by, and rows with a key in gone(key) leave; all rows
        of one key in rows stay. Only buckets of such keys are written anew. Gives the table as written."""
        key = self.store.tables[table][1]
        keys = rows.select(key) if gone is None else rows.select(key).unionByName(gone.select(key))
        keys = keys.where(F.col(key).isNotNull()).distinct()
        touched = sorted(r["bucket"] for r in keys.select(self.store.bucket(key).alias("bucket")).distinct().collect())  # no more than there are buckets
        if touched:
            old = self.store._frame(table, {self.repo_id: {b: f for b, f in self._after.get(table, {}).items() if int(b) in touched}})
            names = self.store.tables[table][0].names
            self._write(table, old.join(keys, key, "left_anti").select(names).unionByName(rows.select(names)), touched)
        return self.read(table)

    def _commit(self) -> None:
        self.version = self.store._put_head(self.repo_id, self.base + 1, self._after)

    def _undo(self) -> None:
        for table in self.store.tables:
            for k in range(self._written):
                fs, path = self.store._path(table, f"repo_id={self.repo_id}", f"{self._name}-{k}")
                fs.delete(path, True)
