"""Approximate nearest neighbours by largest inner product, with an inverted multi-index.

Each half of a vector has a codebook of its own; a vector stands in the cell of its two nearest centroids. A query walks the pairs of centroids
with a heap, from the largest sum of its halves' products with them downwards, until the cells it passed hold enough vectors; these are ranked
by the product itself. The walk ends at a sum; so a query needs to carry just that sum, and a block of the index finds the cells above it.
In a block, entries lie by cell, and a run of whole cells is multiplied only with the queries whose walk passed one of them.

Equal vectors are one entry with its smallest ids. Entries lie in blocks of neighbouring cells; a cell of many entries is dealt over several
blocks. Queries go to the blocks that their walk touched, packed, and are streamed past the block there.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, mix64, stage_table


@dataclass(frozen=True)
class IndexConfig:
    """centroids of each half (a quarter of the sample at most); the sample of vectors (those of the smallest id hashes) that they are fitted on; the share of all entries that a
    walk passes at least; entries a block; entries of a run, which ends with the cell that fills it."""

    centroids: int = 64
    sample: int = 16_000
    rounds: int = 8
    share: float = 0.55
    block: int = 8_192
    run: int = 64


def usable(vector: Column, dims: int) -> Column:
    """Vectors of the usual length with finite components that aren't all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) == dims) & ~bad & F.exists(vector, lambda x: x != 0)


def kmeans(points: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """k centroids by Lloyd's rounds from evenly spaced points; an empty one keeps its place."""
    centres = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(points, centres)
        count = np.bincount(near, minlength=k)
        for d in range(points.shape[1]):
            total = np.bincount(near, points[:, d], minlength=k)
            centres[:, d] = np.where(count > 0, total / np.maximum(count, 1), centres[:, d])
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * points @ centres.T, axis=1)


def walk(one: np.ndarray, two: np.ndarray, held: np.ndarray, enough: int) -> tuple[float, np.ndarray]:
    """The sum at which the walk ends and the cells passed, for a query's products with the centroids of both halves.

    held: entries by cell (one row a centroid of the first half). All cells with the last sum belong to the walk."""
    a, b = np.argsort(-one, kind="stable").tolist(), np.argsort(-two, kind="stable").tolist()
    x, y = one[a].tolist(), two[b].tolist()
    k, rows, cells, got, last = len(b), held.tolist(), [], 0, -np.inf
    heap, column = [(-(x[0] + y[0]), 0, 0)], 0
    while heap:
        if got >= enough and -heap[0][0] < last:
            break
        s, i, j = heap[0]
        last = -s
        cell = a[i] * k + b[j]
        n = rows[a[i]][b[j]]
        if n:
            got += n
            cells.append(cell)
        # Each row of the sorted products is a sequence; the next row opens when the row before it is entered.
        if j + 1 < k:
            heapq.heapreplace(heap, (-(x[i] + y[j + 1]), i, j + 1))
        else:
            heapq.heappop(heap)
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(x[i + 1] + y[0]), i + 1, 0))
    return last, np.array(cells, np.int64)


def cell_runs(cell: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, end) of runs over ascending cells: whole cells, as many as it takes for `least` entries."""
    ends = np.append(np.flatnonzero(np.diff(cell)) + 1, len(cell))
    out, start = [], 0
    for end in ends.tolist():
        if end - start >= least or end == len(cell):
            out.append((start, end))
            start = end
    return [r for r in out if r[1] > r[0]]


def passed_products(m: np.ndarray, sums: np.ndarray, one: np.ndarray, two: np.ndarray, vector: np.ndarray, cell: np.ndarray, runs: list[tuple[int, int]]) -> np.ndarray:
    """Products of queries m with the entries in cells that their walk passed, -inf elsewhere; one and two: m's products with the halves' centroids.

    Of a run, only queries that passed one of its cells are multiplied."""
    score, k = np.full((len(m), len(cell)), -np.inf), two.shape[1]
    for start, end in runs:
        cells, at = np.unique(cell[start:end], return_inverse=True)
        passed = one[:, cells // k] + two[:, cells % k] >= sums[:, None] - 1e-9
        asks = np.flatnonzero(passed.any(axis=1))
        if len(asks):
            product = m[asks] @ vector[start:end].T
            score[asks, start:end] = product if len(cells) == 1 else np.where(passed[asks][:, at], product, -np.inf)
    return score


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def ann_search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", config: IndexConfig = IndexConfig()) -> DataFrame:  # noqa: B008
    """(query_id, rank, vec_id, score): for each row that is_query names, the k rows found with the largest inner products, in double precision.

    A row is no neighbour of its own id. Ties go to the smaller id; fewer than k candidates give fewer rows. Null ids and vectors that are null,
    zero, of an unusual length or hold null or non-finite components take no part, neither as queries. Of repeated rows (one id, one vector) one
    counts; one id with several vectors is several candidates. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    lengths = vectors.where(F.col(vector_col).isNotNull()).groupBy(F.size(vector_col).alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    dims = lengths.dims if lengths else 0
    kind = "float" if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("vector"), is_query.alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector"), dims))

    # The k + 1 smallest ids of equal vectors are all that can be found of them; more are left out before the rows move.
    ranked = rows.select("id", "vector").withColumn("r", F.dense_rank().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("r") <= k + 1)
    entries = ranked.groupBy("vector").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    entries = stage_table(entries.select(F.col("ids")[0].alias("entry"), "ids", "vector"), "ann-entries")
    n = entries.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    half = dims // 2
    sample = entries.orderBy(F.xxhash64("entry"), "entry").limit(config.sample).select("vector").toArrow()
    points = _matrix(sample.column("vector"))
    size = max(1, min(config.centroids, len(points) // 4))
    books = kmeans(points[:, :half], size, config.rounds), kmeans(points[:, half:], size, config.rounds)
    sent = spark.sparkContext.broadcast(books)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column(2))
                cell = nearest(m[:, :half], sent.value[0]) * size + nearest(m[:, half:], sent.value[1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=["entry", "ids", "vector", "cell"])

    index = stage_table(map_arrow(entries, place, f"entry long, ids array<long>, vector array<{kind}>, cell int"), "ann-index")
    held = np.zeros(size * size, np.int64)
    for row in index.groupBy("cell").count().collect():  # at most centroids squared
        held[row.cell] = row["count"]
    # Neighbouring cells fill a block; a cell above a block's size has blocks of its own, over which its entries are dealt.
    first, parts, block, filled = np.zeros(size * size, np.int32), np.ones(size * size, np.int32), 0, 0
    for cell, count in enumerate(held.tolist()):
        if filled and filled + count > config.block:
            block, filled = block + 1, 0
        first[cell], filled = block, filled + count
        if count > config.block:
            parts[cell] = -(-count // config.block)
            block, filled = block + int(parts[cell]), 0
    blocks = block + 1
    enough = max(k + 1, int(np.ceil(config.share * n)))  # k neighbours beside the query's own entry
    layout = spark.sparkContext.broadcast((held.reshape(size, size), first, parts))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first, parts = layout.value
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                m = _matrix(part.column(1))
                names = np.asarray(part.column(0))
                one, two = m[:, :half] @ sent.value[0].T, m[:, half:] @ sent.value[1].T
                sums, at = np.empty(len(m)), {}
                for q in range(len(m)):
                    sums[q], cells = walk(one[q], two[q], held, enough)
                    touched = np.unique(first[cells])
                    for b in touched.tolist():
                        at.setdefault(b, []).append(q)
                    for c in cells[parts[cells] > 1].tolist():
                        for b in range(first[c] + 1, first[c] + parts[c]):
                            at.setdefault(b, []).append(q)
                data = [b"".join((len(qs).to_bytes(4, "little"), names[qs].astype("<i8").tobytes(), sums[qs].tobytes(), m[qs].tobytes())) for qs in at.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(at), pa.int32()), pa.array(data, pa.binary())], names=["block", "queries"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, index = None, [], None
        for batch in batches:
            kinds, blocks_ = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            i = 0
            while i < batch.num_rows:
                j = i
                while j < batch.num_rows and kinds[j] == 0 and blocks_[j] == blocks_[i]:
                    j += 1
                if j > i:
                    if blocks_[i] != now:
                        now, rows, index = blocks_[i], [], None
                    rows.append(batch.slice(i, j - i))
                    i = j
                    continue
                if blocks_[i] == now:
                    if index is None:
                        entry, vector, cell = (np.concatenate(c) for c in zip(*((np.asarray(r.column(2)), _matrix(r.column(3)), np.asarray(r.column(4), np.int64)) for r in rows), strict=True))
                        order, rows = np.argsort(cell, kind="stable"), []
                        index = entry[order], vector[order], cell[order], cell_runs(cell[order], config.run)
                    yield _best(batch.column(5)[i].as_py(), *index)
                i += 1

    def _best(data: bytes, entry: np.ndarray, vector: np.ndarray, cell: np.ndarray, runs: list[tuple[int, int]]) -> pa.RecordBatch:
        count = int.from_bytes(data[:4], "little")
        names = np.frombuffer(data, "<i8", count, 4)
        sums = np.frombuffer(data, "<f8", count, 4 + 8 * count)
        m = np.frombuffer(data, "<f8", count * dims, 4 + 16 * count).reshape(count, dims)
        score = passed_products(m, sums, m[:, :half] @ sent.value[0].T, m[:, half:] @ sent.value[1].T, vector, cell, runs)
        out = [], [], []
        for q in range(count):
            s = score[q]
            at = np.argpartition(-s, k)[: k + 1] if len(s) > k + 1 else np.arange(len(s))
            at = np.flatnonzero(s >= s[at].min()) if len(s) > k + 1 else at
            at = at[s[at] > -np.inf]
            exact = (vector[at] * m[q]).sum(axis=1)
            best = np.lexsort((entry[at], -exact))[: k + 1]
            out[0].append(np.full(len(best), names[q]))
            out[1].append(entry[at][best])
            out[2].append(exact[best])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["query", "entry", "score"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The block of each entry; entries of a cell that fills several are dealt over them."""
        _, first, parts = layout.value
        for batch in batches:
            cell, entry = np.asarray(batch.column(2)), np.asarray(batch.column(0)).astype(np.int64)
            own = first[cell] + (mix64(entry.view(np.uint64)) % parts[cell].astype(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *batch.columns], names=["block", "entry", "vector", "cell"])

    settled = map_arrow(index.select("entry", "vector", "cell"), settle, f"block int, entry long, vector array<{kind}>, cell int")
    placed = settled.select("block", F.lit(0).alias("kind"), "entry", "vector", "cell", F.lit(None).cast("binary").alias("queries"))
    asking = rows.where("asks").select(F.col("id").alias("query_id"), "vector").distinct()
    of_entry = asking.join(index.select("entry", "vector"), "vector").select("query_id", "entry")
    of_entry = stage_table(of_entry, "ann-queries")
    wanted = index.select("entry", "vector").join(of_entry.select("entry").distinct(), "entry", "left_semi")
    asked = map_arrow(wanted, ask, "block int, queries binary")
    asked = asked.select("block", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("entry"), F.lit(None).cast(f"array<{kind}>").alias("vector"), F.lit(None).cast("int").alias("cell"), "queries")
    met = placed.unionByName(asked).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "kind")
    found = map_arrow(met, rank, "query long, entry long, score double")

    best = Window.partitionBy("query").orderBy(F.desc("score"), "entry")
    top = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).select("query", "entry", "score")
    near = top.join(index.select("entry", "ids"), "entry").select("query", "score", F.explode("ids").alias("vec_id"))
    lists = near.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k + 1).alias("found"))
    own = of_entry.join(lists, F.col("entry") == F.col("query")).select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    out = own.select("query_id", F.posexplode("found").alias("at", "found"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("found.vec_id").alias("vec_id"), (-F.col("found.far")).alias("score"))
