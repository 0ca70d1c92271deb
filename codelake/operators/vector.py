"""Exact vector operators over chunks(id, repo_id, file, name, type, start_line, embedding)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..sources.store import stage


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a vector is null or has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def scored(chunks: DataFrame, queries: DataFrame, min_score: float | None = None) -> DataFrame:
    """Chunks of each query's repository with their similarity; queries(query_id, repo_id, query). Query sets are stated and few: they are the
    side that meets every chunk of its repository in an equi-join."""
    # Lengths are taken once a vector, before the join, not once a pair.
    met = chunks.withColumn("__held", norm(F.col("embedding"))).join(queries.withColumn("__asked", norm(F.col("query"))), "repo_id")
    score = F.coalesce(F.try_divide(dot(F.col("embedding"), F.col("query")), F.col("__held") * F.col("__asked")), F.lit(0.0))
    met = met.withColumn("score", F.round(score, 6)).drop("embedding", "query", "__held", "__asked")
    return met if min_score is None else met.where(F.col("score") >= min_score)


def scores(chunks: DataFrame, queries: DataFrame, block: int = 2048) -> DataFrame:
    """(query_id, id, score) of `scored`, the same to the last bit, by products of blocks: a repository's chunks and queries are dealt over blocks by their
    hash, and each two blocks meet once in a task. For where all scores are asked; the pairs still grow with chunks times queries of a repository."""
    whole = lambda c: F.when(~F.exists(c, lambda x: x.isNull()), c.cast("array<double>"))
    held = chunks.select("repo_id", "id", whole(F.col("embedding")).alias("v"))
    asked = queries.select("repo_id", "query_id", whole(F.col("query")).alias("v"))
    parts = [side.groupBy("repo_id").agg(F.ceil(F.count("*") / block).alias(n)) for side, n in ((held, "__c"), (asked, "__q"))]
    parts = parts[0].join(parts[1], "repo_id")

    def deal(side: DataFrame, key: str, own: str, other: str) -> DataFrame:
        met = side.join(parts, "repo_id").withColumn(own, F.pmod(F.xxhash64(key), F.col(own)))
        met = met.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        at = [F.col(c).alias(f"{own}_{c}") for c in ("repo_id", "__c", "__q")]  # names of its own, as both sides may come from one table
        return met.select(*at, F.col(key).alias(key), F.col("v").alias("v")).groupBy(*(f"{own}_{c}" for c in ("repo_id", "__c", "__q")))

    def compare(c: pa.Table, q: pa.Table) -> pa.Table:
        found = _cosines(q.column("v"), c.column("v"))
        rows, cols = np.repeat(np.arange(len(q)), len(c)), np.tile(np.arange(len(c)), len(q))
        return pa.table({"query_id": q.column("query_id").take(pa.array(rows)), "id": c.column("id").take(pa.array(cols)), "score": found.ravel()})

    types = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {chunks.schema['id'].dataType.simpleString()}, score double"
    met = deal(held, "id", "__c", "__q").cogroup(deal(asked, "query_id", "__q", "__c")).applyInArrow(compare, types)
    return met.withColumn("score", F.round("score", 6))


def _cosines(a: pa.ChunkedArray, b: pa.ChunkedArray) -> np.ndarray:
    """Similarities of each of a with each of b, summed up in the order of their components; 0 for vectors that are null, of no length or of different sizes."""
    a, b = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (a, b))
    size = [np.asarray(pc.fill_null(pc.list_value_length(x), 0)) for x in (a, b)]
    out = np.zeros((len(a), len(b)))
    for n in np.intersect1d(*size):
        if n:
            i, j = (np.flatnonzero(s == n) for s in size)
            x, y = (np.asarray(v.take(pa.array(k)).flatten(), float).reshape(-1, n).T.copy() for v, k in ((a, i), (b, j)))
            dots, one, two = np.zeros((len(i), len(j))), np.zeros(len(i)), np.zeros(len(j))
            for p, q in zip(x, y, strict=True):
                dots += np.outer(p, q)
                one += p * p
                two += q * q
            length = np.outer(np.sqrt(one), np.sqrt(two))
            out[np.ix_(i, j)] = np.divide(dots, length, out=np.zeros_like(dots), where=length != 0)
    return out


def top_k(rows: DataFrame, k: int, key: str = "query_id") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(chunks: DataFrame, queries: DataFrame, k: int, min_score: float | None = None, block: int = 2048) -> DataFrame:
    """top_k(scored(chunks, queries, min_score), k), the same to the last bit, by products of blocks.

    A repository's chunks and queries are dealt over blocks, and each two blocks meet once in a task. Fast products tell which chunks can be among a
    query's first k, and only these are scored as `cosine` does and leave the task. The products still grow with chunks times queries of a repository.
    """
    held = chunks.withColumn("embedding", _whole(chunks, "embedding"))
    asked = queries.withColumn("query", _whole(queries, "query"))
    parts = [side.groupBy("repo_id").agg(F.ceil(F.count("*") / block).alias(n)) for side, n in ((chunks, "__c"), (queries, "__q"))]
    parts = parts[0].join(parts[1], "repo_id")

    def deal(side: DataFrame, key: str, own: str, other: str) -> DataFrame:
        met = side.join(parts, "repo_id").withColumn(own, F.pmod(F.xxhash64(key), F.col(own)))
        met = met.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        at = [F.col(c).alias(f"{own}_{c}") for c in ("repo_id", "__c", "__q")]  # names of its own, as both sides may come from one table
        return met.select(*at, *(F.col(c).alias(c) for c in side.columns)).groupBy(*(f"{own}_{c}" for c in ("repo_id", "__c", "__q")))

    of_chunk, of_query = [c for c in chunks.columns if c != "embedding"], [c for c in queries.columns if c not in ("repo_id", "query")]

    def compare(c: pa.Table, q: pa.Table) -> pa.Table:
        rows, cols, score = _best(q.column("query"), c.column("embedding"), c.column("id"), k, min_score)
        c, q = c.select(of_chunk).take(pa.array(cols)), q.select(of_query).take(pa.array(rows))
        return pa.table([*c.columns, *q.columns, pa.array(score)], names=[*of_chunk, *of_query, "score"])

    types = StructType([*(chunks.schema[c] for c in of_chunk), *(queries.schema[c] for c in of_query), StructField("score", DoubleType())])
    met = deal(held, "id", "__c", "__q").cogroup(deal(asked, "query_id", "__q", "__c")).applyInArrow(compare, types)
    met = met.withColumn("score", F.round("score", 6))
    return top_k(met if min_score is None else met.where(F.col("score") >= min_score), k)


def _whole(rows: DataFrame, name: str) -> Column:
    """A vector that lacks none of its components, or null."""
    kind = rows.schema[name].dataType.simpleString()
    return F.when(~F.exists(name, lambda x: x.isNull()), F.col(name) if kind == "array<float>" else F.col(name).cast("array<double>"))


#: By how much a score may lie below another and yet be rounded to the same six digits, and what the fast products may be off besides.
NEAR = 1.1e-6


def _best(a: pa.ChunkedArray, b: pa.ChunkedArray, ids: pa.ChunkedArray, k: int, least: float | None, together: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of a, which of b can be among its first k by rounded score and then id, with their scores: row, column, score. Of equal scores those of the smallest ids."""
    a, b, ids = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (a, b, ids))
    order = np.empty(len(b), np.int64)
    order[np.asarray(pc.sort_indices(ids, null_placement="at_start"))] = np.arange(len(b))
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for start in range(0, len(a), together) if len(b) else ():
        part = a.slice(start, together)
        score = _products(part, b)
        score = np.where(np.isnan(score), np.inf, score)
        last = np.full(len(part), -np.inf)
        if len(b) > k:
            last = np.partition(score, len(b) - k, axis=1)[:, len(b) - k]
        fit = score >= (last - NEAR)[:, None]
        if least is not None:
            fit &= score >= least - NEAR
        rows, cols = np.nonzero(fit)
        exact = _cosine(part.take(pa.array(rows)), b.take(pa.array(cols)))
        lost = np.isnan(exact)
        value = np.where(lost, np.inf, exact)
        by = np.lexsort((order[cols], value, lost, rows))
        rows, cols, exact, lost, value = (x[by] for x in (rows, cols, exact, lost, value))
        first = np.flatnonzero(np.r_[True, (np.diff(rows) != 0) | (lost[1:] != lost[:-1]) | (value[1:] != value[:-1])]) if len(rows) else np.empty(0, np.int64)
        place = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
        stay = place < k
        out.append((rows[stay] + start, cols[stay], exact[stay]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _products(a: pa.Array, b: pa.Array) -> np.ndarray:
    """_cosines but for some 1e-12, by products of matrices; the same where lengths are such that products might be off by more."""
    size = [np.asarray(pc.fill_null(pc.list_value_length(x), 0)) for x in (a, b)]
    out = np.zeros((len(a), len(b)))
    for n in np.intersect1d(*size):
        if n:
            i, j = (np.flatnonzero(s == n) for s in size)
            u, v = a.take(pa.array(i)), b.take(pa.array(j))
            x, y = (np.asarray(w.flatten(), float).reshape(-1, n) for w in (u, v))
            squares = [np.einsum("ij,ij->i", m, m) for m in (x, y)]
            if all((((s > 1e-100) & (s < 1e100)) | ~m.any(axis=1)).all() for s, m in zip(squares, (x, y), strict=True)):
                length = [np.where(s > 0, np.sqrt(s), 1) for s in squares]
                found = (x / length[0][:, None]) @ (y / length[1][:, None]).T
            else:
                found = _cosines(u, v)
            if len(i) == len(a) and len(j) == len(b):
                return found
            out[np.ix_(i, j)] = found
    return out


def _cosine(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Similarities of each of a with its fellow in b, as _cosines has them."""
    size = [np.asarray(pc.fill_null(pc.list_value_length(x), 0)) for x in (a, b)]
    out = np.zeros(len(a))
    for n in np.unique(size[0][size[0] == size[1]]):
        if n:
            i = np.flatnonzero((size[0] == n) & (size[1] == n))
            x, y = (np.asarray(v.take(pa.array(i)).flatten(), float).reshape(-1, n).T for v in (a, b))
            dots, one, two = (np.zeros(len(i)) for _ in range(3))
            for p, q in zip(x, y, strict=True):
                dots += p * q
                one += p * p
                two += q * q
            length = np.sqrt(one) * np.sqrt(two)
            out[i] = np.divide(dots, length, out=np.zeros_like(dots), where=length != 0)
    return out


def search(chunks: DataFrame, queries: DataFrame, k: int = 5, min_score: float | None = None) -> DataFrame:
    chunks = chunks.select("repo_id", "id", "file", "name", "start_line", "embedding")
    return nearest(chunks, queries, k, min_score).select("query_id", "rank", "id", "file", "name", "start_line", "score")


def similarity_reason(score: Column) -> Column:
    """Fixed texts by similarity."""
    return (
        F.when(score >= 0.95, "Nearly identical code - strong duplicate candidate")
        .when(score >= 0.85, "Very similar implementation - consider refactoring")
        .when(score >= 0.75, "Similar code pattern - review for consistency")
        .otherwise("Related implementation")
    )


def neighbours(chunks: DataFrame, k: int = 5, min_score: float = 0.7, block: int = 1024) -> DataFrame:
    """(id, neighbour, score, rank): each chunk's most similar others in its repository, by blocked products of matrices.

    Chunks are dealt over blocks of their repository by the hash of their id; two blocks meet once and answer for both, so no task holds more than
    two blocks, whatever a repository's size, and gives no more than k rows a chunk. Null vectors take no part.
    """
    unit = chunks.where("embedding is not null").select("repo_id", F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    sizes = unit.groupBy("repo_id").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    dealt = unit.join(sizes, "repo_id").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("repo_id", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "id", "v")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        part, ids = np.asarray(table.column("part")), np.asarray(table.column("id"))
        m = np.asarray(table.column("v").combine_chunks().flatten(), float).reshape(len(ids), -1)
        length = np.linalg.norm(m, axis=1)
        m = m / np.where(length > 0, length, 1)[:, None]
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        one, two = np.flatnonzero(part == a), np.flatnonzero(part == b)
        score = np.round(m[one] @ m[two].T, 6)
        found = [_nearest(score, ids[one], ids[two], k, min_score)]
        if a != b:
            found.append(_nearest(score.T, ids[two], ids[one], k, min_score))
        return pa.table({name: np.concatenate([f[i] for f in found]) for i, name in enumerate(("id", "neighbour", "score"))})

    pairs = dealt.groupBy("repo_id", "a", "b").applyInArrow(compare, "id long, neighbour long, score double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "neighbour"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def _nearest(score: np.ndarray, ids: np.ndarray, others: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the k best columns of at least that score, but for its own id; others ascend, so ties go to the smaller ones."""
    fit = (score >= least) & (ids[:, None] != others[None, :])
    many = np.flatnonzero(fit.sum(axis=1) > k)
    best = np.argsort(np.where(fit[many], -score[many], np.inf), axis=1, kind="stable")[:, :k]
    fit[many] = False
    fit[many[:, None], best] = True
    rows, cols = np.nonzero(fit)
    return ids[rows], others[cols], score[rows, cols]


def by_file(chunks: DataFrame, limit: int | None = None) -> DataFrame:
    """Chunks of each file by line; limit keeps the first of each."""
    rank = F.row_number().over(Window.partitionBy("repo_id", "file").orderBy("start_line", "id"))
    rows = chunks.select("repo_id", "file", "id", "name", "start_line").withColumn("rank", rank)
    return rows if limit is None else rows.where(F.col("rank") <= limit)


def by_type(chunks: DataFrame, kind: str) -> DataFrame:
    return chunks.where(F.col("type") == kind).select("repo_id", "id", "file", "name", "type")


def repo_stats(chunks: DataFrame, top: int = 10) -> DataFrame:
    """(repo_id, chunks, files, functions, types, top_files): the counts of a repository, in all and by type (a map), and its files with most chunks."""
    totals = chunks.groupBy("repo_id").agg(F.count("*").alias("chunks"), F.countDistinct("file").alias("files"), F.count_if(F.col("type") == "Function").alias("functions"))
    by = chunks.groupBy("repo_id", "file").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("n"), "file"))
    names = by.withColumn("rank", rank).where(F.col("rank") <= top).groupBy("repo_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "file", "n"))), lambda x: F.concat_ws(":", x["file"], x["n"])), ",").alias("top_files"))
    types = chunks.groupBy("repo_id", F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"))
    types = types.groupBy("repo_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("types"))
    return totals.join(types, "repo_id").join(names, "repo_id")


def similar_minus_duplicates(chunks: DataFrame, queries: DataFrame, near: float, same: float, limit: int = 10) -> DataFrame:
    """Similar chunks of each query (query_id, repo_id, query, query_file, query_line), without those around its own place, then duplicates of
    other files that aren't among them; at most `limit`."""
    # Both lists are the first of one order, so one search gives them; it is written, as three sides read it.
    met = stage(nearest(chunks.select("repo_id", "id", "file", "start_line", "embedding"), queries, 5, near), "met")
    similar = met.where(~((F.col("file") == F.col("query_file")) & (F.abs(F.col("start_line") - F.col("query_line")) < 5)))
    copies = met.where((F.col("score") >= same) & (F.col("rank") <= 3) & (F.col("file") != F.col("query_file")))
    copies = copies.join(similar.select("query_id", "file", "start_line"), ["query_id", "file", "start_line"], "left_anti")
    both = similar.withColumn("section", F.lit(0)).unionByName(copies.withColumn("section", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("section", F.desc("score"), "id"))
    return both.withColumn("place", rank).where(F.col("place") <= limit).select("query_id", "place", "section", "id", "file", "start_line", "score", similarity_reason(F.col("score")).alias("reason"))


def hashing_encoder(dims: int = 384):
    """A text encoder that needs no model: words hashed into `dims` places, of unit length; a pandas UDF from string to array<float>."""
    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        import zlib

        def one(text: str | None) -> list[float]:
            v = np.zeros(dims)
            for w in (text or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % dims] += 1 if h & 0x10000 else -1
            n = np.linalg.norm(v)
            return (v / n if n else v).astype(np.float32).tolist()

        return texts.map(one)

    return encode
