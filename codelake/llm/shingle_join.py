"""Similarity self-join of documents on word n-gram sets, by prefix filters under several global orders.

If two sets of n and m shingles have a Jaccard similarity of at least t, then under any one order of all shingles the first n - ceil(t n) + 1
of the one and the first m - ceil(t m) + 1 of the other share a shingle. Three orders are used, all with rare shingles first and each with ties
of its own; a pair must share a shingle of the prefixes under all three before the sets are compared.

How many sets hold a shingle is found without moving a document: blocks of documents send the 48-bit ends of their shingles' hashes, packed,
to shards by the hash's beginning, and shards answer with the shingles that occur in more sets than one. A set whose rarest shingles alone fill
its prefix can link with nothing and goes no further. Sets that are equal are one node from then on. A shingle is told from others by its shard
and those 48 bits: with 50 shards, of a billion different ones some 35 agree with another, and a link changes only if such a pair tips it.

Links are wanted for the groups they make, so pairs within a group that is known already are not compared: a few rounds compare each list's
documents with one of them, and a last one compares what is still apart, all of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOW48, WordHashes, map_arrow, mix64, ngram_hashes, pack48, shard_count, shard_order, ship, stage_table, text_groups, unpack48
from .graph import components

#: Rounds that compare with a few documents of each list before the last one, and how many documents these are.
ROUNDS, PIVOTS = 5, 8

_SETS = "id {id}, n long, node binary, tokens array<long>, first array<long>, second array<long>, third array<long>, weight double"


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; fewer words make one shingle of all of them, no words none."""
    if not len(words):
        return words
    return np.unique(ngram_hashes(words, min(n, len(words))))


def prefix_size(n: int, percent: int) -> int:
    """Shingles of a set of n that any set with a similarity of percent / 100 shares one of."""
    return n - -(-percent * n // 100) + 1


def _rarity(counts: np.ndarray) -> np.ndarray:
    """A byte that rises with the count, exact up to 127."""
    return np.where(counts < 128, counts, 96 + 4 * np.log2(np.maximum(counts, 1)).astype(np.int64)).clip(0, 255).astype(np.uint8)


def shingle_sets(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, node, tokens, first, second, third, weight): a row a document; the arrays only for one document of each set in a block that may
    link.

    node names the set (a 128-bit hash; null if it is empty), tokens are its shingles that other sets or blocks hold too, first to third its
    prefixes under the three orders, and weight tells how common its shingles are on average.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shards = min(shard_count(source), 1 << 15)
    id_type = docs.schema[id_col].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes, block = WordHashes(), TaskContext.get().partitionId() << 24
        for batch, texts in text_groups(batches, rows=1 << 16):  # a set's number in its block has 16 bits
            seen: dict[bytes, int] = {}
            sets, of, sizes = [], [], []
            for t in texts:
                s = shingle_set(hashes.of(t), n)
                sizes.append(len(s))
                if not len(s):
                    of.append(-1)
                    continue
                name = xxhash.xxh3_128_digest(s)
                if name not in seen:
                    seen[name] = len(sets)
                    sets.append(s)
                of.append(seen[name])
            head = pa.table({"id": batch.column(0), "n": pa.array(sizes, pa.int64()), "of": pa.array(of, pa.int32())})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, head.schema) as out:
                out.write_table(head)
            own = len(seen).to_bytes(4, "little") + b"".join(seen) + sink.getvalue().to_pybytes()
            keys, blocks, data = [-1 - block], [block], [own]
            if sets:
                tokens = np.concatenate(sets)
                index = np.repeat(np.arange(len(sets), dtype="<u2"), [len(s) for s in sets])
                order, ends = shard_order(tokens, shards)
                tokens, index = tokens[order] & LOW48, index[order]
                start = 0
                for k, end in enumerate(ends):
                    if end > start:
                        keys.append(k)
                        blocks.append(block)
                        data.append((end - start).to_bytes(4, "little") + pack48(tokens[start:end]).tobytes() + index[start:end].tobytes())
                    start = end
            block += 1
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blocks, pa.int64()), pa.array(data, pa.binary())], names=["key", "block", "payload"])

    def count(table: pa.Table) -> pa.Table:
        key = table.column(0)[0].as_py()
        if key < 0:  # a block's own row
            return table
        blocks, rows = table.column(1).to_pylist(), [p.as_py() for p in table.column(2)]
        lens = [int.from_bytes(r[:4], "little") for r in rows]
        tokens = np.concatenate([unpack48(memoryview(r)[4:], c) for r, c in zip(rows, lens, strict=True)])
        order = np.argsort(tokens)
        ordered = tokens[order]
        fresh = np.empty(len(ordered), bool)
        fresh[0] = True
        np.not_equal(ordered[1:], ordered[:-1], out=fresh[1:])
        starts = np.flatnonzero(fresh)
        counts = np.diff(np.append(starts, len(ordered)))
        rarity = np.empty(len(tokens), np.uint8)
        rarity[order] = np.repeat(_rarity(counts), counts)
        out_blocks, out, at = [], [], 0
        for block, row, c in zip(blocks, rows, lens, strict=True):
            r = rarity[at : at + c]
            common = np.flatnonzero(r > 1)
            if len(common):
                index = np.frombuffer(row, "<u2", c, 4 + 6 * c)[common]
                out_blocks.append(block)
                out.append(len(common).to_bytes(4, "little") + pack48(tokens[at : at + c][common]).tobytes() + index.tobytes() + r[common].tobytes())
            at += c
        return pa.table({"key": pa.array([key] * len(out), pa.int64()), "block": pa.array(out_blocks, pa.int64()), "payload": pa.array(out, pa.binary())})

    def gather(table: pa.Table) -> pa.Table:
        head, tokens, index, rarity = None, [], [], []
        for key, row in zip(table.column(0).to_pylist(), table.column(2), strict=True):
            data = row.as_py()
            c = int.from_bytes(data[:4], "little")
            if key < 0:
                names = [data[4 + 16 * i : 20 + 16 * i] for i in range(c)]
                head = pa.ipc.open_stream(data[4 + 16 * c :]).read_all()
                continue
            tokens.append(unpack48(memoryview(data)[4:], c) | np.uint64(key) << np.uint64(48))
            index.append(np.frombuffer(data, "<u2", c, 4 + 6 * c))
            rarity.append(np.frombuffer(data, np.uint8, c, 4 + 8 * c))
        if head is None:
            raise ValueError("answers without their block; the input changed while it was read")
        of, sizes = np.array(head.column("of")), np.array(head.column("n"))
        arrays: dict[int, tuple] = {}
        if tokens:
            tokens, index, rarity = np.concatenate(tokens).view(np.int64), np.concatenate(index), np.concatenate(rarity)
            size_of = np.zeros(len(names), np.int64)
            size_of[of[of >= 0]] = sizes[of >= 0]
            order = np.lexsort((tokens, index))
            tokens, index, rarity = tokens[order], index[order], rarity[order]
            ends = np.cumsum(np.bincount(index, minlength=len(names)))
            start = 0
            for i, end in enumerate(ends.tolist()):
                left = prefix_size(int(size_of[i]), percent) - int(size_of[i] - (end - start))
                if end > start and left > 0:
                    t, r = tokens[start:end], rarity[start:end]
                    u = t.view(np.uint64)
                    pick = lambda *by, t=t, left=left: t[np.lexsort(by)[:left]]
                    coarse = np.log2(r).astype(np.uint8)
                    arrays[i] = (t, pick(t, r), pick(mix64(u ^ LOW48), r), pick(mix64(u), coarse), float(np.log2(r).sum() / size_of[i]))
                start = end
        cells, nodes = [[] for _ in range(5)], []
        for i in of.tolist():
            got = arrays.pop(i, None)  # one document of the block stands for the set
            for k in range(5):
                cells[k].append(None if got is None else got[k])
            nodes.append(None if i < 0 else names[i])
        return pa.table([head.column("id"), head.column("n"), pa.array(nodes, pa.binary()), *(pa.array(c, pa.list_(pa.int64())) for c in cells[:4]), pa.array(cells[4], pa.float64())], names=["id", "n", "node", "tokens", "first", "second", "third", "weight"])

    schema = "key long, block long, payload binary"
    packed = map_arrow(source, split, schema)
    counted = packed.groupBy("key").applyInArrow(count, schema)
    gathered = counted.groupBy("block").applyInArrow(lambda table: gather(table.select(["key", "block", "payload"])), _SETS.format(id=id_type))
    return stage_table(gathered, "shingle-sets")


def _linked(a: str, b: str, percent: int):
    """That two sets link: a prefix token shared under the second and third order, then the exact test."""
    shared = F.size(F.array_intersect(f"{a}.tokens", f"{b}.tokens"))
    exact = F.lit(100) * shared >= F.lit(percent) * (F.col(f"{a}.n") + F.col(f"{b}.n") - shared)
    return F.arrays_overlap(f"{a}.second", f"{b}.second") & F.arrays_overlap(f"{a}.third", f"{b}.third") & exact


def link_components(sets: DataFrame, percent: int) -> DataFrame:
    """(node, comp) for the nodes that link with another: comp is the same for all nodes that reach each other."""
    whole = sets.where("tokens is not null").groupBy("node").agg(*(F.any_value(c).alias(c) for c in ("n", "tokens", "first", "second", "third", "weight")))
    whole = stage_table(whole, "nodes")
    # Before a token come the set's unique shingles and those of its prefix that are rarer.
    lists = whole.select("node", "n", "weight", (F.col("n") - F.size("tokens")).alias("unique"), F.posexplode("first").alias("place", "token"))
    lists = lists.select("node", "n", "weight", (F.col("unique") + F.col("place")).alias("before"), "token")
    shared = lists.groupBy("token").count().where("count > 1").select("token")
    lists = stage_table(lists.join(shared, "token"), "lists")
    labels = stage_table(whole.select("node", F.col("node").alias("comp")), "labels")
    # A pair is wanted at its first common shingle; there the sets can't share more than what follows in the shorter rest. At a later one this
    # is too strict, but then the pair has been met before.
    near = F.expr(f"{100 + percent} * least(x.n - x.before, y.n - y.before) >= {percent} * (x.n + y.n)")
    for step in range(ROUNDS + 1):
        # A list's major component has most of its documents (at first, the one with the commonest shingles: what others are copies of). It needs
        # no comparison within; the rest is compared with some of its documents, and in the last round with everything that is apart from it.
        at = lists.join(labels, "node")
        parts = at.groupBy("token", "comp").agg(F.count("*").alias("size"), F.max("weight").alias("heaviest"))
        major = parts.groupBy("token").agg(F.max_by("comp", F.struct("size", "heaviest", "comp")).alias("major"), F.count("*").alias("parts")).where("parts > 1").select("token", "major")
        major = stage_table(major, "majors")
        if major.isEmpty():
            break
        # Lists of one component are done with for good: components only grow.
        at = stage_table(at.join(major, "token"), "lists")
        lists = at.drop("comp", "major")
        rest = at.where("comp <> major")
        if step < ROUNDS:
            # Documents of common shingles link with most; which of them are taken changes from round to round.
            luck = F.pmod(F.xxhash64("node", F.lit(step)), F.lit(1000)) / 1000
            order = F.desc(F.col("weight") * (1 + 0.1 * luck * min(step, 1)))
            chosen = at.where("comp = major").withColumn("place", F.row_number().over(Window.partitionBy("token").orderBy(order, "node"))).where(F.col("place") <= PIVOTS)
            pairs = rest.alias("x").join(chosen.alias("y"), "token")
        else:
            pairs = rest.alias("x").join(at.alias("y"), "token").where("x.comp <> y.comp and (y.comp = x.major or x.node < y.node)")
        pairs = pairs.where(near).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.comp").alias("ca"), F.col("y.comp").alias("cb")).distinct()
        left, right = whole.alias("l"), whole.alias("r")
        found = pairs.join(left, F.col("a") == F.col("l.node")).join(right, F.col("b") == F.col("r.node")).where(_linked("l", "r", percent))
        found = stage_table(found.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "links")
        if not found.isEmpty():
            joined = components(found).select(F.col("node").alias("was"), F.col("comp").alias("now"))
            labels = labels.join(joined, F.col("comp") == F.col("was"), "left").select("node", F.coalesce("now", "comp").alias("comp"))
            labels = stage_table(labels, "labels")
    return labels


def shingle_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles long, component_id): one row a document, documents that reach each other by links have the same component_id.

    A-Z are lower-cased and words are runs of other characters than [\\x20\\x09-\\x0D]. Two documents link if 100 * |both| >= percent * |either|
    for their sets of distinct n-word shingles; fewer words make one shingle of all. Without words, or text, a document has no shingle and
    links with nothing. component_id is the smallest id in reach, its own included; null ids link, but never are the smallest, unless alone.
    Repeated rows give repeated rows; other columns are left out.
    """
    sets = shingle_sets(docs, n, percent, id_col, text_col)
    labels = link_components(sets, percent)
    own = sets.where("node is not null").groupBy("node").agg(F.min("id").alias("least"))
    labelled = own.join(labels, "node", "left").select("node", "least", F.coalesce("comp", "node").alias("comp"))
    smallest = labelled.groupBy("comp").agg(F.min("least").alias("component_id"))
    by_node = stage_table(labelled.join(smallest, "comp").select("node", "component_id"), "components")
    out = sets.select("id", "n", "node").join(by_node, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
