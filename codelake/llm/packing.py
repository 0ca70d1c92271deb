"""Best-fit packing of token pieces into sequences, by a grouping genetic algorithm on islands.

Pieces are dealt at random over groups of bounded size, each of which is packed by itself. In a group every island holds a population of
packings; crossover injects well-filled bins of one parent whole into the other, takes out the bins that hold the same pieces, and best-fits
the displaced ones, each into the fullest bin with room, or up to four at a time into new bins; mutation empties the worst bins. Children
are improved by replacement: two bins swap a piece each where that fills one of them. After each epoch an island's best packing moves to the
next island. A group that reaches the least possible number of bins stops. Then the groups' poorly filled bins are opened, and their pieces
packed once more, together, as long as that frees bins.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .chunks import ChunkCache
from .common import map_arrow, ship, stage_table, text_groups


#: Chunks that a worker remembers in each generation.
CACHED = 350_000

#: Fixed value: how byte-level tokenizers cut texts before merging.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class PackConfig:
    """capacity: tokens a sequence. group: pieces packed together (on average). The rest steers the search."""

    capacity: int = 1024
    group: int = 8_192
    islands: int = 2
    population: int = 4
    generations: int = 4
    epochs: int = 4
    #: Bins with at least this share of their room left are opened for the next round; one that frees less than `gain` of them is the last, and so
    #: is the one of number `rounds`.
    spare: float = 0.02
    gain: float = 0.01
    rounds: int = 8


def best_fit(lengths: list[int], order: list[int], free: list[int], capacity: int) -> list[int]:
    """The bin of each piece of `order`, one after the other into the fullest bin that has room; free: room by bin, which grows with new bins.

    Bins stand in stacks by room, and the bits of one integer tell which rooms there are: the first at or above a length is a find-first-set."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for b, room in enumerate(free):
        if room:
            stacks[room].append(b)
            rooms |= 1 << room
    out = []
    for p in order:
        n = lengths[p]
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            stack = stacks[room]
            b = stack.pop()
            if not stack:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(free)
            free.append(capacity)
        left = room - n
        free[b] = left
        if left:
            if not stacks[left]:
                rooms |= 1 << left
            stacks[left].append(b)
        out.append(b)
    return out


def complete(lengths: list[int], pieces: list[int], capacity: int, tries: int = 24, deep: int = 6) -> list[list[int]]:
    """Bins for `pieces`, each begun with the largest that is left and filled by the up to three others that leave least room.

    The bits of one integer tell which lengths are left; tries and deep bound the pairs and triples that are looked at for a bin."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    there, bins = 0, []
    for p in reversed(pieces):
        stacks[lengths[p]].append(p)
        there |= 1 << lengths[p]

    def most(room: int, *taken: int) -> int:
        """The largest length up to room of which there is a piece beside the taken ones; -1 if there is none."""
        mask = there & ((2 << room) - 1) if room > 0 else 0
        for t in set(taken):
            if len(stacks[t]) <= taken.count(t):
                mask &= ~(1 << t)
        return mask.bit_length() - 1

    def fill(room: int) -> tuple[int, ...]:
        best: tuple[int, ...] = (most(room),)
        found, x = best[0], best[0]
        for _ in range(tries):
            if x <= 0 or found == room:
                break
            y = most(room - x, x)
            for _ in range(deep):
                if y <= 0 or found == room:
                    break
                z = max(0, most(room - x - y, x, y))
                if x + y + z > found:
                    found, best = x + y + z, (x, y, z) if z else (x, y)
                y = most(y - 1, x)
            x = most(x - 1)
        return best

    while there:
        held, room, wanted = [], capacity, (there.bit_length() - 1,)
        while wanted[0] > 0:
            for n in wanted:
                held.append(stacks[n].pop())
                if not stacks[n]:
                    there ^= 1 << n
                room -= n
            wanted = fill(room)
        bins.append(held)
    return bins


def least_bins(counts: np.ndarray) -> int:
    """A number of bins that no packing of counts[n] pieces of each length n, the capacity last, goes below: pieces above half a bin share it
    with none like them, and for each bound the smaller pieces down to it that don't fit beside the larger ones need bins of their own."""
    capacity = len(counts) - 1
    pieces, tokens = np.cumsum(counts[::-1])[::-1], np.cumsum((counts * np.arange(capacity + 1))[::-1])[::-1]  # of at least each length
    pieces, tokens = np.append(pieces, 0), np.append(tokens, 0)
    over = capacity // 2 + 1
    half, bounds = pieces[over], np.arange(over)
    alone = np.maximum(over, capacity - bounds + 1)  # at least so long: beside these not even the bound fits
    room = (half - pieces[alone]) * capacity - (tokens[over] - tokens[alone])
    return int((half + np.maximum(0, -(-(tokens[bounds] - tokens[over] - room) // capacity))).max())


class Packer:
    """The search in one group; lengths are in descending order, a packing is the bin number of each piece."""

    def __init__(self, lengths: np.ndarray, config: PackConfig, seed: int):
        self._lengths, self._config, self._random = lengths, config, np.random.default_rng(seed)
        self._list = lengths.tolist()
        self.least = least_bins(np.bincount(lengths, minlength=config.capacity + 1))

    def fitness(self, packing: np.ndarray) -> tuple[int, float]:
        """Bins, then how unevenly they are filled: fuller ones leave emptier ones to be emptied."""
        fill = np.bincount(packing, self._lengths)
        return int((fill > 0).sum()), -float((fill * fill).sum())

    def start(self) -> list[np.ndarray]:
        """Best fit of the pieces in descending order; bins filled one by one; best fit in orders that are shaken a little."""
        out = []
        for k in range(self._config.population):
            if k == 1:
                packing = self._packing(complete(self._list, list(range(len(self._list))), self._config.capacity))
            else:
                order = np.argsort(-self._lengths * self._random.uniform(1 - 0.025 * k, 1, len(self._lengths)), kind="stable")
                packing = np.empty(len(self._list), np.int64)
                packing[order] = best_fit(self._list, order.tolist(), [], self._config.capacity)
            out.append(packing)
            if self.fitness(packing)[0] == self.least:
                break
        return out

    def _packing(self, bins: list[list[int]]) -> np.ndarray:
        out = np.empty(len(self._list), np.int64)
        for b, held in enumerate(bins):
            out[held] = b
        return out

    def _refill(self, packing: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Packs the pieces of `out` (a mask) again: into the bins that the others leave, or into new ones, whichever is better."""
        names, kept = np.unique(packing[~out], return_inverse=True)
        free = (self._config.capacity - np.bincount(kept, self._lengths[~out], minlength=len(names))).astype(int).tolist()
        child = np.empty_like(packing)
        child[~out] = kept
        displaced = np.flatnonzero(out)
        other = child.copy()
        child[displaced] = best_fit(self._list, displaced.tolist(), free, self._config.capacity)
        for b, held in enumerate(complete(self._list, displaced.tolist(), self._config.capacity)):
            other[held] = len(names) + b
        return self.replace(min(child, other, key=self.fitness))

    def replace(self, packing: np.ndarray, passes: int = 4) -> np.ndarray:
        """Swaps of a piece of one bin for one of another that fill the first and leave the second emptier than it was; so room gathers."""
        lengths, capacity, bins = self._list, self._config.capacity, packing.tolist()
        held: list[list[int]] = [[] for _ in range(max(bins, default=-1) + 1)]
        for p, b in enumerate(bins):
            held[b].append(p)
        room = [capacity - sum(lengths[p] for p in h) for h in held]
        for _ in range(passes):
            loose = sorted((b for b, h in enumerate(held) if h and room[b]), key=room.__getitem__)
            at: list[list[int]] = [[] for _ in range(capacity + 1)]
            for b in loose:
                for p in held[b]:
                    at[lengths[p]].append(p)
            swapped = False
            for b in loose:
                missing = room[b]
                for p in held[b] if missing else ():
                    stack = at[lengths[p] + missing] if lengths[p] + missing <= capacity else []
                    while stack:
                        q = stack.pop()
                        c = bins[q]
                        if c != b and room[c] >= missing:
                            held[b].remove(p)
                            held[c].remove(q)
                            held[b].append(q)
                            held[c].append(p)
                            bins[p], bins[q] = c, b
                            room[b], room[c] = 0, room[c] + missing
                            at[lengths[p]].append(p)
                            swapped = True
                            break
                    if not room[b]:
                        break
            if not swapped:
                break
        return np.array(bins, np.int64)

    def cross(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        fill = np.bincount(b, self._lengths)
        full = np.flatnonzero(fill >= self._config.capacity)
        if len(full) < 2:
            full = np.argsort(-fill)[: max(1, len(fill) // 4)]
        chosen = self._random.choice(full, max(1, len(full) // 3), replace=False)
        injected = np.isin(b, chosen)
        hit = np.zeros(int(a.max()) + 1, bool)
        hit[a[injected]] = True
        child = np.where(injected, b + len(hit), a)
        return self._refill(child, hit[a] & ~injected)

    def mutate(self, packing: np.ndarray) -> np.ndarray:
        fill = np.bincount(packing, self._lengths)
        used = np.flatnonzero(fill)
        worst = used[np.argsort(fill[used])][: max(2, len(used) // 50)]
        chosen = np.concatenate([worst, self._random.choice(used, max(2, len(used) // 50))])
        return self._refill(packing, np.isin(packing, chosen))

    def evolve(self, population: list[np.ndarray]) -> list[np.ndarray]:
        """A few generations; the best come first."""
        ranked = sorted(population, key=self.fitness)
        for _ in range(self._config.generations):
            if self.fitness(ranked[0])[0] <= self.least or len(ranked[0]) < 2:
                break
            i, j = self._random.integers(0, len(ranked), 2)
            children = [self.cross(ranked[i], ranked[j]), self.mutate(ranked[0])]
            ranked = sorted([*ranked, *children], key=self.fitness)[: self._config.population]
        return ranked


@lru_cache(maxsize=2)
def _ids(path: str) -> ChunkCache:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def encode(chunks: list[str]) -> list[bytes]:
        out = []
        for start in range(0, len(chunks), 10_000):
            out += [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(chunks[start : start + 10_000], add_special_tokens=False)]
        return out

    fast = _rank_encoder(path, tokenizer)
    if fast is None:
        return ChunkCache(encode, CACHED)
    special = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())

    def encode_fast(chunks: list[str]) -> list[bytes]:
        # The library looks for its added tokens first; only chunks that hold one need it.
        odd = [i for i, c in enumerate(chunks) if any(s in c for s in special)]
        out = [array("I", fast(c)).tobytes() for c in chunks]
        for i, ids in zip(odd, encode([chunks[i] for i in odd]), strict=True):
            out[i] = ids
        return out

    return ChunkCache(encode_fast, CACHED)


def _rank_encoder(path: str, tokenizer):
    """A faster encoder of the same ids where the vocabulary's ids rise with its merges, so that they serve as ranks; else None."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, steps = spec["model"], spec["pre_tokenizer"] or {}
    letters, vocab = byte_letters(), model["vocab"]
    joined = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    added = {t["content"] for t in spec["added_tokens"]}
    plain = steps.get("type") == "ByteLevel" and not steps.get("add_prefix_space") and steps.get("use_regex", True) and not spec["normalizer"] and not model.get("ignore_merges")
    if not plain or any(a >= b for a, b in zip(joined, joined[1:], strict=False)):
        return None
    ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in added}
    return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def token_pieces(docs: DataFrame, path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, piece, start, length, ids_crc32): each text's ids by the tokenizer's library, then end_id, cut into pieces of at most `capacity`.

    Only longer texts are cut; all pieces but the first are full. The tokenizer must be byte-level BPE, whose ids are those of the chunks between
    spaces (see chunks.py).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = end_id.to_bytes(4, "little")
        for batch, texts in text_groups(batches):
            rows, piece, start, length, crc = [], [], [], [], []
            for row, values in enumerate(_ids(path).of(texts)):
                values.append(end)
                ids = b"".join(values)
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    size = (n - at) % capacity or capacity
                    rows.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    at, k = at + size, k + 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))], names=["id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = map_arrow(source, run, f"id {source.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")
    return out.withColumnRenamed("id", id_col)


def _in_order(table: pa.Table) -> pa.Table:
    return table.sort_by([("length", "descending"), ("ids_crc32", "ascending"), ("start", "ascending"), ("number", "ascending")])


def pack(pieces: DataFrame, config: PackConfig = PackConfig()) -> DataFrame:  # noqa: B008
    """pieces(length, ids_crc32, start, ...) with sequence_id and offset: pieces of a sequence lie end to end from 0, capacity tokens at most.

    Full pieces are sequences by themselves. Every row is packed once, equal rows too; no row is larger than the capacity. Numbers of sequences
    are unique and otherwise arbitrary. An empty table stays empty. Rounds end when the bins that are still poor can't be fewer by their lengths,
    or when a round frees too few.
    """
    pieces = stage_table(pieces, "pieces")
    numbered = pieces.withColumn("number", F.monotonically_increasing_id())
    full = numbered.where(F.col("length") >= config.capacity).withColumns({"sequence_id": F.col("number"), "offset": F.lit(0).cast("long")})
    # The numbers are written, so that they stay as they are.
    loose, turn, packed = stage_table(numbered.where(F.col("length") < config.capacity), "loose-pieces"), 0, []
    opened, before = None, 0
    while True:
        groups = max(1, round(loose.count() / config.group))
        # By a number of their own rather than by what they hold, so that copies spread over all groups.
        dealt = loose.withColumn("group", F.pmod(F.xxhash64("number", F.lit(turn)), F.lit(groups)))
        placed = stage_table(_pack_groups(dealt, config, turn), "packed")
        bins = placed.agg(F.countDistinct("sequence_id").alias("all"), F.countDistinct(F.when(F.col("spare"), F.col("sequence_id"))).alias("poor")).first()
        if opened is not None and bins.all >= before:  # the bins were better as they stood
            packed.append(opened.drop("spare"))
            break
        slow = opened is not None and before - bins.all < config.gain * before
        # Poorly filled bins are packed again together, in far fewer groups, if that can save any.
        lengths = np.zeros(config.capacity + 1, np.int64)
        for row in placed.where("spare").groupBy("length").count().toLocalIterator():  # at most a row for each length
            lengths[row["length"]] = row["count"]
        turn += 1
        if groups == 1 or slow or turn == config.rounds or bins.poor <= least_bins(lengths):
            packed.append(placed.drop("spare"))
            break
        packed.append(placed.where("not spare").drop("spare"))
        opened, before = placed.where("spare"), bins.poor
        loose = opened.select(loose.columns)
    out = full
    for part in packed:
        out = out.unionByName(part)
    return out.select(*pieces.columns, "sequence_id", "offset")


def _pack_groups(loose: DataFrame, config: PackConfig, turn: int) -> DataFrame:
    """loose(group, number, length, ids_crc32, start, ...) without group, with sequence_id, offset and whether the sequence has room to spare."""
    ship(loose.sparkSession)
    state = "group long, island int, lengths binary, best binary, population binary, done boolean"
    names = [c.split(" ")[0] for c in state.split(", ")]

    def begin(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py()
        lengths = np.asarray(_in_order(table).column("length")).astype(np.int64)
        rows = []
        for island in range(config.islands):
            packer = Packer(lengths, config, seed=group * 1009 + island)
            rows.append(step(group, island, lengths, packer, packer.start()))
            if rows[-1]["done"]:
                break
        return pa.Table.from_pylist(rows, schema=arrow_state)

    def step(group: int, island: int, lengths: np.ndarray, packer: Packer, population: list[np.ndarray]) -> dict:
        ranked = packer.evolve(population)
        done = packer.fitness(ranked[0])[0] <= packer.least
        return {"group": group, "island": island, "lengths": lengths.astype("<u2").tobytes(), "best": ranked[0].astype("<u4").tobytes(), "population": b"".join(p.astype("<u4").tobytes() for p in ranked), "done": done}

    def evolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.frombuffer(row["lengths"], "<u2").astype(np.int64)
                data = row["population"] + (row["guest"] or b"")
                population = list(np.frombuffer(data, "<u4").astype(np.int64).reshape(-1, len(lengths)))
                packer = Packer(lengths, config, seed=row["group"] * 1009 + row["island"] + 7919 * row["epoch"])
                yield pa.RecordBatch.from_pylist([step(row["group"], row["island"], lengths, packer, population)], schema=arrow_state)

    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    arrow_state = pa.schema([(c.split(" ")[0], kinds[c.split(" ")[1]]) for c in state.split(", ")])
    narrow = loose.select("group", "number", "length", "ids_crc32", "start")
    islands = stage_table(narrow.groupBy("group").applyInArrow(begin, state), "islands")
    best = islands.select("group", "island", "best", "lengths")
    finished = islands.where("done").select("group").distinct()
    alive = islands.join(finished, "group", "left_anti")
    for epoch in range(1, config.epochs + 1):
        if alive.isEmpty():
            break
        guests = alive.select("group", F.pmod(F.col("island") + 1, F.lit(config.islands)).cast("int").alias("island"), F.col("best").alias("guest"))
        met = alive.join(guests, ["group", "island"], "left").select(*names, "guest", F.lit(epoch).alias("epoch"))
        moved = stage_table(map_arrow(met, evolve, state), "islands")
        best = best.unionByName(moved.select("group", "island", "best", "lengths"))
        alive = moved.join(moved.where("done").select("group").distinct(), "group", "left_anti")

    def assign(left: pa.Table, right: pa.Table) -> pa.Table:
        pieces_, found = _in_order(left), [np.frombuffer(b.as_py(), "<u4").astype(np.int64) for b in right.column("best")]
        lengths = np.asarray(pieces_.column("length")).astype(np.int64)
        packing = min(found, key=Packer(lengths, config, 0).fitness)
        order = np.argsort(packing, kind="stable")
        ends = np.cumsum(lengths[order])
        bins = packing[order]
        starts = ends - lengths[order]
        spare = (config.capacity - np.bincount(packing, lengths) >= config.spare * config.capacity)[packing]
        first = np.maximum.accumulate(np.where(np.append(True, bins[1:] != bins[:-1]), np.arange(len(bins)), 0))
        offset = np.empty_like(starts)
        offset[order] = starts - starts[first]
        group = pieces_.column("group")[0].as_py()
        names = (-1 - (turn << 56 | group << 24 | packing), offset, spare)
        out = pieces_.drop_columns(["group"])
        for name, values in zip(("sequence_id", "offset", "spare"), names, strict=True):
            out = out.append_column(name, pa.array(values))
        return out

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in loose.drop("group").schema.fields) + ", sequence_id long, offset long, spare boolean"
    return loose.groupBy("group").cogroup(best.groupBy("group")).applyInArrow(assign, columns)


def pack_documents(docs: DataFrame, path: str, end_id: int, config: PackConfig = PackConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset): a row for each piece of each text, packed.

    A null or empty text is the end token alone; null ids stay null; repeated rows are packed each; other columns are left out.
    """
    return pack(token_pieces(docs, path, end_id, config.capacity, id_col, text_col), config)
