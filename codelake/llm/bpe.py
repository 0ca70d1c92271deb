"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The pre-tokens of a group of texts lie end to end in one linked list of positions. Each adjacent pair that may merge stands in the bucket of its
merge rank; a bitmap of 64-bit words in levels tells the lowest rank with a bucket by a find-first-set per level. Taking a bucket merges all its
positions that are still current (stale ones are skipped) and puts the new pairs into their buckets. Where a merged token may have to merge
again before the next place of the same rank, a long pre-token's places wait in a heap. So work is O(merges * log), and a pre-token of a megabyte
isn't quadratic.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkCache
from .common import map_arrow, text_groups

NO_RANK = np.int64(2**31 - 1)

#: Where one place a pre-token is merged at a time, pre-tokens with more places than this have theirs in a heap.
CROWDED = 32
_NONE = np.empty(0, np.int64)


class RankQueue:
    """Buckets of positions by rank below `size`; pop() gives the lowest rank that has a bucket."""

    def __init__(self, size: int):
        self._levels, n = [], max(size, 1)
        while True:
            n = (n + 63) // 64
            self._levels.append([0] * n)
            if n == 1:
                break
        self._buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        bucket = self._buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
            return
        self._buckets[rank] = [positions]
        for words in self._levels:
            i, bit = rank >> 6, 1 << (rank & 63)
            before = words[i]
            words[i] = before | bit
            if before:
                return  # the levels above have this bit already
            rank = i

    def pop(self) -> tuple[int, np.ndarray] | None:
        if not self._levels[-1][0]:
            return None
        rank = 0
        for words in reversed(self._levels):
            w = words[rank]
            rank = (rank << 6) | ((w & -w).bit_length() - 1)
        at = rank
        for words in self._levels:
            i = at >> 6
            words[i] &= ~(1 << (at & 63))
            if words[i]:
                break
            at = i
        found = self._buckets.pop(rank)
        return rank, found[0] if len(found) == 1 else np.concatenate(found)


def _distinct(at: np.ndarray) -> np.ndarray:
    at = np.sort(at)
    fresh = np.empty(len(at), bool)
    fresh[0] = True
    np.not_equal(at[1:], at[:-1], out=fresh[1:])
    return at if fresh.all() else at[fresh]


class MergeTable:
    """Which pairs of token ids merge, at which rank and into which id; plus the ids of single bytes and of whole tokens."""

    def __init__(self, tokens: dict[bytes, int], merges: dict[tuple[int, int], tuple[int, int]], whole: bool):
        """whole: a pre-token that is itself a token is that token, without merging."""
        self.tokens, self.whole = tokens, whole
        self.byte_ids = np.array([tokens.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.byte_ids < 0).any():
            raise ValueError("a byte-level vocabulary has a token for each of the 256 bytes")
        left, right = np.array(list(merges), np.int64).reshape(-1, 2).T
        key = left << 32 | right
        order = np.argsort(key)
        self._key = key[order]
        made = np.array(list(merges.values()), np.int64).reshape(-1, 2)[order]
        self._rank, self._made = made[:, 0], made[:, 1]
        self.n_ranks = int(self._rank.max()) + 1 if len(made) else 1
        # All places of a rank merge at once, unless the made token has a pair of that rank or a lower one: then one place a pre-token is taken.
        rank_of = {int(i): int(r) for r, i in made}
        self.turning = {t for (a, b), (r, _) in merges.items() for t in (a, b) if r <= rank_of.get(t, -1)}

    @classmethod
    def of_ranks(cls, tokens: dict[bytes, int]) -> MergeTable:
        """Tokens whose ids are their ranks: a pair merges at the rank of its joined bytes."""
        merges = {}
        for token, rank in tokens.items():
            for i in range(1, len(token)):
                a, b = tokens.get(token[:i]), tokens.get(token[i:])
                if a is not None and b is not None:
                    merges[a, b] = (rank, rank)
        return cls(tokens, merges, whole=True)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (NO_RANK: never) and made ids of pairs."""
        if not len(self._key):
            return np.full(len(left), NO_RANK), np.zeros(len(left), np.int64)
        key = left << 32 | right
        at = np.searchsorted(self._key, key)
        at[at == len(self._key)] = 0
        hit = self._key[at] == key
        return np.where(hit, self._rank[at], NO_RANK), self._made[at]

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece (not empty) as little-endian unsigned 32-bit integers."""
        if not pieces:
            return []
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lens)
        n = int(ends[-1])
        ids = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[ends - lens] = -1
        rank = np.full(n, NO_RANK)
        made = np.zeros(n, np.int64)
        alive = np.ones(n, bool)
        piece_of = np.repeat(np.arange(len(pieces)), lens) if self.turning else None
        queue = RankQueue(self.n_ranks)

        def put(at: np.ndarray) -> None:
            r, m = self.pairs(ids[at], ids[after[at]])
            rank[at], made[at] = r, m
            ok = r < NO_RANK
            if not ok.all():
                at, r = at[ok], r[ok]
            if not len(at):
                return
            if len(at) > 1:
                order = np.argsort(r, kind="stable")
                at, r = at[order], r[order]
                cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
                if len(cuts):
                    first = 0
                    for cut, of in zip([*cuts.tolist(), len(at)], r[[0, *cuts]].tolist(), strict=True):
                        queue.push(of, at[first:cut])
                        first = cut
                    return
            queue.push(int(r[0]), at)

        heaps: dict[int, list[int]] = {}

        def merge_first(r: int) -> None:
            """Merges the first place of a rank's heap that is current."""
            heap = heaps[r]
            while heap:
                p = heapq.heappop(heap)
                if rank[p] == r and alive[p]:
                    gone = after[p]
                    ids[p], alive[gone], rank[gone], rank[p] = made[p], False, NO_RANK, NO_RANK
                    nxt = after[p] = after[gone]
                    if nxt >= 0:
                        before[nxt] = p
                    new = [int(x) for x in (before[p], p) if x >= 0 and after[x] >= 0]
                    if new:
                        put(np.array(new))
                    break
            if heap:
                queue.push(r, _NONE)
            else:
                del heaps[r]

        put(np.flatnonzero(after >= 0))
        while (got := queue.pop()) is not None:
            r, at = got
            at = at[(rank[at] == r) & alive[at]]  # what is stale is skipped
            if r in heaps:
                for p in at.tolist():
                    heapq.heappush(heaps[r], p)
                merge_first(r)
                continue
            if not len(at):
                continue
            if len(at) > 1:
                at = _distinct(at)
                if int(made[at[0]]) not in self.turning:
                    # Of places that overlap (a run of one token), every second one from the left merges.
                    chained = np.empty(len(at), bool)
                    chained[0] = False
                    chained[1:] = after[at[:-1]] == at[1:]
                    if chained.any():
                        index = np.arange(len(at))
                        at = at[(index - np.maximum.accumulate(np.where(chained, 0, index))) % 2 == 0]
                else:
                    keep = np.empty(len(at), bool)
                    keep[0] = True
                    keep[1:] = piece_of[at[1:]] != piece_of[at[:-1]]
                    number = np.diff(np.append(np.flatnonzero(keep), len(at)))
                    if number.max() > CROWDED:
                        crowded = np.repeat(number > CROWDED, number)
                        heaps[r] = at[crowded].tolist()
                        at, keep = at[~crowded], keep[~crowded]
                    if not keep.all():
                        queue.push(r, at[~keep])
                    at = at[keep]
                    if r in heaps and not len(at):
                        merge_first(r)
                        continue
                    if r in heaps:
                        queue.push(r, _NONE)
            gone = after[at]
            ids[at] = made[at]
            alive[gone] = False
            rank[gone] = NO_RANK
            nxt = after[gone]
            after[at] = nxt
            has = nxt >= 0
            before[nxt[has]] = at[has]
            rank[at] = NO_RANK
            prv = before[at]
            new = np.concatenate([at[has], prv[prv >= 0]])
            if len(new) > 1:
                new = _distinct(new)
            if len(new):
                put(new)
        left = ids[alive].astype("<u4")
        count = np.add.reduceat(alive, ends - lens, dtype=np.int64)
        stop = (np.cumsum(count) * 4).tolist()
        data, out, start = left.tobytes(), [], 0
        for end in stop:
            out.append(data[start:end])
            start = end
        if self.whole:
            known = self.tokens
            for i, piece in enumerate(pieces):
                t = known.get(piece)
                if t is not None and len(out[i]) != 4:
                    out[i] = t.to_bytes(4, "little")
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    """A file of lines with a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def rank_table(path: str) -> MergeTable:
    """The merge table of a file of ranks."""
    return MergeTable.of_ranks(read_ranks(path))


def byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write for bytes: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def merge_file_table(path: str) -> MergeTable:
    """The merge table of a byte-level BPE vocabulary in a tokenizer's JSON file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters, vocab = byte_letters(), model["vocab"]
    tokens = {bytes(letters[c] for c in t): i for t, i in vocab.items() if all(c in letters for c in t)}
    merges = {}
    for rank, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
    return MergeTable(tokens, merges, whole=bool(model.get("ignore_merges")))


class TextEncoder:
    """Ids of whole texts: each match of the pattern is encoded by itself; chunks between spaces are remembered."""

    def __init__(self, table: MergeTable, pattern: str):
        import regex

        self._table, self._find = table, regex.compile(pattern).findall
        self._cache = ChunkCache(self._chunks)

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        found = list(map(self._find, chunks))
        pieces: dict[str, bytes] = dict.fromkeys(p for f in found for p in f)
        encoded = self._table.encode([p.encode("utf-8", "surrogatepass") for p in pieces])
        pieces = dict(zip(pieces, encoded, strict=True))
        return [pieces[f[0]] if len(f) == 1 else b"".join(map(pieces.__getitem__, f)) for f in found]

    def of(self, texts: list[str]) -> list[bytes]:
        return list(map(b"".join, self._cache.of(texts)))


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> TextEncoder:
    return TextEncoder(rank_table(path), pattern)


@lru_cache(maxsize=2)
def _decoder(path: str) -> list[bytes]:
    by_id = {i: t for t, i in read_ranks(path).items()}
    return [by_id.get(i, b"") for i in range(max(by_id, default=-1) + 1)]


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids): the token ids of each whole text as little-endian unsigned 32-bit integers.

    One row a document, in any order; repeated rows give repeated rows, other columns are left out. A null or empty text has no ids; a null id
    stays null. Ranks and pattern are the tokenizer's files' and are read on each worker from `path`, which every node must have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for batch, texts in text_groups(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encoder.of(texts), pa.binary())], names=["id", "ids"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = map_arrow(source, run, f"id {source.schema['id'].dataType.simpleString()}, ids binary")
    return out.select(F.col("id").alias(id_col), "ids")


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, ids_col, bytes): the bytes that the ids stand for, joined. Null ids decode to no bytes; an id outside the vocabulary to none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _decoder(path)
        known = len(tokens)
        for batch in batches:
            out = []
            for ids in batch.column(1):
                got = np.frombuffer(ids.as_py() or b"", "<u4")
                out.append(b"".join(map(tokens.__getitem__, (got if not len(got) or got.max() < known else got[got < known]).tolist())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["id", "ids", "bytes"])

    source = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    out = map_arrow(source, run, f"id {source.schema['id'].dataType.simpleString()}, ids binary, bytes binary")
    return out.select(F.col("id").alias(id_col), F.col("ids").alias(ids_col), "bytes")
