"""Benchmark decontamination: which words of which documents lie in a passage of a benchmark item.

A document must hold all shingles of an item's window to contain it, so any one of them is a sufficient prefix, and the rarest is the best one.
The documents are read twice. The first pass counts the benchmark's shingles in all of them; windows with a shingle that occurs nowhere leave.
The second sends on only the places of the shingles that windows chose, each with the few words around it. Which shingles these are is told by
bitmaps of fixed size; they may let others through, never stop one. Places and windows meet in a join on the shingle; the window's length and
the shingle's place in it bound where it can begin, and the words themselves are compared last, so hashes decide nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import PART, WordHashes, join_salted, map_arrow, ngram_hashes, stage_table, text_groups

#: Consecutive words of an item that make a window, and of a window that make a shingle.
WINDOW, SHINGLE = 10, 4

#: log2 of a bitmap's bits (8 MB), and of those of one of its rows.
BITS, ROW_BITS = 26, 15

#: Windows of an item, or places of a document, that are handled or stored in one row group.
CHUNK = 4096

#: Words are runs of a-z, A-Z (lower-cased), 0-9 and all that isn't ASCII.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def folded(text: str) -> bytes:
    """The text's words in UTF-8, lower-cased, with spaces between them."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD)


def word_hashes(raw: bytes, hashes: WordHashes) -> np.ndarray:
    """Hashes of the words of a folded text; only a part's words are objects at a time."""
    if len(raw) <= PART:
        return hashes._of(raw)
    parts, start = [], 0
    while start < len(raw):
        end = raw.find(b" ", start + PART) + 1 or len(raw)
        parts.append(hashes._of(raw[start:end]))
        start = end
    return np.concatenate(parts)


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item string, window string, size int, grams array<long>): a row for each window of each item, with the hashes of its shingles in order."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch, texts in text_groups(batches, rows=1):
            words = folded(texts[0]).split()
            size = min(window, len(words))
            if not size:
                continue
            shingle = min(SHINGLE, size)
            grams = ngram_hashes(hashes._of(b" ".join(words)), shingle).view(np.int64)
            for start in range(0, len(words) - size + 1, CHUNK):
                places = range(start, min(start + CHUNK, len(words) - size + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(batch.column(0).to_pylist() * len(places), pa.string()),
                        pa.array([b" ".join(words[i : i + size]).decode("utf-8", "surrogatepass") for i in places], pa.string()),
                        pa.array([size] * len(places), pa.int32()),
                        pa.array([grams[i : i + size - shingle + 1] for i in places], pa.list_(pa.int64())),
                    ],
                    names=["item", "window", "size", "grams"],
                )

    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return stage_table(map_arrow(rows, split, "item string, window string, size int, grams array<long>"), "windows")


def bitmap(grams: DataFrame) -> bytes:
    """A bitmap of fixed size with the places of grams(gram) set."""
    place = F.shiftrightunsigned("gram", 64 - BITS)
    bits = grams.select(F.shiftright(place, ROW_BITS).alias("row"), place.bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("bit"))
    bits = bits.groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros((1 << BITS - ROW_BITS, 1 << ROW_BITS - 3), np.uint8)
    for row in bits.toLocalIterator():
        out[row["row"]] = np.frombuffer(row["bits"], np.uint8)
    return out.tobytes()


class _Places:
    """Where the shingles of a bitmap occur in a group of texts."""

    def __init__(self, bits: bytes, shingles: list[int]):
        self._bits, self._shingles, self._hashes = np.frombuffer(bits, np.uint8), shingles, WordHashes()

    def of(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text, and the places (in all words of the group) and hashes of what the bitmap knows."""
        parts = [word_hashes(raw, self._hashes) for raw in raws]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        words = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(words))  # words from here to the text's end
        at, grams = [], []
        for shingle in self._shingles:
            found = ngram_hashes(words, shingle)
            place = (found >> np.uint64(64 - BITS)).view(np.int64)
            known = np.flatnonzero((self._bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool) & (left[: len(found)] >= shingle))
            at.append(known)
            grams.append(found[known])
        return sizes, np.concatenate([*at, np.empty(0, np.int64)]), np.concatenate([*grams, np.empty(0, np.uint64)])


def shingle_counts(docs: DataFrame, text_col: str, bits: bytes, shingles: list[int]) -> DataFrame:
    """(gram long, n long): how often each shingle that the bitmap knows occurs in all texts."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(shared.value, shingles)
        for _, texts in text_groups(batches):
            grams, n = np.unique(places.of([folded(t) for t in texts])[2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])

    counted = map_arrow(docs.select(F.col(text_col).cast("string").alias("text")), count, "gram long, n long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


_FOUND = "row long, id {id}, n_words long, part int, found array<struct<at:long,gram:long,before:string,after:string>>"


def shingle_places(docs: DataFrame, id_col: str, text_col: str, bits: bytes, shingles: list[int], window: int) -> DataFrame:
    """(row long, id, n_words long, part int, found): a row a document, more if it has many places; part numbers these from 0.

    found tells for each shingle that the bitmap knows where it is and which words are before and after it, as many as a window can hold.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    id_type = docs.schema[id_col].dataType.simpleString()
    ahead = max(window - min(SHINGLE, window), 0)

    def words(raw: bytes) -> str:
        return raw.decode("utf-8", "surrogatepass")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, number = _Places(shared.value, shingles), TaskContext.get().partitionId() << 40
        for batch, texts in text_groups(batches):
            raws = [folded(t) for t in texts]
            sizes, at, grams = places.of(raws)
            order = np.argsort(at, kind="stable")
            at, grams = at[order], grams[order].view(np.int64)
            ends = np.cumsum(sizes)
            bounds = np.searchsorted(at, ends).tolist()
            rows, of, parts, found, first = [], [], [], [], 0
            for i, (raw, last) in enumerate(zip(raws, bounds, strict=True)):
                got = []
                if last > first:
                    own = at[first:last] - (ends[i] - sizes[i])
                    letters = np.frombuffer(b" " + raw + b" ", np.uint8) != 32
                    edges = np.flatnonzero(letters[1:] != letters[:-1])
                    starts, stops = edges[::2], edges[1::2]
                    for p, g in zip(own.tolist(), grams[first:last].tolist(), strict=True):
                        a, b = max(p - ahead, 0), min(p + window, len(starts))
                        before = b" ".join(raw[starts[a] : starts[p]].split()) if p else b""
                        after = b" ".join(raw[starts[p] : stops[b - 1]].split())
                        got.append({"at": p, "gram": g, "before": words(b" " + before + b" " if before else b" "), "after": words(after + b" ")})
                for part in range(max(-(-len(got) // CHUNK), 1)):
                    rows.append(number)
                    of.append(i)
                    parts.append(part)
                    found.append(got[part * CHUNK : (part + 1) * CHUNK])
                number += 1
                first = last
            take = pa.array(of, pa.int32())
            kind = pa.list_(pa.struct([("at", pa.int64()), ("gram", pa.int64()), ("before", pa.string()), ("after", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), batch.column(0).take(take), pa.array(sizes).take(take), pa.array(parts, pa.int32()), pa.array(found, kind)],
                names=["row", "id", "n_words", "part", "found"],
            )

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return stage_table(map_arrow(source, find, _FOUND.format(id=id_type)), "places")


def chosen_windows(windows: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The windows by their rarest shingle, and the items of each class: (gram, place, size, head, tail, class) and (class, item).

    Windows of the same items are of one class; a class is told by the number of its items and two hashes of them. Windows with a shingle that
    occurs nowhere are left out.
    """
    held = stage_table(windows.select("window", "item").distinct(), "held")
    classes = held.groupBy("window").agg(F.concat_ws(":", F.count("item"), F.bit_xor(F.xxhash64("item")), F.bit_xor(F.xxhash64(F.lit(1), "item"))).alias("class"))
    classes = stage_table(classes, "classes")
    grams = windows.select("window", "size", F.posexplode("grams").alias("place", "gram")).distinct().join(counts, "gram", "left")
    best = grams.groupBy("window").agg(F.first("size").alias("size"), F.min(F.struct("n", "gram", "place")).alias("best"), F.count_if(F.col("n").isNull()).alias("missing"))
    best = best.where("missing = 0").join(classes, "window")
    words = F.split("window", " ")
    head = F.array_join(F.slice(words, F.lit(1), F.col("best.place")), " ")
    tail = F.array_join(F.slice(words, F.col("best.place") + 1, F.col("size")), " ")
    chosen = best.select("best.gram", "best.place", "size", F.when(F.col("best.place") > 0, F.concat(F.lit(" "), head, F.lit(" "))).otherwise(" ").alias("head"), F.concat(tail, F.lit(" ")).alias("tail"), "class")
    one = classes.groupBy("class").agg(F.min("window").alias("window"))
    return stage_table(chosen, "chosen"), one.join(held, "window").where("item is not null").select("class", "item")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id_col, n_words long, n_hit long, spans array<struct<start,end>>, items array<string>): a row for each row of docs.

    A-Z are lower-cased; words are runs of a-z, 0-9 and characters beyond ASCII. An item's windows are its runs of `window` consecutive words; one
    of fewer words, but not none, is one window. A word of a document is hit if it lies in any occurrence of a window. spans are the maximal runs
    of hit words, from the first word's number to that behind the last, n_hit their words, and items the ids (as strings, sorted) of all items
    with a window that occurs. Null texts have no words; rows with the same item id are one item; words of an item with a null id are hit, but it
    isn't listed. Null and repeated document ids and repeated rows are documents of their own. Other columns are left out.
    """
    windows = item_windows(items, item_col, item_text, window)
    shingles = sorted(r["k"] for r in windows.select(F.least(F.lit(SHINGLE), F.col("size")).alias("k")).distinct().collect())
    counts = stage_table(shingle_counts(docs, text_col, bitmap(windows.select(F.explode("grams").alias("gram"))), shingles), "counts")
    chosen, class_items = chosen_windows(windows, counts)
    places = shingle_places(docs, id_col, text_col, bitmap(chosen.select("gram")), shingles, window)

    found = places.select("row", "n_words", F.inline("found"))
    met = join_salted(found, chosen, "gram")
    fits = (F.col("place") <= F.col("at")) & (F.col("at") - F.col("place") + F.col("size") <= F.col("n_words"))
    met = met.where(fits & F.col("after").startswith(F.col("tail")) & F.col("before").endswith(F.col("head")))
    hits = stage_table(met.select("row", (F.col("at") - F.col("place")).alias("start"), "size", "class"), "hits")

    order = Window.partitionBy("row").orderBy("start", "end")
    spans = hits.select("row", "start", (F.col("start") + F.col("size")).alias("end"))
    far = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("fresh", (far.isNull() | (F.col("start") > far)).cast("long")).withColumn("span", F.sum("fresh").over(order))
    spans = spans.groupBy("row", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy("row").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))

    named = join_salted(hits.select("row", "class").distinct(), class_items, "class").select("row", "item").distinct()
    named = named.groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))

    out = places.where("part = 0").select("row", "id", "n_words").join(spans, "row", "left").join(named, "row", "left")
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")).alias("spans"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
    )
