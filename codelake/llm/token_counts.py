"""Token counts by a map-side two-tier lookup, without shuffling a pre-token.

Tier one is a compact table of frequent pre-tokens and their lengths, broadcast and never changed; tier two is each worker's bounded cache, and
what it misses is encoded by the tokenizer's library, all misses of a group of texts at once. Which pre-tokens stand in the first tier decides the
speed alone: any pre-token has the same length wherever it is looked up.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkCache
from .common import map_arrow, text_groups

#: Pre-tokens in the broadcast table, the documents whose words are counted for it, and the longest one in bytes: at most some 5 MB.
TABLE_SIZE, TABLE_DOCUMENTS, TABLE_BYTES = 65_536, 4_096, 64

MARK = "▁"


class PieceCounter:
    """Lengths of texts in pieces of a sentencepiece model, by pre-token: a run of marks and what follows up to the next mark."""

    def __init__(self, path: str):
        import sentencepiece

        self._encode = sentencepiece.SentencePieceProcessor(model_file=path).encode
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(model.id_to_piece, range(model.get_piece_size()))
        inner = any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        # Counts add up over pre-tokens if no piece crosses from a character to a mark and white space is kept as it is.
        probe = " a  b "
        kept = model.encode(probe, out_type=str)
        self.additive = not inner and "".join(kept) == MARK + probe.replace(" ", MARK)

    def whole(self, texts: list[str]) -> list[int]:
        return list(map(len, self._encode(texts, num_threads=1))) if texts else []

    def chunks(self, chunks: list[str]) -> list[int]:
        """Lengths of pre-tokens as the cache asks for them: the first of a text, or a space and what follows, spaces at its end included."""
        out = self.whole([c[1:] if c.startswith(" ") else c for c in chunks])
        odd = [i for i, c in enumerate(chunks) if c[:1] == " " and (len(c) == 1 or c[1] == " ") and not c.strip(" ")]
        # Marks alone: the library adds one before a text, so they are counted behind a letter that no piece joins to a mark.
        for i, n in zip(odd, self.whole(["a" + chunks[i] for i in odd]), strict=True):
            out[i] = n - 1
        return out


_SEGMENT = re.compile(r"(?: +[^ ]*)|[^ ]+")


class TokenCounter:
    """Counts of whole texts; table: the first tier, " "-joined pre-tokens without their mark, and their lengths."""

    def __init__(self, path: str, table: tuple[bytes, bytes] | None = None):
        self._counter = PieceCounter(path)
        known = dict(zip(table[0].decode("utf-8").split(" "), np.frombuffer(table[1], "<u2").tolist(), strict=True)) if table and table[0] else None
        self._cache = ChunkCache(self._counter.chunks, known=known)
        self._blank = self._counter.chunks([" "])[0]

    def of(self, texts: list[str]) -> list[int]:
        if not self._counter.additive:
            return self._counter.whole(texts)
        plain, odd, out = [], [], [0] * len(texts)
        for i, t in enumerate(texts):
            if MARK in t:
                t = t.replace(MARK, " ")
            if t.startswith(" ") or t.endswith(" ") or "  " in t:
                odd.append((i, t))
            else:
                plain.append((i, t))
        for (i, _), lengths in zip(plain, self._cache.of([t for _, t in plain]), strict=True):
            out[i] = sum(lengths)
        # Runs of spaces belong to the word behind them; such texts are cut by a pattern. A single space at the end is a pre-token by itself.
        cut = [[s[1:] for s in _SEGMENT.findall(" " + t)] for _, t in odd]
        for (i, _), chunks, lengths in zip(odd, cut, self._cache.values([[c for c in chunks if c] for chunks in cut]), strict=True):
            out[i] = sum(lengths) + self._blank * (chunks[-1] == "")
        return out


@lru_cache(maxsize=2)
def _counter(path: str, words: bytes, lengths: bytes) -> TokenCounter:
    return TokenCounter(path, (words, lengths))


def frequent_table(docs: DataFrame, path: str, text_col: str = "text", size: int = TABLE_SIZE, documents: int = TABLE_DOCUMENTS) -> tuple[bytes, bytes]:
    """The frequent pre-tokens (joined by spaces) and their lengths (16-bit): of a sample of about `documents` texts, at most `size` of them.

    The sample is spread over the whole table. It is a matter of speed only and never of counts.
    """
    rows = docs.count()
    if not rows:
        return b"", b""
    sample = docs.select(F.col(text_col).cast("string").alias("text")).sample(fraction=min(1.0, documents / rows), seed=11)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for _, texts in text_groups(batches):
            for t in texts:
                seen.update(t.split(" "))
        top = [(w, n) for w, n in seen.most_common(size) if w and n > 1 and len(w.encode("utf-8", "surrogatepass")) <= TABLE_BYTES]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])

    top = map_arrow(sample, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    words = [r.word for r in top.select("word").collect() if MARK not in r.word]
    counts = PieceCounter(path).chunks([" " + w for w in words])
    words = [(w, n) for w, n in zip(words, counts, strict=True) if n < 65536]
    return " ".join(w for w, _ in words).encode("utf-8"), np.array([n for _, n in words], "<u2").tobytes()


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens): UTF-8 bytes and sentencepiece tokens of each whole text, without begin or end tokens.

    One row a document; repeated rows give repeated rows, null or empty texts count 0, a null id stays null, other columns are left out.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(frequent_table(docs, path, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, *table.value)
        for batch, texts in text_groups(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counter.of(texts), pa.int64())], names=["id", "n_bytes", "n_tokens"])

    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    out = map_arrow(source, run, f"id {source.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
