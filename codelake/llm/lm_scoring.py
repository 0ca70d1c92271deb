"""Language-model scores by deleted interpolation.

The probability of a token after another is a mixture of maximum-likelihood estimates - of the pair, of the token, and a uniform one over the
vocabulary and one place for all unknown tokens - with weights of its own for each bucket of context frequency. The weights are learnt by
expectation-maximisation on a held-out slice of the training documents, whose counts are deleted from the estimates meanwhile.

Counts cover the whole corpus, but no table of them is gathered: blocks of documents send their distinct tokens and pairs, packed, to shards by
hash; shards add up and answer in the order of the question; blocks score their own documents, which wait for the answers in files of the shared
folder. Tokens and pairs are told apart by 64 bits of hash: of a billion different ones, two agree with a chance of about 3 %.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, delete_dir, from_packed_planes, map_arrow, mix64, new_dir, pack_keys, packed_planes, shard_count, shard_ends, ship, stage_table, text_groups, unpack_keys

#: Characters of a block of documents, buckets of context frequency (by its logarithm to base 2), steps of expectation-maximisation, and the
#: fraction of an octave by which events are told apart in it (so the events of a corpus of any size fill a table of bounded size).
BLOCK_CHARS, BUCKETS, EM_STEPS, OCTAVE = 6_000_000, 32, 30, 8

#: Tokens whose probabilities are held at a time.
SLICE = 500_000

_END = np.uint64(0x2545F4914F6CDD1D)
_PAIR, _WORD = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)
_BLOCKS = "block long, kind int, ids array<{id}>, lens array<int>, folds array<int>, word_all binary, pair_all binary, word_kept binary, pair_kept binary, totals array<long>"


@dataclass(frozen=True)
class Model:
    """tokens N and vocabulary V of the training documents, and the weights (pair, token, uniform) by bucket."""

    tokens: int
    vocabulary: int
    weights: np.ndarray


def bucket_of(counts: np.ndarray) -> np.ndarray:
    """0 for contexts that were never seen, then one bucket an octave."""
    return np.where(counts > 0, 1 + np.log2(np.maximum(counts, 1)).astype(np.int64), 0).clip(0, BUCKETS - 1)


def _shards(keys: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """Each shard that ascending keys ask, and the place of its keys."""
    start = 0
    for shard, end in enumerate(shard_ends(keys, shards)):
        if end > start:
            yield shard, slice(start, end)
        start = end


def _keys(words: np.ndarray) -> Iterator[np.ndarray]:
    """The keys of a block's tokens, then of its pairs. words has an end after each text; the first token of a text follows an end."""
    yield mix64(words ^ _WORD)
    before = np.empty_like(words)
    before[0], before[1:] = _END, words[:-1]  # each text but the first follows the end of another
    yield mix64(mix64(before ^ _PAIR) + words)


def _numbers(distinct: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How often each of the distinct keys, ascending, occurs among keys."""
    out = np.zeros(len(distinct), np.int64)
    seen, number = np.unique(keys, return_counts=True)
    out[np.searchsorted(distinct, seen)] = number
    return out


def counted_blocks(docs: DataFrame, fold: Column, id_col: str, text_col: str) -> DataFrame:
    """Blocks of documents with the corpus's counts of each of their tokens and pairs, and one row with the totals."""
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), fold.cast("int").alias("fold"))
    shards, heads = shard_count(source), new_dir(spark, "lm-heads")
    id_type = docs.schema[id_col].dataType.simpleString()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, task = WordHashes(), TaskContext.get()
        fs, folder = pafs.FileSystem.from_uri(heads)
        fs.create_dir(folder, recursive=True)
        block = task.partitionId() << 24
        for batch, texts in text_groups(batches, chars=BLOCK_CHARS):
            parts = []
            for t in texts:
                parts += [hashes.of(t), np.array([_END])]
            lens = np.array([len(p) + 1 for p in parts[::2]], np.int64)
            folds = np.array(batch.column(2).to_pylist(), np.int64)
            words = np.concatenate(parts)
            del parts
            distinct = np.unique(words)
            place = np.searchsorted(distinct, words).astype(np.int32)
            order = np.argsort(-np.bincount(place, minlength=len(distinct)), kind="stable")  # frequent words get small numbers, which compress
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            distinct, place = distinct[order], rank[place]
            head = pa.table({"ids": pa.array([batch.column(0).to_pylist()], pa.list_(batch.column(0).type)), "lens": [lens.astype(np.int32)], "folds": [folds.astype(np.int32)], "names": [distinct.tobytes()], "words": [packed_planes(place)]})
            # The file is whole when it has its name; a task that runs twice leaves the same one.
            temp = f"{folder}/.{block}.{task.taskAttemptId()}.tmp"
            with fs.open_output_stream(temp, compression=None) as out, pa.ipc.new_stream(out, head.schema) as stream:
                stream.write_table(head)
            fs.move(temp, f"{folder}/{block}.arrow")
            del place, head
            train, slice_ = np.repeat(folds != 0, lens), np.repeat(folds == 1, lens)
            keys, blocks, data = [], [], []
            for kind, all_keys in enumerate(_keys(words)):
                names = np.unique(all_keys)
                total, held = _numbers(names, all_keys[train]), _numbers(names, all_keys[slice_])
                for shard, at in _shards(names, shards):
                    keys.append(2 * shard + kind)
                    blocks.append(block)
                    data.append(pack_keys(names[at]) + packed_planes(np.concatenate([total[at], held[at]])))
            block += 1
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blocks, pa.int64()), pa.array(data, pa.binary())], names=["key", "block", "payload"])

    def add_up(table: pa.Table) -> pa.Table:
        key = table.column(0)[0].as_py()
        blocks, names, both = table.column(1).to_pylist(), [], []
        for payload in table.column(2):
            data = payload.as_py()
            own, end = unpack_keys(data)
            names.append(own)
            both.append(from_packed_planes(data[end:], 2 * len(own)))
        lens = [len(n) for n in names]
        names = np.concatenate(names)
        total, held = (np.concatenate([b[k * c : (k + 1) * c] for b, c in zip(both, lens, strict=True)]) for k in (0, 1))
        distinct, place = np.unique(names, return_inverse=True)
        all_, slice_ = np.bincount(place, total).astype(np.int64), np.bincount(place, held).astype(np.int64)
        out, at = [], 0
        for c in lens:
            own = place[at : at + c]
            out.append(packed_planes(np.concatenate([all_[own], slice_[own]])))
            at += c
        if key % 2 == 0:  # tokens: what they add to the corpus's totals
            kept = all_ - slice_
            blocks.append(-1)
            out.append(np.array([all_.sum(), (all_ > 0).sum(), kept.sum(), (kept > 0).sum()], np.int64).tobytes())
        return pa.table({"key": pa.array([key] * len(out), pa.int64()), "block": pa.array(blocks, pa.int64()), "payload": pa.array(out, pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        block, empty = table.column(1)[0].as_py(), [None]
        if block < 0:
            totals = sum(np.frombuffer(p.as_py(), np.int64) for p in table.column(2))
            columns = {"block": [-1], "kind": [1], "ids": empty, "lens": empty, "folds": empty, "word_all": empty, "pair_all": empty, "word_kept": empty, "pair_kept": empty, "totals": [totals.tolist()]}
            return pa.table({k: pa.array(v, t) for (k, v), t in zip(columns.items(), types, strict=True)})
        rows = dict(zip(table.column(0).to_pylist(), (p.as_py() for p in table.column(2)), strict=True))
        fs, folder = pafs.FileSystem.from_uri(heads)
        with fs.open_input_stream(f"{folder}/{block}.arrow", compression=None) as stream:
            head = pa.ipc.open_stream(stream.read()).read_all().to_pylist()[0]
        lens, folds = np.array(head["lens"], np.int64), np.array(head["folds"], np.int64)
        names, place = np.frombuffer(head["names"], np.uint64), from_packed_planes(head["words"], int(lens.sum()))
        # What is left without the slice is asked for the slice's own documents only.
        held, found = np.repeat(folds == 1, lens), []
        words = names[place]
        del names, place
        for kind, all_keys in enumerate(_keys(words)):
            keys = np.unique(all_keys)
            of = np.searchsorted(keys, all_keys).astype(np.int32)
            all_, slice_ = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            for shard, at in _shards(keys, shards):
                size = at.stop - at.start
                got = from_packed_planes(rows.pop(2 * shard + kind), 2 * size)
                all_[at], slice_[at] = got[:size], got[size:]
            found.append((all_[of], (all_ - slice_)[of[held]]))
        (word_all, word_kept), (pair_all, pair_kept) = found
        columns = {"block": [block], "kind": [0], "ids": [head["ids"]], "lens": [head["lens"]], "folds": [head["folds"]], "word_all": [packed_planes(word_all)], "pair_all": [packed_planes(pair_all)], "word_kept": [packed_planes(word_kept)], "pair_kept": [packed_planes(pair_kept)], "totals": empty}
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(columns.items(), types, strict=True)})

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_id = to_arrow_type(source.schema["id"].dataType)
    types = (pa.int64(), pa.int32(), pa.list_(arrow_id), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.binary()] * 4, pa.list_(pa.int64()))
    schema = "key long, block long, payload binary"
    asked = map_arrow(source, ask, schema)
    summed = asked.groupBy("key").applyInArrow(add_up, schema)
    answered = summed.groupBy("block").applyInArrow(lambda t: answer(t.select(["key", "block", "payload"])), _BLOCKS.format(id=id_type))
    blocks = stage_table(answered, "lm-blocks")
    delete_dir(spark, heads)
    return blocks


def _contexts(counts: np.ndarray, end: int) -> np.ndarray:
    """The count of each token's context: that of the token before it, for the first of a text that of the end."""
    out = np.empty_like(counts)
    out[0], out[1:] = end, counts[:-1]
    return out


def expectation(events: np.ndarray, steps: int = EM_STEPS) -> np.ndarray:
    """Mixture weights by bucket from rows (bucket, pair / uniform, token / uniform, number), ratios of probabilities."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = 0, 0.5, 0.5
    bucket, number = events[:, 0].astype(int), events[:, 3]
    odds = np.column_stack([events[:, 1], events[:, 2], np.ones(len(events))])
    for _ in range(steps):
        share = weights[bucket] * odds
        share *= (number / share.sum(axis=1))[:, None]
        for k in range(3):
            weights[:, k] = np.bincount(bucket, share[:, k], minlength=BUCKETS) + 0.5  # half an event each, for buckets that saw none
        weights[0, 0] = 0
        weights /= weights.sum(axis=1, keepdims=True)
    return weights


def learn(blocks: DataFrame) -> Model:
    """Weights from the held-out slice's events; the driver gets the totals and a table of bounded size."""
    totals = blocks.where("kind = 1").select("totals").first()
    n, v, kept_n, kept_v = totals.totals if totals else (0, 0, 0, 0)

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lens = np.array(row["lens"])[np.array(row["folds"]) == 1]
                n = int(lens.sum())
                if not n:
                    continue
                word, pair = (from_packed_planes(row[k], n) for k in ("word_kept", "pair_kept"))
                context = _contexts(word, int(word[lens[0] - 1]))
                two = np.where(pair > 0, pair / np.maximum(context, 1), 0) * (kept_v + 1)
                one = word / max(kept_n, 1) * (kept_v + 1)
                cell = [np.where(x > 0, np.round(OCTAVE * np.log2(np.maximum(x, 1e-30))), -(10**6)).astype(np.int64) for x in (two, one)]
                cells, number = np.unique(np.column_stack([bucket_of(context), *cell]), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells[:, 0]), pa.array(cells[:, 1]), pa.array(cells[:, 2]), pa.array(number)], names=["bucket", "two", "one", "n"])

    rows = blocks.where("kind = 0").select("lens", "folds", "word_kept", "pair_kept")
    seen = map_arrow(rows, observe, "bucket long, two long, one long, n long").groupBy("bucket", "two", "one").agg(F.sum("n").alias("n"))
    events = np.array([tuple(r) for r in seen.orderBy("bucket", "two", "one").collect()], float).reshape(-1, 4)
    for k in (1, 2):
        events[:, k] = np.where(events[:, k] > -(10**6), 2.0 ** (events[:, k] / OCTAVE), 0)
    return Model(n, v, expectation(events))


def interpolated(model: Model, pair: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Probabilities of tokens, given the counts of the pair, of its context and of the token."""
    w = model.weights[bucket_of(context)]
    two = np.where(context > 0, pair / np.maximum(context, 1), 0)
    return w[:, 0] * two + w[:, 1] * word / max(model.tokens, 1) + w[:, 2] / (model.vocabulary + 1)


def lm_scores(docs: DataFrame, fold: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score): a row a document, scores in log10 of the text's probability.

    Documents of fold 0 are held out, those of fold 1 set the mixture's weights, and all but fold 0 are counted. Tokens are the words (A-Z
    lower-cased, runs of characters other than [\\x20\\x09-\\x0D]) and one end; a null or empty text has the end alone. base_score is that of
    the token counts with 0.1 added. Repeated rows count as often as they occur; other columns are left out.
    """
    blocks = counted_blocks(docs, fold, id_col, text_col)
    model = learn(blocks)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, lens, folds, word, pair in zip(*batch.columns, strict=True):
                lens = np.array(lens.as_py())
                word, pair = (from_packed_planes(x.as_py(), int(lens.sum())) for x in (word, pair))
                starts = np.cumsum(lens) - lens
                context = _contexts(word, int(word[lens[0] - 1]))
                score, base = np.empty(len(word)), np.empty(len(word))
                for at in range(0, len(word), SLICE):
                    part = slice(at, at + SLICE)
                    score[part] = np.log10(interpolated(model, pair[part], context[part], word[part]))
                    base[part] = np.log10((word[part] + 0.1) / (model.tokens + 0.1 * (model.vocabulary + 1)))
                score, base = np.add.reduceat(score, starts), np.add.reduceat(base, starts)
                known = np.add.reduceat((word > 0).astype(np.int64), starts)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(np.array(folds.as_py()) == 0), pa.array(lens, pa.int64()), pa.array(known), pa.array(base), pa.array(score)], names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    rows = blocks.where("kind = 0").select("ids", "lens", "folds", "word_all", "pair_all")
    out = map_arrow(rows, rate, f"id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
