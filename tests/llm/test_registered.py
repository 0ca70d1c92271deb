"""The registered queries, with their own parameters, over the smallest tables: against their SQL, or the libraries and plain loops."""

import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest

from codelake.llm.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    return QUERIES[name](spark, SF).collect()


def test_all_are_registered():
    import __spark_entry__

    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = duck.sql(ORACLES[name]).df()
    columns, got = sorted(want.columns), QUERIES[name](spark, SF).toPandas()

    def rows(frame):
        frame = frame[columns].copy()
        for c in columns:
            if frame[c].dtype.kind in "iuf" or str(frame[c].dtype).startswith(("Int", "Float")):
                frame[c] = frame[c].astype("float64")
        return sorted(map(tuple, frame.astype(str).values.tolist()))

    assert sorted(got.columns) == columns and rows(got) == rows(want)


def test_scores_of_texts(spark, texts):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for i, t in texts.items()}
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    counts = Counter(w for i, ws in words.items() if not out[i] for w in [*ws, None])
    total, different = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in run(spark, "op3_lm_scoring")}
    assert set(got) == set(texts)
    for i, r in got.items():
        tokens = [*words[i], None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(tokens), sum(counts[w] > 0 for w in tokens), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (different + 1))) for w in tokens))
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_quality(spark, texts):
    got = {r.doc_id: r for r in run(spark, "op4_quality")}
    assert set(got) == set(texts)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(labels[i], r.predicted) for i, r in got.items() if r.held_out and i in labels]
    assert sum(a == b for a, b in held) >= 0.85 * len(held)


def test_neighbours(spark):
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.embedding is not None}
    got = defaultdict(list)
    for r in sorted(run(spark, "op5_ann"), key=lambda r: (r.query_id, r.rank)):
        assert r.score == pytest.approx(float(vectors[r.query_id] @ vectors[r.vec_id]), abs=1e-12) and r.rank == len(got[r.query_id]) + 1
        got[r.query_id].append(r.vec_id)
    assert set(got) == {i for i in vectors if i % 20 == 0}
    found = 0
    for q, ids in got.items():
        want = sorted((i for i in vectors if i != q), key=lambda i: (-float(vectors[q] @ vectors[i]), i))[:20]
        found += len(set(want) & set(ids))
        assert len(ids) == len(set(ids)) == min(20, len(vectors) - 1)
    assert found >= 0.9 * sum(map(len, got.values()))


def test_token_counts(spark, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: (len(t.encode()), len(library.encode(t))) for i, t in texts.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in run(spark, "op6_token_counts")} == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in run(spark, "op6_token_counts"))


def test_encoding(spark, texts):
    import hashlib

    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for r in run(spark, "op1_bpe"):
        ids = np.array(library.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(dict), defaultdict(list)
    for r in run(spark, "op10_packing"):
        assert r.piece not in pieces[r.doc_id]
        pieces[r.doc_id][r.piece] = (r.start, r.length, r.ids_crc32)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, t in texts.items():
        ids, at = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4"), 0
        for k in range(len(pieces[i])):
            start, length, crc = pieces[i][k]
            assert start == at and crc == zlib.crc32(ids[at : at + length].tobytes()) and (length == 1024 or k == 0)
            at += length
        assert at == len(ids) and (len(pieces[i]) == 1 or len(ids) > 1024)
    total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
        total += at
    assert len(sequences) <= 1.02 * -(-total // 1024) + 1
