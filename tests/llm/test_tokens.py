"""BPE encoding and decoding, token counts."""

import base64
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codelake.llm.bpe import MergeTable, RankQueue, TextEncoder, bpe_decode, bpe_encode, merge_file_table, rank_table
from codelake.llm.token_counts import TokenCounter, token_counts

RANKS, MERGES, PIECES = (P.path(n) for n in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_rank_queue_pops_in_order():
    queue, pushed = RankQueue(300_000), [299_999, 5, 70_000, 5, 64, 63, 4096]
    for r in pushed:
        queue.push(r, np.array([r]))
    out = []
    while (got := queue.pop()) is not None:
        out.append((got[0], len(got[1])))
    assert out == sorted(Counter(pushed).items())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_encoding_is_the_library_s(texts):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    got = TextEncoder(rank_table(RANKS), P.PATTERN).of(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode_ordinary(t) for t in texts]


def test_long_runs_and_turning_vocabularies(tiktoken_encoding):
    texts = ["a" * 3001, "ab" * 999, " " * 500 + "x", "\n" * 77, "é" * 200]
    got = TextEncoder(rank_table(RANKS), P.PATTERN).of(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tiktoken_encoding.encode_ordinary(t) for t in texts]
    # ab joins before cb, but joining b and c first would make a pair of a lower rank: one place at a time.
    vocabulary = {b"a": 0, b"b": 1, b"c": 2, b"abc": 3, b"bc": 4, b"aa": 5}
    vocabulary |= {bytes([b]): 100 + b for b in range(256) if bytes([b]) not in vocabulary}
    table, pieces = MergeTable.of_ranks(vocabulary), [b"abcabc", b"aaabc"]
    assert table.turning
    assert [np.frombuffer(x, "<u4").tolist() for x in table.encode(pieces)] == [naive(vocabulary, p) for p in pieces] == [[3, 3], [5, 3]]


def naive(vocabulary, piece):
    """The lowest-ranked pair merges first, the leftmost of equals, until none is left."""
    parts = [bytes([b]) for b in piece]
    while True:
        ranks = [vocabulary.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:], strict=False)]
        if not ranks or min(ranks) == 1 << 30:
            return [vocabulary[p] for p in parts]
        at = ranks.index(min(ranks))
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


def test_vocabularies_without_merges_or_bytes():
    alone = MergeTable.of_ranks({bytes([b]): b for b in range(256)})
    assert np.frombuffer(alone.encode([b"ab\xff"])[0], "<u4").tolist() == [97, 98, 255]
    with pytest.raises(ValueError, match="256 bytes"):
        MergeTable.of_ranks({b"a": 0, b"b": 1})


def test_a_text_of_megabytes(tiktoken_encoding):
    encoder = TextEncoder(rank_table(RANKS), P.PATTERN)
    words = "word Two, " * 150_000
    assert encoder.of([words])[0] == np.array(tiktoken_encoding.encode_ordinary(words), "<u4").tobytes()
    run = "ab" * 60_000  # one pre-token, too long for the library
    assert b"".join(tiktoken_encoding.decode_tokens_bytes(np.frombuffer(encoder.of([run])[0], "<u4").tolist())) == run.encode()


def test_merge_file(tiktoken_encoding):
    from tokenizers import Tokenizer

    texts = ["Hello  world", "don't 12 é", "", "aaaa" * 100]
    got = TextEncoder(merge_file_table(MERGES), P.PATTERN).of(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in Tokenizer.from_file(MERGES).encode_batch(texts, add_special_tokens=False)]


def test_round_trip_of_hard_documents(hard, hard_rows, tiktoken_encoding):
    out = bpe_decode(bpe_encode(hard, RANKS, P.PATTERN), RANKS).collect()
    want = [(r[0], tuple(tiktoken_encoding.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in hard_rows]
    got = [(r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), bytes(r.bytes)) for r in out]
    assert Counter(got) == Counter(want)


def test_op1_columns(spark, hard, nothing, tmp_path):
    from codelake.llm.queries import op1_bpe

    hard.write.parquet(str(tmp_path / "documents.parquet"))
    rows = op1_bpe(spark, str(tmp_path)).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows if r.doc_id in (4, 5)} == {(0, empty, empty)}
    assert bpe_encode(nothing, RANKS, P.PATTERN).count() == 0


def test_token_counts_are_the_library_s(hard, hard_rows, nothing):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = Counter((r[0], len((r[1] or "").encode()), len(library.encode(r[1] or ""))) for r in hard_rows)
    assert Counter(tuple(r) for r in token_counts(hard, PIECES).collect()) == want
    assert token_counts(nothing, PIECES).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab \n▁é<s>/日", max_size=20), max_size=6))
def test_counter(texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert TokenCounter(PIECES).of(texts) == [len(library.encode(t)) for t in texts]
