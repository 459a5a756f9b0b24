import random
import zlib
from hashlib import sha256
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyframe.llm import duck_bpe, token_store
from tallyframe.llm.duck_bpe import Codec, Ranks, bpe_round_trip
from tallyframe.llm.queries import QUERIES
from tallyframe.llm.token_store import Encoder, pack, read_token_store, unpack, write_token_store

SF = "/root/testdata/sf0.001"
DEFINITION = Path(public_tokenizers.path("word_bpe_49k.json")).read_text()
ODD = [
    "", "a b　c", "x\x1cy z", "é ́a", "İstanbul ǅ Σ ΑΣ", "don't I'LL 's a1b22", "<|endoftext|> x<|startoftext|>y", "日本語 テスト",
    "😀👍🏽 a", "a\x00b", "ﬁ ½ ﻿q", "\x0b\x0c\x1f a", "=" * 300 + " " * 50, "a\r\n\n  \n x", "z" * 700,
]


@given(st.lists(st.sampled_from([0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1])))
def test_coding_round_trip(values):
    assert unpack(*pack(np.array(values, dtype=np.uint32)), len(values)).tolist() == values


def test_word_by_word_is_the_tokenizer():
    tokenizer, encoder = Tokenizer.from_str(DEFINITION), Encoder(DEFINITION)
    for _ in range(2):
        ids, sizes = encoder.encode(ODD, 1)
        want = [tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in ODD]
        assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]


@pytest.mark.parametrize("block", [1, 1 << 18])
def test_store_of_nulls_ties_and_repeated_rows(spark, table, monkeypatch, block):
    monkeypatch.setattr(token_store, "BLOCK_TOKENS", block)
    rows = [(5, "five 5"), (1, None), (3, "b"), (3, "a a a"), (3, "b"), (None, "none"), (2, ""), (4, "long " * 20000)]
    docs = table("doc_id long, text string, start string, ids string, shard int", *((i, t, "x", "y", 1) for i, t in rows))
    store = write_token_store(docs, DEFINITION)
    got = sorted(read_token_store(spark, store).collect(), key=lambda r: r.start)
    tokenizer = Tokenizer.from_str(DEFINITION)
    want = {t: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4").tobytes() for _, t in rows}
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 3, 3, 4, 5]
    assert sorted((r.doc_id or 0, bytes(r.ids)) for r in got) == sorted((i or 0, want[t]) for i, t in rows)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]


def test_empty_store(spark, table):
    store = write_token_store(table("doc_id long, text string", (1, "a")).where("false"), DEFINITION)
    assert read_token_store(spark, store).count() == 0


def test_registered_store_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op6_token_files"](spark, SF).collect()}
    tokenizer, start = Tokenizer.from_str(DEFINITION), 0
    for d in docs:
        ids = tokenizer.encode(d.text, add_special_tokens=False).ids + [1]
        r = got[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)


@pytest.fixture(scope="module")
def ranks():
    return Ranks.from_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def own(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})


@pytest.mark.parametrize("short", [0, 62])
def test_contraction_is_that_of_the_library(ranks, monkeypatch, short):
    monkeypatch.setattr(duck_bpe, "_SHORT", short)
    random.seed(5)
    texts = ODD + ["".join(random.choice("etaoinshé ab日") for _ in range(300)) for _ in range(60)]
    ids, sizes = Codec(ranks, public_tokenizers.PATTERN).encode(texts)
    want = [own(ranks).encode_ordinary(t) for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 10**6))
def test_any_merge_table(seed):
    """Vocabularies in which a contraction may make a pair of lower rank."""
    pick = random.Random(seed)
    extra = {bytes(pick.choice(b"ab") for _ in range(pick.randint(2, 5))) for _ in range(14)}
    tokens = list(extra)
    pick.shuffle(tokens)
    small = Ranks({bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(tokens)})
    texts = ["".join(pick.choice("ab") for _ in range(n)) for n in (1, 5, 30, 61, 64, 120)]
    plain = tiktoken.Encoding("small", pat_str=r"\p{L}+", mergeable_ranks=small.ranks, special_tokens={})
    ids, _ = Codec(small, r"\p{L}+").encode(texts)
    assert ids.tolist() == [i for t in texts for i in plain.encode_ordinary(t)]


def test_neighbours_are_not_joined(ranks):
    """A step joins the rows with the merges and with the best pairs, not with their neighbours too."""
    codec = Codec(ranks, public_tokenizers.PATTERN)
    pair = (int(ranks.byte_token[ord("a")]) << 32) + duck_bpe._NONE
    codec.sql.register("start", pa.table({"key": [0], "pair": [pair]}))
    ((_, plan),) = codec.sql.sql("EXPLAIN " + duck_bpe._CONTRACT_SHORT).fetchall()
    assert plan.upper().replace(" ", "_").count("HASH_JOIN") == 3


def test_ranks_with_gaps():
    wide = Ranks({bytes([b]): 3 * b + 7 for b in range(256)} | {b"ab": 5000, b"abc": 90000})
    codec = Codec(wide, r"\p{L}+")
    texts = ["abcab é", "", "cab"]
    ids, sizes = codec.encode(texts)
    assert ids.tolist()[:2] == [90000, 5000] and codec.decode(ids, sizes) == ["abcabé".encode(), b"", b"cab"]


def test_round_trip_of_rows(table, ranks):
    rows = [(1, "Hello world"), (1, "Hello world"), (None, None), (2, ""), (3, "x" * 3000 + " é")]
    docs = table("doc_id long, text string, ids int, decoded int", *((i, t, 1, 1) for i, t in rows))
    got = sorted((r.doc_id or 0, r.n_tokens, bytes(r.decoded)) for r in bpe_round_trip(docs, ranks, public_tokenizers.PATTERN).collect())
    assert got == sorted((i or 0, len(own(ranks).encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)
    assert bpe_round_trip(docs.where("false"), ranks, public_tokenizers.PATTERN).count() == 0


def test_registered_bpe_query(spark, ranks):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op8_byte_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = own(ranks).encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == sha256(texts[r.doc_id].encode()).hexdigest()
