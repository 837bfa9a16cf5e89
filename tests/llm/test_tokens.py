"""Tokens against the libraries, and files against a round trip."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from caseflow.llm.bpe import decode_documents, encode_documents, tokenizer
from caseflow.llm.common import new_path
from caseflow.llm.merging import merge_long, merge_short
from caseflow.llm.piece_counts import count_tokens
from caseflow.llm.token_files import library_bpe, bits_of, pack, read_token_files, unpack, write_token_files
from pyspark.sql import functions as F

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", "'", "'s", "'ll", " ", "  ", "\n", "!", "é", "漢", "字", "\xa0", "　", "22", "<|endoftext|>", "😀", "ß", "\t", "\x1c", "\x85", "q", "z", "İ", "́", "​", "%%%", "\r\n", "\x00"]


def texts():
    random.seed(3)
    return ["".join(random.choices(PARTS, k=random.randint(0, 30))) for _ in range(800)] + ["", None, "x" * 3000, "漢字" * 2000, " " * 2000, "\n" * 300 + "a", "the same", "the same", "<|endoftext|>"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts())], "doc_id long, text string, n_tokens int")


def test_encoding_and_decoding(docs):
    library = Tokenizer.from_file(BPE)
    got = {r["doc_id"]: r for r in decode_documents(encode_documents(docs, BPE), BPE).collect()}
    both = {r["doc_id"]: r for r in encode_documents(docs, BPE, round_trip=True).collect()}
    for i, t in enumerate(texts()):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i]["token_ids"], "<u4").tolist() == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["decoded"] == both[i]["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_cuts_stand_only_where_no_token_spans_them():
    bpe = tokenizer(BPE)
    for token in bpe.ids:
        assert not any(bpe.cuts[a << 8 | b] for a, b in zip(token, token[1:], strict=False))


def test_both_ways_of_merging_agree():
    bpe = tokenizer(BPE)
    for word in (b" international", b"aaaaaaaaaaaaaaaa", b"=-=-=-=-=-", "ações".encode()):
        symbols = [bpe.single[b] for b in word]
        assert merge_short(list(symbols), bpe.rank, bpe.made) == merge_long(list(symbols), bpe.rank, bpe.made)


def test_counts(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in count_tokens(docs, PIECES, limit=20).collect():
        t = texts()[r["doc_id"]] or ""
        assert r["n_tokens"] == len(model.encode(t)) and r["n_bytes"] == len(t.encode()) and r["over_limit"] == (r["n_tokens"] > 20)


def test_null_ids_and_empty_tables(spark, docs):
    nameless = spark.createDataFrame([(None, "a"), (None, None)], "doc_id long, text string")
    assert sorted(r["n_tokens"] for r in encode_documents(nameless, BPE).collect()) == [0, 1]
    assert encode_documents(docs.limit(0), BPE).count() == 0 and count_tokens(docs.limit(0), PIECES).count() == 0


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 24, 32])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1003, dtype=np.uint64).astype(np.uint32)
    packed = pack(ids, bits)
    assert len(packed) == -(-1003 * bits // 8)
    for a, b in ((0, 1003), (13, 977), (1002, 1003), (5, 5)):
        assert (unpack(packed, bits, a, b) == ids[a:b]).all()
    assert bits_of(50_257) == 16 and bits_of(32_000) == 15 and bits_of(2) == 1


def test_files(spark, docs):
    out = new_path(spark, "token-files")
    write_token_files(docs.orderBy(F.rand(1)), BPE, out, partitions=5)
    got = read_token_files(spark, out).orderBy("start").collect()
    library, start = Tokenizer.from_file(BPE), 0
    assert [r["doc_id"] for r in got] == sorted(r["doc_id"] for r in got)
    for r in got:
        ids = [*library.encode(texts()[r["doc_id"]] or "", add_special_tokens=False).ids, 0]
        assert (r["start"], r["n_tokens"], np.frombuffer(r["token_ids"], "<u4").tolist()) == (start, len(ids), ids)
        start += len(ids)
    some = read_token_files(spark, out, F.col("part") == 2)
    assert 0 < some.count() < len(got)
    wanted = [r["doc_id"] for r in got[3:40:7]]
    assert sorted(map(tuple, read_token_files(spark, out, ids=[*wanted, -5]).collect())) == sorted(tuple(r) for r in got if r["doc_id"] in wanted)
    assert read_token_files(spark, out, ids=[]).count() == 0


def test_both_libraries_agree_on_fragments():
    bpe, library = library_bpe(BPE), Tokenizer.from_file(BPE)
    rng = np.random.default_rng(7)
    pool = [*"aeiou stn'.,!?\n\t 0123456789\u00e9\u00df\u4e2d\u0416\U0001f600\x00", "the", " ing", "  ", "'s", "'ll", "\u00a0"]
    for _ in range(3000):
        text = "".join(rng.choice(pool, rng.integers(1, 14)))
        assert bpe._ids(text) == library.encode(text, add_special_tokens=False).ids, text


def test_files_of_nothing_and_of_nameless_rows(spark, docs):
    out = new_path(spark, "token-files")
    write_token_files(docs.limit(0), BPE, out)
    assert read_token_files(spark, out).count() == 0
    out = new_path(spark, "token-files")
    write_token_files(spark.createDataFrame([(None, "a"), (1, "b"), (1, "b"), (1, "a")], "doc_id long, text string"), BPE, out)
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in read_token_files(spark, out).orderBy("start").collect()] == [(None, 0, 2), (1, 2, 2), (1, 4, 2), (1, 6, 2)]
