"""Ids, packing, token files and merges against the libraries."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanledger.llm import byte_bpe as B
from spanledger.llm import packing as K
from spanledger.llm import token_files as T
from spanledger.llm.arrays import texts_of
from spanledger.llm.pretokens import library_encoder, read_ranks

from brute import DOC, rows

LETTERS = [*"ab'sstreevellmd '' ''  \n\n\t12½é.,!Σİǅ̈中　\xa0\x85\x1c", "'s", "'re", "'ll", " "]


def odd_texts(n=1500):
    rng = random.Random(3)
    out = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    out += ["".join(rng.choice("abc") for _ in range(rng.randint(0, 200))) for _ in range(n // 3)]
    return [*out, "a" * 5000, "<|endoftext|>", "", " ", "\n", "'", "x '"]


def library(name):
    tok = Tokenizer.from_file(P.path(name))
    tok.encode_special_tokens = True
    return lambda texts: [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def ranks_encoding():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})


@pytest.mark.parametrize(("name", "lower"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_ids_equal_the_library(name, lower):
    texts = odd_texts()
    ids, at = library_encoder(P.path(name), lower).ids(texts_of(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == library(name)(texts)


def test_merges_equal_the_library():
    texts = odd_texts()
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ids, at = B._encoder(path).ids(texts_of(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == ranks_encoding().encode_ordinary_batch(texts, num_threads=1)
    assert B.bytes_of(ids, at, path).to_pylist() == [t.encode() for t in texts]


def test_small_store_gives_the_same():
    from spanledger.llm.pretokens import Encoder

    path, texts = P.path("byte_bpe_multi_50k.tiktoken"), texts_of(pa.array(odd_texts(200)))
    small = Encoder(B._encoder(path).encode, join_space=True, capacity=5)
    for _ in range(2):
        assert all(np.array_equal(a, b) for a, b in zip(small.ids(texts), B._encoder(path).ids(texts)))


DOCS = [(None, "no key", None, None, 1), (7, None, "en", "s", 0), (7, None, "en", "s", 0), (5, "", "", "", 0), (3, "word " * 4000, "fr", "s", 9), (9, "tie", "en", "s", 3), (9, "tie", "en", "s", 3)]


def test_encode_edges(sp):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    docs = sp.createDataFrame(DOCS, DOC).withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    got = sorted((r.doc_id or -1, tuple(r.ids), bytes(r.decoded)) for r in B.encode_bytes(docs, path, decoded=True).collect())
    want = sorted((d or -1, tuple(ranks_encoding().encode_ordinary(t or "")), (t or "").encode()) for d, t, *_ in DOCS)
    assert got == want
    again = B.decode_bytes(B.encode_bytes(docs, path), path).collect()
    assert sorted(bytes(r.decoded) for r in again) == sorted(w[2] for w in want)
    nulls = B.decode_bytes(sp.createDataFrame([(1, None), (2, [])], "k int, ids array<int>"), path).orderBy("k").collect()
    assert nulls[0].decoded is None and bytes(nulls[1].decoded) == b""
    assert B.encode_bytes(docs.limit(0), path).count() == 0


def test_packing(sp):
    path, encode = P.path("byte_bpe_50k.json"), library("byte_bpe_50k.json")
    docs = sp.createDataFrame(DOCS + rows([f"word{i} " * (i * 7 % 900) for i in range(300)]), DOC).repartition(9).withColumn("sequence_id", F.lit("x"))
    got = K.best_fit_packing(K.token_pieces(docs, path, 0, keep_ids=True), fan_in=3).collect()
    want = []
    for d, t in docs.select("doc_id", "text").collect():
        ids = [*encode([t or ""])[0], 0]
        first = len(ids) % 2048 or 2048
        edges = [0, *range(first, len(ids) + 1, 2048)]
        want += [(d or -1, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), tuple(ids[a:b])) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:]))]
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == sorted(want)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in seqs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(seqs) <= -(-total // 2048) * 1.05 + 1


def test_packing_edges(sp):
    items = sp.createDataFrame([], "length long, offset string")
    assert K.best_fit_packing(items).count() == 0
    same = K.best_fit_packing(sp.createDataFrame([(1024,)] * 10, "length long")).groupBy("sequence_id").count().collect()
    assert [r["count"] for r in same] == [2] * 5
    for bad in (0, 2049, None):
        with pytest.raises(Exception, match="length outside"):
            K.best_fit_packing(sp.createDataFrame([(bad,)], "length long")).count()


def test_token_files(sp, tmp_path):
    path, encode = P.path("word_bpe_49k.json"), library("word_bpe_49k.json")
    texts = [f"Word{i} Éa " * (i * 11 % 700) for i in range(200)]
    docs = sp.createDataFrame(DOCS[1:] + rows(texts)[10:], DOC).repartition(5).withColumn("start", F.lit("clash"))
    sp.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files of a small table
    try:
        files = T.write_token_files(docs, str(tmp_path / "ids"), path, 1, length=64)
    finally:
        sp.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files.count() > 1
    got = T.read_token_files(sp, files).orderBy("start").collect()
    want, at = [], 0
    stream = []
    for d, t in sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())):
        ids = [*encode([t])[0], 1]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
        stream += ids
    assert [tuple(r) for r in got] == want
    for f in files.collect():  # any sequence by its number
        reader, batch_rows = T.open_sequences(f.file)
        for row in (0, (f.tokens - 1) // 64):
            ids, mask = T.sequence(reader, batch_rows, row)
            assert len(ids) == len(mask) == 64
            a = f.start + row * 64
            own = stream[a:min(a + 64, f.start + f.tokens)]
            assert ids[mask].tolist() == own
    assert T.read_token_files(sp, T.write_token_files(docs.limit(0), str(tmp_path / "none"), path, 1)).count() == 0
