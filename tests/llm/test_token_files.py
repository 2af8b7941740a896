"""Token files: round trip against the tokenizer library."""

import functools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from dqspark.llm.queries import QUERIES
from dqspark.llm.token_files import FileEncoder, TokenFiles, read_token_files, write_token_files
from dqspark.session import scratch_path

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture
def many_shards(spark):
    """As on large inputs: small partitions are not laid together."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@functools.cache
def reference(path):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def library(path, text):
    return reference(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_equals_library(path):
    from tokenizers import Tokenizer
    lib, enc = Tokenizer.from_file(path), FileEncoder(path)
    rng = random.Random(3)
    pieces = [" ", "  ", "\n", "\t", "\r\n", "\xa0", "　", "\x1c", "\x85", "᠎", "​", " ", "a", "Word", "'s", "'",
              "42", "\xe9", "日本", "!", "<|endoftext|>", "...", "\U0001f600", "x" * 60]
    for _ in range(1500):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(enc.ids(text), enc.dtype).tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)


def test_round_trip_in_id_order(spark, many_shards):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "cat", "naïve", "\n", "<|endoftext|>", "12"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    data = [(i * 7 % 61, t, "x", 1) for i, t in enumerate(texts)]
    data += [(None, "null id", "x", 1), (5, None, "x", 1), (5, "", "x", 1), (9, "tie a", "x", 1), (9, "tie b", "x", 1),
             (11, "same row", "x", 1), (11, "same row", "x", 1), (3, "long " * 20_000, "x", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, ids string, start long").repartition(5)
    path = scratch_path(spark, "files")
    write_token_files(docs, BYTES, path)
    got = read_token_files(spark, path, "bigint", with_ids=True).orderBy("ordinal").collect()
    assert [r.ordinal for r in got] == list(range(len(data)))
    assert [r.doc_id for r in got] == sorted((d[0] for d in data), key=lambda i: (i is not None, i))
    at, left = 0, [(d[0], library(BYTES, d[1]) + [0]) for d in data]
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        left.remove((r.doc_id, ids))
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert not left
    files = TokenFiles(path)
    assert (files.n_docs, files.n_ids) == (len(data), at)
    assert files.document(10).tolist() == np.frombuffer(got[10].ids, "<u4").tolist()
    whole = np.concatenate([np.frombuffer(r.ids, "<u4") for r in got])
    assert files.ids(0, at).tolist() == whole.tolist()
    assert files.ids(70, 600).tolist() == whole[70:600].tolist()
    assert len(spark.read.parquet(f"{path}/manifest").collect()) > 1  # several shards, so bases are used


def test_one_id_for_all_rows_is_parted(spark, many_shards):
    docs = spark.range(4000).selectExpr("1L AS doc_id", "'one text' AS text")
    path = scratch_path(spark, "files")
    shards = write_token_files(docs, BYTES, path).collect()
    assert len(shards) > 1 and max(s.n_docs for s in shards) < 3000
    assert read_token_files(spark, path, "bigint").selectExpr("sum(n_tokens)", "max(start)").first()[:] == (12000, 11997)


def test_empty_table(spark):
    path = scratch_path(spark, "files")
    assert write_token_files(spark.createDataFrame([], "doc_id long, text string"), BYTES, path).count() == 0
    assert read_token_files(spark, path, "bigint").count() == 0
    assert TokenFiles(path).n_ids == 0


def test_query_equals_library(spark):
    from tests.conftest import SF_SMALL
    got = {r.doc_id: r for r in QUERIES["op11_token_files"](spark, SF_SMALL).collect()}
    docs = sorted(spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect())
    at = 0
    assert len(got) == len(docs)
    for d in docs:
        ids = library(BYTES, d.text) + [0]
        r = got[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
