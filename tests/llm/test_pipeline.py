"""The pipeline's stages and their chain, and the cache that lasts."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from dqspark.llm.queries import QUERIES, TOKENIZER
from dqspark.llm.tokens import read_cache, tokenizer_digest
from dqspark.session import lasting_path, scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _h long, _n int"


def words(rng, n):
    return " ".join("".join(rng.choice("aeioulnrstdm") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark):
    """Tables with a planted case for every stage."""
    rng = random.Random(9)
    texts = {i: words(rng, rng.randint(80, 160)) for i in range(60)}
    passages = [words(rng, n) for n in (51, 55, 60, 65, 70)]
    for k, p in enumerate(passages):
        for i in range(3 * k, 3 * k + 3):
            half = len(texts[i]) // 2
            texts[i] = f"{texts[i][:half]} {p} {texts[i][half:]}"
    item = words(rng, 14)
    texts[20] += " " + item
    texts[21] = texts[22]                                                  # a copy
    for i in range(30, 45):
        texts[i] += " vile rotten scum" * 6
    rows = [(i, t, "en", "s", len(t), "keep", 7, 8) for i, t in texts.items()]
    rows += [(100, None, None, None, None, "keep", 7, 8), (101, "", "en", "s", 0, "keep", 7, 8), (None, words(rng, 90), "en", "s", 1, "keep", 7, 8)]
    rows += [rows[50], rows[50]]
    path = scratch_path(spark, "pipeline-tables")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(30 <= i < 45), 1) for i in range(60)], "doc_id long, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, passages


def test_stages_one_after_the_other(spark, folder):
    path, passages = folder
    docs = P.table(spark, path, "documents")
    columns, kept = docs.columns, {}
    for name, stage in P.STAGES[:-1]:
        docs = P.written(stage(spark, docs, path), f"test-{name}")
        assert docs.columns == columns and {tuple(r) for r in docs.select("_id", "_h", "_n").collect()} == {("keep", 7, 8)}
        kept[name] = docs.collect()
    ids = {n: [r.doc_id for r in rows] for n, rows in kept.items()}
    assert not {*range(30, 45)} & {*ids["toxicity"]} and {*range(30), *range(45, 60), 100, 101, None} <= {*ids["toxicity"]}
    assert 21 in ids["simhash_near_dedup"] and 22 not in ids["simhash_near_dedup"] and ids["simhash_near_dedup"].count(50) == 1
    cut = " | ".join(r.text for r in kept["suffix_array_dedup"])
    assert sorted(ids["suffix_array_dedup"], key=str) == sorted(ids["simhash_near_dedup"], key=str)
    assert not any(p in cut for p in passages) and all(r.text is not None and (r.n_chars is None or r.n_chars == len(r.text) or r.doc_id is None)
                                                       for r in kept["suffix_array_dedup"])
    assert [i for i in ids["suffix_array_dedup"] if i not in ids["decontamination"]] == [20]
    packed = P.STAGES[-1][1](spark, docs, path)
    assert {r.doc_id for r in packed.collect()} == {*ids["decontamination"]}
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m")).where("n <> m or n > 2048").count() == 0


def test_op1_cuts_from_400_bytes_on_whatever_the_words(spark):
    """Shared passages of over 50 words: 399 bytes stay whole, 400 go whole."""
    rng = random.Random(4)
    short, long = words(rng, 90)[:398] + "s", words(rng, 90)[:399] + "s"
    assert min(len(short.split()), len(long.split())) > 50 and (len(short), len(long)) == (399, 400)
    texts = [f"{words(rng, 60)}{a}{p}{b}{words(rng, 60)}" for p in (short, long) for a, b in ("XY", "VW")]
    path = scratch_path(spark, "op1-bytes")
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op1_suffix_dedup"](spark, path).collect()}
    for i, t in enumerate(texts):
        kept = t.replace(long, "")
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].text) == (len(t), 400 * (i > 1), int(i > 1), kept)
        assert got[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_run_and_empty_tables(spark, folder):
    path, _ = folder
    assert P.run(spark, path).count() > 0
    empty = scratch_path(spark, "pipeline-empty")
    for name in ("documents", "labels", "benchmark"):
        P.table(spark, path, name).limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert P.run(spark, empty).collect() == []


def docs_of(spark, path):
    return P.table(spark, path, "documents").fillna({"text": ""})


def test_token_counts_are_kept_between_runs(spark, folder):
    path, _ = folder
    cache = lasting_path(spark, f"token-counts-{tokenizer_digest(TOKENIZER)[:16]}")
    QUERIES["op10_token_counts"](spark, path).collect()
    before = read_cache(spark, cache).count()
    assert before >= docs_of(spark, path).select("text").distinct().count() > 50
    more = scratch_path(spark, "more-documents")
    docs = P.table(spark, path, "documents")
    new = spark.createDataFrame([(900 + i, f"a new text {i}", "en", "s", 1, "k", 1, 1) for i in range(3)], SCHEMA)
    docs.unionByName(new).write.parquet(f"{more}/documents.parquet")
    got = QUERIES["op10_token_counts"](spark, more)
    assert got.count() == docs.count() + 3
    assert read_cache(spark, cache).count() == before + 3       # only the new texts were encoded
