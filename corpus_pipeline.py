"""The corpus pipeline: filter, deduplicate, decontaminate and pack documents.

Each stage takes all rows that the one before it kept and returns the columns
of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.llm.common import written
from dqspark.llm.decontaminate import without_contaminated
from dqspark.llm.packing import pack_best_two_fit
from dqspark.llm.queries import MAX_TOKENS, TOKENIZER
from dqspark.llm.repeats import remove_repeats
from dqspark.llm.simhash import keep_one_each
from dqspark.llm.toxicity import toxicity_scores
from dqspark.plans.catalog import table

#: Bytes of a passage that the corpus keeps nowhere if it recurs: passages of
#: over 50 words have 285 bytes and more.
REPEAT_BYTES = 250


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models score under 0.7 stay."""
    scores = toxicity_scores(docs, table(spark, sf_dir, "labels"), carry_row=True)
    return scores.filter(F.col("score") < 0.7).select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays."""
    return keep_one_each(docs, shingle=3, max_distance=2)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, without the bytes of passages that recur (a null
    text becomes empty)."""
    found = remove_repeats(docs, min_len=REPEAT_BYTES, keep_text=True)
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.col("_kept").alias(c))
        elif c == "n_chars":
            cols.append(F.when(F.col("n_removed") > 0, F.length("_kept").cast("long")).otherwise(F.col("_row")[c]).alias(c))
        else:
            cols.append(F.col("_row")[c].alias(c))
    return found.select(*cols)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a ten-word window of a benchmark item go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences."""
    return pack_best_two_fit(docs, TOKENIZER, MAX_TOKENS, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: Language models, fingerprints and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
