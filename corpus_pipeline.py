"""A corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing to target weights, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each stage's result as Parquet in the shared folder and reads it again as the
next one's docs.  All but the last return the columns of documents, under their
names, also where those are the ones that operators use inside.

A null or empty text has no words, so the quality rules reject it; a null
doc_id is a value like another, except that the near-duplicate stage keeps all
rows without one; rows that repeat doc_id and text are judged alike, count as
one document for line dedup, and one of them stays in the near-duplicate stage,
while different texts under one doc_id are documents of their own; of ties (the
same line run, the same set) the row with the least doc_id, then with the least
hash, stays.  Texts of any length are handled whole.  Empty tables pass through
every stage.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm import bpe, jaccard_join, line_dedup, mixing, quality
from quadrat.llm.common import drop_tables, owned, read_documents, shared_dir
from quadrat.llm.queries import tokenizer_path


OWNER = "pipeline"


def _stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage before has been stored, so its intermediates go; other results of the session keep theirs."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_tables(spark, OWNER)
        with owned(OWNER):
            return function(spark, docs, sf_dir)

    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs)


@_stage
def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go; n_chars follows, and a document without words left goes unless it had none before."""
    rows = line_dedup.dedup_lines(docs).where(F.col("text").rlike(r"[^\x20\x09-\x0D]") | (F.col("n_gone") == 0))
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"row.{c}").alias(c) for c in docs.columns])


@_stage
def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more."""
    return jaccard_join.keep_one(docs, k=5, num=80)


@_stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights; documents are repeated or left out accordingly."""
    return mixing.mix(docs)


@_stage
def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digests of ids and decoded text."""
    return bpe.encode_documents(docs, tokenizer_path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("n-gram jaccard join", jaccard_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: The stages fit a model, order by hashes and run a tokenizer, which SQL can't state; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    drop_tables(spark, OWNER)
    return docs
