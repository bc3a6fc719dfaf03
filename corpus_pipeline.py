"""The training-data pipeline: toxicity, near-duplicates, decontamination, secrets, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. A stage's result is written as Parquet and read again as the next one's docs; the table before it
is then deleted, so that one table stands between two stages.

Defined results: a null or empty text is not toxic, not a copy, not contaminated, has no secrets and no ids;
rows that repeat an id, or have none, are told apart, and of equal texts one row stays; further columns, whatever
their names, pass through all stages but the last; empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, neardup, runtime, secrets, toxicity

RANKS = "byte_bpe_multi_50k.tiktoken"
TOXIC = 0.3


def _names(docs: DataFrame) -> dict[str, str]:
    """Plain names for the columns, whatever their own are."""
    return {f"c{i}": c for i, c in enumerate(docs.columns)}


def _of(names: dict[str, str], column: str) -> str:
    return next(k for k, c in names.items() if c == column)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below TOXIC; all of them if no labels of both kinds could be learnt."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if model.constant is not None:
        return docs
    names = _names(docs)
    scored = toxicity.score(docs.toDF(*names), model, _of(names, "text"))
    return scored.where(F.col("score") < TOXIC).select(*[F.col(k).alias(c) for k, c in names.items()])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more."""
    return neardup.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item."""
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in their text replaced by a mask; n_chars follows the text."""
    out = secrets.redact(docs, secrets.train(secrets.labelled_samples(docs)))
    names = _names(out)
    text = _of(names, "text")

    def column(k: str, c: str):
        if c != "n_chars":
            return F.col(k)
        return F.coalesce(F.length(text).cast(docs.schema[c].dataType), F.col(k))

    return out.toDF(*names).select(*[column(k, c).alias(c) for k, c in names.items()])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the token ids of the text, their number, and digests of ids and decoded bytes."""
    out = bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, decoded_col="decoded", keep=["doc_id", "lang", "source"])
    return out.select("doc_id", "lang", "source", "ids", *bpe.digests(out))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("encoding", encode),
]

#: SQL expresses neither the trained models nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in their order over sf_dir's documents."""
    scratch = runtime.Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        scratch.drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
