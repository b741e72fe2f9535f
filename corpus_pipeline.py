"""A training corpus from `documents`: quality, line dedup, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of `documents`.  A text that changes gets a new n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import line_dedup, packing, pii, quality_fm, simhash
from kinfold.llm.common import ident_of, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    kind = dict(df.dtypes)["n_chars"]
    return df.select(*COLUMNS[:-1], F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind).alias("n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores under the threshold go; it learns from the labelled ones among `docs`."""
    model = quality_fm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_fm.score(docs.select(*COLUMNS), model, COLUMNS[1:]).filter(F.col("score") >= quality_fm.THRESHOLD).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, or are within one edit of it, go; every document stays."""
    return _documents(line_dedup.line_dedup(docs.select(*COLUMNS)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (0.8 or more of five-word shingles) stays, the one with the smallest doc_id.

    Of rows that agree in doc_id and text one stays.  Rows that share a doc_id, or have none, but not the text are documents
    of their own.
    """
    own = materialize(simhash.similar_texts(docs).filter("kept").groupBy("ident").agg(F.count("*").alias("n")))
    rows = docs.select(*COLUMNS, ident_of(docs).alias("ident"))
    out = rows.join(own.filter("n = 1"), "ident", "left_semi").select(*COLUMNS)
    twice = own.filter("n > 1")
    return out if twice.isEmpty() else out.unionByName(rows.join(twice, "ident", "left_semi").dropDuplicates(["ident"]).select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by its kind."""
    rows = docs.select(*COLUMNS)
    return _documents(pii.redact(rows, pii.fit(rows)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: the rows of packing.pack_documents."""
    return packing.pack_documents(docs)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_duplicates), ("pii", personal_data), ("packing", pack)]

#: Hashing, model fits and tokenization have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
