"""The corpus pipeline: quality, near duplicates, decontamination, personal data, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every
stage's result as Parquet below the shared checkpoint folder and hands it to the next.
Stages work on the whole of what their predecessor kept.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import decontam, jaccard, pii, quality, spm
from strata.llm.text import boxed, same_columns
from strata.session import staged

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; empty ones are judged too."""
    return quality.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of rows linked by 5-word shingles: that with the smallest id.

    Rows are judged one by one, each by its own text, so rows that share an id stay or go
    apart; of equal rows one stays.  Rows without words, and rows without an id, have no
    duplicates and stay.
    """
    row = "__row"
    while row in docs.columns:
        row += "_"
    named = staged(docs.where("doc_id is not null").withColumn(row, F.monotonically_increasing_id()), "rows")
    found = jaccard.near_duplicates(named, row).join(named.select(row, "doc_id"), row)
    kept = found.groupBy("component_id").agg(F.min(F.struct("doc_id", row)).alias("first")).select(F.col(f"first.{row}").alias(row))
    return same_columns(named.join(kept, row, "left_semi"), docs).unionByName(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark windows."""
    slim, back = boxed(docs)
    found = decontam.contamination(slim, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return back(found.where("not contaminated"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, each personal span replaced by its kind in angle brackets; n_chars follows the text."""
    slim, back = boxed(docs)
    found = pii.personal_data(slim).withColumn("text", F.col("redacted"))
    if "n_chars" in docs.columns:
        at = f"c{[c for c in docs.columns if c != 'text'].index('n_chars')}"
        length = F.when(F.size("pii_spans") > 0, F.length("text").cast("long")).otherwise(F.col(f"__box.{at}"))
        found = found.withColumn("__box", F.col("__box").withField(at, length))
    return back(found)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with their number and the parity of the two libraries."""
    rows = spm.encode(docs.select("doc_id", "text"), spm.read_model(spark, TOKENIZER), keep_text=False)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "parity", "ids")


STAGES = [("quality", keep_good), ("near_duplicates", drop_near_duplicates), ("decontamination", decontaminate), ("personal_data", redact), ("encoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs


# The classifier and the tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None
