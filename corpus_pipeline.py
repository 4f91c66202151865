"""The corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import bpe, decontaminate, language, neardup, repeats
from spanloom.llm.common import Scratch, text_key
from spanloom.session import ship

#: Language ID keeps a document from this score on: only texts without a language of their own are to go.
LEAST_SCORE = 0.3


def _row(docs: DataFrame) -> Column:
    """All columns as one, so that an operator's columns meet none of theirs, whatever their names."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def _language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no learned language: null or without letters, or with no language ahead of the others."""
    ship(spark)
    scored = language.identify(docs.select("text", _row(docs)), language.train(docs), keep=["row"])
    return scored.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later occurrences of windows of three lines; a document of which nothing is left goes. n_chars follows the text."""
    ship(spark)
    clean = repeats.remove_repeats(docs.select("doc_id", "text", _row(docs)), repeats.line_rule(), keep=["row"])
    left = clean.where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    new = {"text": F.col("text"), "n_chars": n_chars}
    return left.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one with the smallest id."""
    ship(spark)
    tables = Scratch(spark, "near-dedup")
    found = tables.table(neardup.near_duplicates(docs.select("doc_id", "text")).where("kept").select("doc_id", "text_key", "component"), "kept")
    # of rows that share the smallest id, whose texts differ, the one with the least hash; of equal rows any
    one = found.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("one")).select(F.col("one.doc_id").alias("kept_id"), F.col("one.text_key").alias("kept_key"))
    row = docs.select(_row(docs), F.col("doc_id").alias("id"), text_key("text").alias("key"))
    kept = row.join(one.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("kept_id")) & F.col("key").eqNullSafe(F.col("kept_key")))
    if found.groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count():
        kept = kept.groupBy("id", "key").agg(F.first("row").alias("row"))  # rows that repeat entirely
    return kept.select("row.*")


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    ship(spark)
    found = decontaminate.scan(docs.select("text", _row(docs)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["row"])
    return found.where(~F.col("contaminated")).select("row.*")


def _bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids: n_tokens, ids_sha256, decoded_sha256 and ids beside every column of theirs but the text. A column
    of theirs with one of these names gets `doc_` before it."""
    ship(spark)
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        found = bpe.encode_decode(docs.select("doc_id", "text", _row(docs.drop("text"))), f.read(), keep=["row"], with_ids=True)
    new = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    return found.select(*[F.col(f"row.`{c}`").alias(f"doc_{c}" if c in new else c) for c in docs.columns if c != "text"], *new)


STAGES = [
    ("language ID", _language_id),
    ("line dedup", _line_dedup),
    ("near dedup", _near_dedup),
    ("benchmark decontamination", _decontaminate),
    ("BPE", _bpe),
]

#: Language ID is learned statistics and the encoding is a tokenizer's: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of sf_dir."""
    tables = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = tables.table(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            tables.drop(f"stage{k - 1}")
    return docs
