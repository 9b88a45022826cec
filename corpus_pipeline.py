"""A corpus pipeline over documents: toxicity, line dedup, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns of
documents. Between stages the rows are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeq.llm import base, lines, packing, secrets, simhash, toxicity


def _with_text(docs: DataFrame, text: Column) -> DataFrame:
    """n_chars is made anew; a null text has 0."""
    return docs.withColumn("text", text).withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; labels are learned from as in the operator."""
    model, score = toxicity.train(docs, base.table(spark, sf_dir, "labels")), base.new_name("score")
    return toxicity.score(docs, model, score_col=score).where(F.col(score) < toxicity.THRESHOLD).select(*_columns(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without long lines that many share; the last document of a line keeps it. Texts without lines to drop stay as they are."""
    found = lines.dedup_lines(docs, with_rest=True)
    text = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("text"))
    return _with_text(found.select("doc_id", text.alias("text"), "rest.*"), F.col("text")).select(*_columns(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the least id."""
    return simhash.first_documents(docs).select(*_columns(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced."""
    return _with_text(secrets.redact(docs), F.col("text")).select(*_columns(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False).drop("ids")


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = base.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Models and fingerprints are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None
