"""Corpus pipeline: documents through five operators, each stage written as Parquet and read again.

Every stage works on all that the one before kept, and all but the last return the columns of documents, whatever they are
called. A null or empty text is rejected by the first stage, as it has too few words; a null in another column is a
value like others, and a null doc_id comes first where ids are ordered. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.decontamination import decontaminate
from siltstone.llm.line_dedup import without_repeats
from siltstone.llm.near_dup import without_near_duplicates
from siltstone.llm.packing import pack, tokenized_pieces
from siltstone.llm.quality import kept_documents
from siltstone.llm.queries import vocabulary
from siltstone.llm.storage import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Rows that stand twice are judged alike."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return kept_documents(docs, trusted)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier one holds; n_chars, where there is such a column, follows the text.

    A document of which no word is left, as of a later copy, goes: it has nothing to train on. Rows that share id and text are one
    document that stands twice: both keep what it keeps.
    """
    # A word is what is not an ASCII blank.
    out = without_repeats(docs).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), "n_chars")) if "n_chars" in docs.columns else out


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the lowest doc_id. Of rows that share id and text one stays."""
    return without_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Rows that share a contaminated id and text go together; without items all stay."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in the training sequences; an empty document is its end id alone."""
    return pack(tokenized_pieces(docs, vocabulary("word_bpe_49k.json"), end_id=1))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dup", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Stages hash, tokenise and draw, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
