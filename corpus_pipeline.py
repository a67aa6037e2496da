"""The pipeline over documents: five stages, each written as Parquet to the shared folder and read again by the next.

In every stage a null text counts as an empty one and stays null if it is not changed, texts of any length are taken whole,
a null doc_id is a value like others, rows that repeat stay or go together, and an empty table gives an empty table.
Columns beyond those of documents are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm import linededup, packing, secrets, simhash, toxicity
from hirelake.llm.common import shared_folder, table
from hirelake.llm.queries import tokenizer_file

#: Columns of the documents table, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# The forest, the fuzzy links and the tokens have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fitted model does not call toxic (score under 0.5; a tie at 0.5 goes). Without usable labels of
    both classes the share of toxic labels is every document's score."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return model.filtered(docs).select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document or line has; those of which no line with a word is left go,
    unless they had none before. Of equal lines the one of the least doc_id, text hash and line number stays."""
    done = linededup.drop_repeated_lines(docs.select(*COLUMNS))
    some = F.col("kept_text").rlike(r"[\p{L}\p{N}]")
    return done.filter((F.col("n_dropped") == 0) | some).select(
        "doc_id", F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text")).alias("text"), "lang", "source",
        F.when(F.col("n_dropped") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates: that of the least doc_id; rows that repeat it stay with it."""
    return simhash.one_of_each(docs).select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets blotted out; overlapping finds by one mark."""
    done = secrets.redacted(docs.select(*COLUMNS))
    return done.select("doc_id", "text", "lang", "source", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")).alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens; a document without text is the end token alone."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("near duplicates", without_near_duplicates),
    ("secrets", without_secrets),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
