"""Documents to packed training sequences: toxicity, near duplicates, benchmark leaks, secrets, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylane.llm import decontaminate, packing, secrets, simhash, toxicity
from tallylane.llm.shared import materialise, new_folder

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Lists of documents to drop are broadcast up to this number of ids, and joined by shuffling beyond it.
BROADCAST = 1_000_000
#: Near duplicates: three-word fingerprints within 7 bits (either of two) find candidate pairs; those whose sets of five-word
#: shingles have a Jaccard similarity of 0.8 or more are near duplicates.
REACH, TRIES, WIDTH, LEAST = 7, 2, 5, 0.8


ROW = "__row"


def numbered(docs: DataFrame) -> DataFrame:
    """Rows with a number of their own: stages decide on rows, as a doc_id may repeat or be null.

    Files are read in the same order each time, so that a number means the same row in every pass; what does not come from files is kept first.
    """
    rows = docs.withColumn(ROW, F.monotonically_increasing_id())
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return materialise(rows)
    return rows


def without(docs: DataFrame, drop: DataFrame) -> DataFrame:
    """Rows of numbered documents whose number is not in `drop`, without it."""
    drop = materialise(drop.select(ROW).distinct())
    return docs.join(F.broadcast(drop) if drop.count() <= BROADCAST else drop, ROW, "left_anti").drop(ROW)


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5; the model is fitted on the labels that are not held out."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs, model, score="toxic_score_").where("toxic_score_ < 0.5").drop("toxic_score_")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, a row of smallest doc_id (null last)."""
    docs = numbered(docs)
    groups = simhash.near_duplicates(docs, ROW, reach=REACH, set_width=WIDTH, least=LEAST, tries=TRIES)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias("first")
    kept = groups.join(docs.select(ROW, "doc_id"), ROW).groupBy("component_id").agg(first).select(F.col(f"first.{ROW}").alias(ROW))
    return without(docs, docs.select(ROW).join(kept, ROW, "left_anti"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    docs = numbered(docs)
    return without(docs, decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ROW))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with `<kind>` in place of each secret; n_chars follows where a text changed."""
    found = secrets.scan_secrets(docs, spans="secret_spans_").withColumn("changed_", F.size("secret_spans_") > 0)
    hidden = secrets.redact(found, spans="secret_spans_")
    return hidden.withColumn("n_chars", F.when(F.col("changed_"), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 4096 tokens."""
    return packing.packed_sequences(docs, TOKENIZER)


STAGES = [("toxicity", keep_civil), ("near_duplicates", keep_one_of_each), ("decontamination", keep_clean), ("secrets", hide_secrets), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
