"""The corpus pipeline: documents in, token ids of the documents that are worth training on out.

Each stage reads all that the one before kept, written as Parquet.  A stage
keeps the columns doc_id, text, lang, source and n_chars of the documents it
keeps; the last returns their tokens.  Every stage has the session read and
write Parquet in small runs (``in_small_runs``), since each passes whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontamination, jaccard_join, quality_classifier, quality_rules, sentencepiece_sampling
from lodestar.llm.common import crc_mod, in_small_runs, shared_dir, stored, table
from lodestar.llm.contracts import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with _key, 128 bits that tell rows apart whatever their doc_id is: alike for rows of one doc_id and text only."""
    part = lambda c: F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-"))
    return docs.withColumn("_key", F.unhex(F.md5(F.concat(part("doc_id"), F.lit(":"), part("text")).cast("binary"))))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule; null and empty texts fail, repeated rows and rows without a doc_id are judged each."""
    in_small_runs(spark)
    return quality_rules.judged(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more.

    The network learns from the labelled documents of the folder, since the
    rules leave those of one label only.  Each row is scored, repeated ones
    and those without a doc_id too; a null or empty text has the score of no
    words.
    """
    in_small_runs(spark)
    model = quality_classifier.fitted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    return quality_classifier.kept(docs.select(*COLUMNS), *model, least=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 5-word shingles link with a similarity of 0.8 or more: the one with the smallest doc_id.

    Rows take part each with its own text, whether they share a doc_id or have
    none (these come after all others).  Of rows alike in doc_id and text one
    stays.  Texts without words link with nothing.
    """
    in_small_runs(spark)
    docs = _keyed(docs.select(*COLUMNS))
    found = jaccard_join.jaccard_components(docs.select(F.col("_key").alias("doc_id"), "text"), n=5, percent=80).select(F.col("doc_id").alias("_key"), "component_id")
    found = found.distinct().join(docs.select("_key", "doc_id"), "_key").withColumn("rank", F.struct(F.col("doc_id").isNull(), "doc_id", "_key"))
    found = stored(found.select("_key", "component_id", "rank"), "pipeline-components")
    best = stored(found.groupBy("component_id").agg(F.min("rank").alias("best")), "pipeline-best")  # stored, so that Spark may split a large component in the join
    gone = found.join(best, "component_id").where("_key != best._key").select("_key").distinct()
    out = docs.join(gone, "_key", "left_anti")
    again = found.groupBy("_key").agg(F.count("*").alias("rows")).where("rows > 1").select("_key")
    once = out.join(again, "_key", "left_anti").unionByName(out.join(again, "_key", "left_semi").dropDuplicates(["_key"]))
    return once.select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; each row is tried, also those that share a doc_id or have none, and texts without words hold nothing."""
    in_small_runs(spark)
    docs = _keyed(docs.select(*COLUMNS))
    found = decontamination.contaminated(docs.select(F.col("_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return docs.join(found.select(F.col("doc_id").alias("_key")).distinct(), "_key", "left_anti").select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of each document: doc_id, n_tokens, ids, lossless; a null or empty text has no ids, and rows alike in doc_id and text are drawn alike."""
    in_small_runs(spark)
    return sentencepiece_sampling.encoded(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("ngram_jaccard_join", near_duplicates), ("decontamination", decontaminated), ("sentencepiece", encoded)]

#: Trained scores and drawn segmentations have no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
