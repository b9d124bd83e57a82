"""A corpus cleaned and encoded in stages, each one of the operators of ``marginalia.llm``.

Every stage but the last returns the columns of ``documents``.  Each result is written to
the cluster's shared directory and read back, so a later stage or a lost task starts there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import bpe, decontaminate, line_dedup, ngram_join, toxicity
from marginalia.llm.queries import BYTE_BPE
from marginalia.llm.shared import forget, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned on the labelled among them, does not reject."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.with_scores(docs.select(*COLUMNS), model, "_score")
    return scored.where("_score < 0.5").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has; those that lose all their words go."""
    left = line_dedup.dedup(docs.select(*COLUMNS))
    gone = (F.col("n_removed") > 0) & (F.length(F.regexp_replace("text", r"[ \t\n\x0B\f\r]", "")) == 0)
    return left.where(~F.coalesce(gone, F.lit(False))).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies, those without doc_id last; documents without words are no copies."""
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))  # rows that share a doc_id or have none are judged apart
    found = ngram_join.components(keyed.select(F.col("_key").alias("doc_id"), "text")).where("n_shingles > 0")
    rows = keyed.select("doc_id", "_key").join(found.select(F.col("doc_id").alias("_key"), "component_id").distinct(), "_key")
    first = rows.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).alias("first"))
    others = rows.join(first, "component_id").where(F.col("_key") != F.col("first._key")).select("_key")
    left = keyed.join(others.distinct(), "_key", "left_anti")
    # rows equal in doc_id and text are copies too: one of them stays
    repeated = rows.groupBy("_key").count().where("count > 1").select("_key")
    one = left.join(repeated, "_key", "left_semi").groupBy("_key").agg(*(F.min(c).alias(c) for c in COLUMNS))
    return left.join(repeated, "_key", "left_anti").select(*COLUMNS).unionByName(one.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    keyed = docs.withColumn("_key", F.xxhash64("text"))  # what a row holds is a matter of its text
    found = decontaminate.find(keyed.select(F.col("_key").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return keyed.join(found.select(F.col("doc_id").alias("_key")).distinct(), "_key", "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the text decoded from them."""
    return bpe.digests(docs, BYTE_BPE)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]

#: Learned thresholds, edit neighbourhoods and BPE have no SQL; tests hold the stages against plain models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
            if before is not None:
                forget(before)
            before = docs
    return docs
