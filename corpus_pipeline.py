"""A corpus pipeline over ``documents``: quality classifier, quality rules, near-duplicates, packing.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet and read again as the next one's ``docs``.  All
but the last return the columns of ``docs``.  Stages that run Python keep the session's Arrow batches at 1,000 rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmine.llm import minhash, packing, quality_model, quality_rules, queries
from seqmine.llm.storage import small_batches, small_side, written


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on ``labels``, does not reject; null and empty texts are judged like others."""
    small_batches(spark)
    found = quality_model.classify(docs, queries.table(spark, sf_dir, "labels"))
    return found.where("kept").select(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; null and empty texts do not."""
    return quality_rules.judge(docs).where("kept").select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest key.

    Every row is compared, also one without a key; rows that share a key are told apart, so two texts under one key both stay unless they are alike.
    Such rows get numbers behind all keys, in no fixed order.
    """
    small_batches(spark)
    keys = docs.groupBy("doc_id").count()
    shared = written(keys.where("count > 1 and doc_id is not null").select("doc_id", F.lit(True).alias("_shared")), "shared")
    known = docs.agg(F.max("doc_id").alias("last"), F.count_if(F.col("doc_id").isNull()).alias("none")).first()
    rows = docs.withColumn("_row", F.col("doc_id"))
    if known.none or not shared.isEmpty():
        own = F.monotonically_increasing_id() + F.lit(max(0, (known.last or 0) + 1))
        single = F.col("doc_id").isNotNull() & F.col("_shared").isNull()
        rows = written(docs.join(small_side(shared), "doc_id", "left").withColumn("_row", F.when(single, F.col("doc_id")).otherwise(own)).drop("_shared"), "rows")
    gone = small_side(written(minhash.near_duplicates(rows, key="_row").where("not kept").select("_row"), "gone"))
    return rows.join(gone, "_row", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences; a null text is an empty one and still has its end mark.  Rows that share a key are packed one by one."""
    small_batches(spark)
    return queries.pieces(packing.pack(docs, keep_units=False))


STAGES = [("quality classifier", classified), ("quality rules", clean), ("near duplicates", distinct), ("packing", packed)]

#: SQL cannot train the classifier or encode text; each stage is tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the whole ``documents`` table."""
    docs = queries.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "stage-" + name.replace(" ", "-"))
    return docs
