"""From raw documents to balanced training shards, stage by stage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navspark.llm.common import crc_fold, small, table
from navspark.llm.decontaminate import contaminated
from navspark.llm.jaccard import near_duplicates
from navspark.llm.langid import UNKNOWN, identify, learn
from navspark.llm.mixing import mixed
from navspark.llm.sharding import balanced_shards
from navspark.session import stage, staging_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which no language is recognised: null, empty or without a known letter.

    The model learns from the same rows as the query of operator 10.
    """
    del spark, sf_dir
    model = learn(docs.where(crc_fold(F.col("doc_id"), 4) != 2))
    return identify(docs.withColumn("_kept", F.struct(*docs.columns)), model).where(F.col("lang_pred") != UNKNOWN).select("_kept.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each component of near copies the document with the smallest id; of repeated rows of that id, one."""
    del spark, sf_dir
    found = stage(near_duplicates(docs).where("doc_id IS NOT NULL"), "classes")
    copies = small(found.where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    repeated = small(found.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    kept = docs.join(copies, "doc_id", "left_anti")
    once = kept.join(repeated, "doc_id", "left_anti")
    return once.unionByName(kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(*docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark."""
    found = small(contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that each source comes near its share of words."""
    del spark, sf_dir
    return mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every row of the mix: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    del spark, sf_dir
    return balanced_shards(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("leaks", leaks), ("mixture", mixture), ("shards", shards)]

#: Language identification and entropy balancing are fitted by iteration; tests compare the run with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{staging_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (name, step) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
