"""A training-data pipeline over ``documents``: five stages, each one of the library's operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs.  All but the last return the columns of ``documents``, extra
columns included.

Null ids, null texts and repeated rows pass every stage as the stage's docstring says; an empty
table stays empty.  The near-copies stage keeps one document of each class within operator 1's two
bits over three-word shingles.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from callboard.llm import decontaminate, langid, mixing, sharding, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity field, fitted on labelled rows, does not predict as toxic.  Each row
    is judged by its own text; a null text is empty and stays."""
    field = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~langid.held_out(4, 2))
    return toxicity.clean(docs, field)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class: the one with the smallest id.  All empty and null texts are
    one class; of equal rows one stays; rows without an id give way to those with one."""
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without enough benchmark windows to count as contaminated, each judged alone."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, null being one; documents repeat, or are cut, as the mix takes
    them.  Texts without words are never taken."""
    return mixing.mixture(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its slot and shard; repeats of one id share a shard."""
    return sharding.shard_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: SQL can't express the fitted field or the fingerprints; tests hold a brute-force version.
ORACLE_SQL = None


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it.  A local session without one has
    its warehouse; a cluster without one is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir")
    raise ValueError("spark.checkpoint.dir names no folder for the stages' tables")


def drop(spark: SparkSession, path: str) -> None:
    """Removes one stage's table once the next one is written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; the last one's
    table stays, as the result reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{at}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            drop(spark, before)
        before = path
    return docs
