"""From raw documents to packed training sequences: five stages over the operators of `seqdrift.llm`.

Rows keep all their columns until packing. What each stage decides:

* language: rows whose text no learned language accepts go (null texts and texts without a letter among them).
* near_dedup: of each group of near duplicates the document with the smallest id stays; rows without an id stay.
* decontaminate: documents in which a benchmark window occurs go.
* secrets: what a scan finds is masked in the text, and n_chars follows.
* pack: what is left becomes sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqdrift.llm import decontaminate, language, neardup, packing, secrets
from seqdrift.llm.base import documents, shipped, written
from seqdrift.llm.queries import tokenizer_path


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shipped(spark)
    return language.keep_accepted(docs, language.fit(language.training_rows(docs)))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shipped(spark)
    ids = neardup.near_duplicates(docs).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    ids = written(ids.where("not kept or n > 1"), "odd-ids")
    # texts of documents that stay are not dealt out
    kept = neardup.without(docs, ids.where("not kept").select("doc_id"))
    repeated = written(ids.where("kept and n > 1").select("doc_id"), "repeated-ids")
    if repeated.isEmpty():
        return kept
    once = neardup.perhaps(kept, repeated).join(repeated, "doc_id").dropDuplicates(["doc_id", "text"])
    return neardup.without(kept, repeated).unionByName(once.select(*docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shipped(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shipped(spark)
    out = secrets.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), "n_chars").cast(docs.schema["n_chars"].dataType))
    return out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shipped(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language", keep_languages),
    ("near_dedup", keep_one_of_each_group),
    ("decontaminate", drop_contaminated),
    ("secrets", mask_secrets),
    ("pack", pack),
]
# a tokenizer and trained language centroids have no SQL; tests/llm compares with a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each one written before the next reads it."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
