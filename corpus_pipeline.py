"""Corpus preparation: five stages, from raw documents to packed training sequences.

Each stage takes the documents that the one before kept, and its decisions take effect. All but
the last return the columns of ``documents``; extra columns travel along, whatever their names.

Rows without text (null, empty, or no letters) are in no language and go in the first stage, so
an empty table gives an empty result. Rows with a null doc_id can't be named by later stages'
findings: of such rows with equal text one stays, and they pass decontamination unread. Rows
that repeat a doc_id with other text share its findings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, jaccard, langid, packing, pii
from lodestar.llm.common import materialise, sized
from lodestar.llm.queries import tokenizer_file

#: A text whose score is lower is in no language that was learned.
LEAST_SCORE = 0.15


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language (null and empty ones too); a missing lang is filled in."""
    model = langid.fit_profiles(docs)
    # under names of their own, so that no column is taken for what the operator adds
    own = {c: "text" if c == "text" else f"own_{k}" for k, c in enumerate(docs.columns)}
    named = langid.identify(docs.toDF(*own.values()), model).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return named.select(*[(F.coalesce(n, "lang_pred") if c == "lang" else F.col(n)).alias(c) for c, n in own.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each group of copies and near copies; of rows that repeat, one.

    Rows with a null doc_id are in no group; of those with equal text one stays.
    """
    groups = jaccard.near_duplicates(docs)
    kept = docs.join(sized(groups.filter(F.col("doc_id") != F.col("group_id")).select("doc_id").distinct()), "doc_id", "left_anti")
    # a doc_id that comes more than once: its rows alone are looked at for repeats
    again = sized(kept.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    once = kept.filter(F.col("doc_id").isNotNull()).join(again, "doc_id", "left_anti")
    unnamed = kept.filter(F.col("doc_id").isNull()).dropDuplicates(["text"])
    return once.unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])).unionByName(unnamed).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item; rows with a null doc_id stay."""
    leaks = decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(sized(leaks.select("doc_id").distinct()), "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts each span's kind in its place; n_chars follows. Null text stays null."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences; null text is empty, one piece."""
    return packing.pack_documents(docs, tokenizer_file())


STAGES = [
    ("language_id", language),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("best_fit_packing", packing_stage),
]

#: SQL doesn't express the stages; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = len(STAGES) - 1
    step = lambda df, k: STAGES[k][1](spark, df, sf_dir) if k == last else materialise(STAGES[k][1](spark, df, sf_dir), STAGES[k][0])
    return reduce(step, range(len(STAGES)), docs)
