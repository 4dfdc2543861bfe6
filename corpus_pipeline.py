"""From documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir) over all rows its predecessor kept, and all but the last
return the columns of docs.  ``run`` writes what each stage returns below the shared folder and reads it
back for the next one, so a lost executor costs tasks of one stage at most.

1. language: rows whose text has no letter, or in which no language reaches ``LEAST_SCORE``, go.
2. near_duplicates: of each group of near copies one row stays, the least identifier's; different texts of
   one identifier are in groups of their own.  Rows without an identifier stay.
3. secrets: every span that the scan finds is replaced by a mark in the text, and n_chars follows.
4. mixing: rows come as often as the mix takes them, the last copy of a source cut to the words taken.
5. packing: pieces of documents in sequences of 4096 tokens, with their ids.

Null texts and empty ones go in the first stage; an empty table passes through.  Further columns of docs
are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import language_id, mixing, ngram_join, packing, secret_scan
from corpusloom.workdir import materialize

#: Mean odds that the best language of a text must have.
LEAST_SCORE = 0.4
#: Verdicts on rows of groups that may be broadcast, of some 20 bytes each; beyond it rows are joined to them.
BROADCAST_ROWS = 1_000_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = language_id.learn(docs)
    columns = docs.columns
    # columns of these names may be the input's own
    named = docs.select(F.struct(*columns).alias("kept"), "text")
    good = language_id.predict(named, net).where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return good.select("kept.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    few = lambda frame: F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame
    linked = materialize(ngram_join.link(docs).where("group is not null").select("doc_id", "text_mark", "group"), "near-duplicates")
    # one row of each group of several stays: the least identifier's, and of its texts the one of least hash
    chosen = materialize(linked.groupBy("group").agg(F.min(F.struct("doc_id", "text_mark")).alias("least"), F.count("*").alias("n")).where("n > 1"), "near-duplicates")
    named = linked.join(few(chosen), "group").withColumn("stays", F.struct("doc_id", "text_mark") == F.col("least"))
    judged = materialize(named.groupBy("doc_id", "text_mark").agg(F.bool_or("stays").alias("stays"), F.count("*").alias("times")), "near-duplicates")
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64("text").alias("text_mark")).join(few(judged), ["doc_id", "text_mark"], "left")
    out = rows.where("stays is null or (stays and times = 1)").select("row.*")
    if judged.where("stays and times > 1").isEmpty():
        return out
    # rows that repeat both identifier and text are told apart by nothing
    return out.unionByName(rows.where("stays and times > 1").dropDuplicates(["doc_id", "text_mark"]).select("row.*"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.draw(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixed), ("packing", packed)]

#: Stages use trained weights, MinHash and byte-pair merges, which SQL can't express; tests hold each
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
