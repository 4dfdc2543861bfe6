"""Records of sessions to documents: order-sensitive aggregates by session key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_said(value: Column, seq: Column) -> Column:
    """The first value that isn't null, in the order of ``seq``."""
    return F.min_by(value, F.when(value.isNotNull(), seq))


def transcript(role: str, text: str, *order: str) -> Column:
    """``role: text`` of the group's rows in order, with blank lines between."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.concat_ws(": ", role, text).alias("_line"))))
    return F.array_join(F.transform(rows, lambda r: r["_line"]), "\n\n")


def session_files(listing: DataFrame) -> DataFrame:
    """(session, mtime, size, files): a session is all its files."""
    return listing.groupBy("session").agg(F.max("mtime").alias("mtime"), F.sum("size").alias("size"),
        F.array_sort(F.collect_set("path")).alias("files"))


def messages(records: DataFrame) -> DataFrame:
    """What is said in a session: user and assistant records, no meta records, no tool results."""
    return records.where(~F.coalesce("is_meta", F.lit(False)) & F.col("type").isin("user", "assistant") & ~F.coalesce("has_tool_result",
        F.lit(False)))


def session_documents(records: DataFrame) -> DataFrame:
    """(session, cwd, git_branch, title, started, ended, sidechain, meta_records, text) of every session.

    ``records`` has session, seq, type, role, text, cwd, git_branch, title, timestamp, is_meta,
    is_sidechain, has_tool_result.
    """
    seq = F.col("seq")
    facts = records.groupBy("session").agg(
        first_said(F.col("cwd"), seq).alias("cwd"), first_said(F.col("git_branch"), seq).alias("git_branch"),
        first_said(F.col("title"), seq).alias("title"),
        F.min("timestamp").alias("started"), F.max("timestamp").alias("ended"),
        F.bool_or(F.coalesce("is_sidechain", F.lit(False))).alias("sidechain"), F.count_if(F.coalesce("is_meta", F.lit(False))).alias("meta_records"),
    )
    said = messages(records).where("text is not null and trim(text) <> ''").groupBy("session").agg(transcript("role", "text", "seq").alias("text"))
    return facts.join(said, "session", "left")
