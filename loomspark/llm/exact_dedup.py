"""Exact deduplication by 128-bit content hash, checked byte by byte.

Rows are grouped by the MD5 of the text and, inside a hash, by the text itself:
grouping by a string compares bytes, so texts that only share the hash end in
different classes.  The grouping is partially aggregated before its shuffle, so
a class with millions of copies sends one row per task.  Members then find their
class over a narrow join (two digests, no text), which adaptive execution may
split when one class is hot.

Cases: a null text counts as empty; empty texts form one class; a null
``doc_id`` is never chosen while its class has another id; a row repeated with
the same ``doc_id`` and text is the same document and shares its verdict in
``classes``, and ``deduplicate`` keeps one of them; very long texts are
hashed and compared whole; an empty table gives an empty result; further columns,
whatever their names, are ignored by ``classes`` and kept by ``deduplicate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .columns import ASCII_SPACE, text_hash, without
from .scratch import Scratch


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), ASCII_SPACE, " ")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("body"))
    hashed = texts.select("doc_id", "body", F.unhex(F.md5("body")).alias("h128"))
    found = (
        hashed.groupBy("h128", "body")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h128", F.unhex(F.sha2("body", 256)).alias("h256"), "keep_id", "group_size")
    )
    members = hashed.select("doc_id", "h128", F.unhex(F.sha2("body", 256)).alias("h256"))
    return members.join(found, ["h128", "h256"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("h256")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each class, of the smallest id (null if there is no other)."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    named = docs.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("h")).alias("row"), normalised(F.col(text_col)).alias("body"))
    hashed = named.select("row", "body", F.unhex(F.md5("body")).alias("h128"))
    found = hashed.groupBy("h128", "body").agg(F.min("row").alias("keep"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    members = hashed.select("row", "h128", F.unhex(F.sha2("body", 256)).alias("h256"))
    # Classes of one row lose nothing.
    rows = scratch.save(members.join(found.select("h128", F.unhex(F.sha2("body", 256)).alias("h256"), "keep"), ["h128", "h256"]).select("row", "keep"))
    gone = rows.where(F.col("row") != F.col("keep")).select("row.id", "row.h").distinct()
    left = without(docs, gone, id_col, text_col)
    twice = scratch.save(rows.where(F.col("row") == F.col("keep")).groupBy("row").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("row.id", "row.h"))
    if twice.isEmpty():
        return left
    # Rows that repeat an id and its text: one of each.
    again = twice.select(F.col("id").alias("_id"), F.col("h").alias("_h"))
    marked = left.join(again, left[id_col].eqNullSafe(again["_id"]) & (text_hash(left[text_col]) == again["_h"]), "left")
    once = marked.where(F.col("_h").isNotNull()).dropDuplicates(["_id", "_h"])
    return marked.where(F.col("_h").isNull()).unionByName(once).select(*docs.columns)
