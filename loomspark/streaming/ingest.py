"""Documents that arrive as files: a stream that filters, deduplicates and counts.

Quotas need an order over all files and belong to ``plans.prepare``; the stream keeps
an exact set of digests without a watermark, as the batch build does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.text import fingerprint_native


def documents(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("latestFirst", False).parquet(folder)


def accepted_stream(stream: DataFrame, min_chars: int, max_chars: int, fraction: float, text: str = "text") -> DataFrame:
    """First rows of each digest, with their split."""
    kept = stream.where(F.col(text).isNotNull() & (F.col(text) != "") & F.length(text).between(min_chars, max_chars))
    marked = kept.withColumn("_f", fingerprint_native(F.col(text), fraction))
    return marked.select("*", "_f.dedup_hash", "_f.split").drop("_f").dropDuplicates(["dedup_hash"])


def split_counts(accepted: DataFrame, by: str = "source", text: str = "text") -> DataFrame:
    return accepted.groupBy(by, "split").agg(F.count(F.lit(1)).alias("documents"), F.sum((F.octet_length(text) + 2).cast("long")).alias("tokens"))


def start(counts: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keep the counts in a memory table; state and progress live in the checkpoint folder."""
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


def upsert_points(points: DataFrame, batch: DataFrame) -> DataFrame:
    """Curve points with a micro-batch put in: the last one for each (candidate_id, tokens) wins."""
    keys = ["candidate_id", "tokens"]
    newest = batch.groupBy(*keys).agg(F.max_by("nll", "seq").alias("nll"))
    return points.join(newest, keys, "left_anti").select(*keys, "nll").unionByName(newest)


def start_points(points: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keep a stream of (candidate_id, tokens, nll, seq) in ``folder``: one part for each micro-batch, written again if it is retried."""

    def put(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("candidate_id", "tokens").agg(F.max_by("nll", "seq").alias("nll"))
        newest.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return points.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()


def read_points(spark: SparkSession, folder: str) -> DataFrame:
    """The curve points of all micro-batches; the last batch that has a point wins."""
    parts = spark.read.schema("candidate_id string, tokens long, nll double, batch long").parquet(folder)
    return parts.groupBy("candidate_id", "tokens").agg(F.max_by("nll", "batch").alias("nll"))
