"""Small files of a build or a study as tables: results, configurations, manifests, journals."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.genome import GENOME

RESULT = (
    "format_version int, candidate_id string, digest string, generation int, parent string, parent_digest string, mutation map<string,string>, status string, rung long, "
    "trained_tokens long, nll_curve array<struct<tokens:bigint,nll:double>>, "
    "profile struct<static:struct<parameters:bigint,weight_bytes:bigint,flops_per_token:bigint,state_bytes:map<string,bigint>,logical_depth:int,unique_parameter_blocks:int,executions:map<string,int>>,"
    "latency:map<string,struct<p50_seconds:double,p95_seconds:double>>,memory:struct<resident_vram_bytes:bigint,peak_vram_bytes:bigint>>, "
    "scores map<string,double>, scores_by_rung map<string,map<string,double>>, error struct<type:string,message:string,recorded_at:string>, created_at string, updated_at string"
)


def results(spark: SparkSession, study: str) -> DataFrame:
    """All candidate results of a study, in one pass over their files."""
    return spark.read.schema(RESULT).option("multiLine", True).json(f"{study}/candidates/*/result.json")


def architectures(spark: SparkSession, study: str) -> DataFrame:
    """Configurations by candidate id, which is the name of their folder."""
    rows = spark.read.schema(GENOME).option("multiLine", True).json(f"{study}/candidates/*/architecture.json")
    return rows.withColumn("candidate_id", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def manifest_table(spark: SparkSession, manifest: Mapping[str, Any]) -> DataFrame:
    """A row for each shard of a manifest, with where it ends in its stream."""
    rows = []
    for source in manifest["sources"]:
        for split, x in source["splits"].items():
            end = 0
            for k, h in enumerate(x["shards"]):
                end += h["tokens"]
                rows.append((source["id"], split, k, h["path"], h["tokens"], end, h["sha256"]))
    return spark.createDataFrame(rows, "source_id string, split string, shard int, path string, tokens long, end long, sha256 string")


def journal(spark: SparkSession, path: str, size: int = 16) -> DataFrame:
    """(ord, dedup_hash) of a file of digests put end to end; a cut-off or repeated digest raises."""
    whole = spark.read.format("binaryFile").load(path).select("content", F.length("content").alias("n"))
    fits = F.when(F.col("n") % size == 0, F.col("n")).otherwise(F.raise_error(F.lit("the journal is cut off")).cast("int"))
    places = F.when(fits > 0, F.sequence(F.lit(0), (F.col("n") / size).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    rows = whole.select("content", F.explode(places).alias("k")).select(F.col("k").cast("long").alias("ord"), F.substring("content", F.col("k") * size + 1, F.lit(size)).alias("dedup_hash"))
    seen = rows.groupBy("dedup_hash").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("k"))
    return seen.select("ord", F.when(F.col("k") == 1, F.col("dedup_hash")).otherwise(F.raise_error(F.lit("a digest is repeated")).cast("binary")).alias("dedup_hash"))


def tree_bytes(spark: SparkSession, folder: str) -> int:
    """Bytes of all files below a folder, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def experiment(folder: str, *names: str) -> dict[str, Any]:
    """The named JSON objects of an experiment folder, put together."""
    from ..storage import read_json

    out: dict[str, Any] = {}
    for name in names:
        value = read_json(f"{folder}/{name}.json")
        if not isinstance(value, dict):
            raise ValueError(f"{name} is not a JSON object")
        out |= value
    return out
