"""Sources: file discovery, checked Parquet scans, tables of documents.

A scan declares its projection and its filters; Spark prunes columns, pushes the
language filter down and keeps ``row`` from the file.  Order is carried by
``(file_ord, row)`` and never by the order of a DataFrame.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..config import Source

DOCUMENT = "file string, file_ord int, row long, content string, score double, metadata map<string,string>"
#: Fixed value: what Python's float() takes for a number, underscores between digits included.
_FLOAT = r"(?i)^\s*[+-]?((\d(_?\d)*)?\.?\d(_?\d)*|\d(_?\d)*\.)(e[+-]?\d(_?\d)*)?\s*$|^\s*[+-]?(inf|infinity|nan)\s*$"


def shuffle_seed(source_id: str, seed: int) -> int:
    return int.from_bytes(hashlib.sha256(b"%s\0%d" % (source_id.encode(), seed)).digest()[:8], "big")


@dataclass(frozen=True)
class FileList:
    """Files of a source in reading order, and the hash that pins them."""

    paths: tuple[str, ...]
    sha256: str
    revision: str | None = None


def list_hash(paths: Sequence[str]) -> str:
    return hashlib.sha256("".join(f"{p}\n" for p in paths).encode()).hexdigest()


def discover(spark: SparkSession, source: Source, seed: int, root: str = "") -> FileList:
    """All .parquet files below the source's path, in its seeded order; any Hadoop file system will do."""
    base = "/".join(x for x in (root.rstrip("/"), source.tree_path.strip("/")) if x) if root else source.tree_path
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(base)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, listing = set(), fs.listFiles(top, True)
    while listing.hasNext():
        path = listing.next().getPath().toString()
        if path.lower().endswith(".parquet"):
            found.add(path)
    return ordered(source, sorted(found), seed)


def ordered(source: Source, paths: Sequence[str], seed: int) -> FileList:
    """The given files without repeats, in the source's seeded order."""
    files = sorted(p for p in set(paths) if p.lower().endswith(".parquet"))
    if not files:
        raise ValueError(f"source {source.id} has no Parquet files")
    random.Random(shuffle_seed(source.id, seed)).shuffle(files)
    return FileList(tuple(files), list_hash(files), source.revision)


def check_schema(schema: T.StructType, source: Source, name: str = "") -> None:
    """Raise unless the columns that filters need are there and of usable types."""
    kinds = {f.name: f.dataType for f in schema}
    needed = [source.content_column]
    needed += [source.language_column] if source.language is not None else []
    needed += [source.score_column] if source.min_score is not None else []
    if lost := sorted({c for c in needed if c not in kinds}):
        raise ValueError(f"source {source.id}: {name or 'its files'} lack columns {lost}")
    for column in (source.content_column, source.language_column):
        if column in kinds and not isinstance(kinds[column], T.StringType):
            raise ValueError(f"source {source.id}: {column} must be text")
    if source.score_column in kinds and not isinstance(kinds[source.score_column], T.NumericType | T.StringType):
        raise ValueError(f"source {source.id}: {source.score_column} must be numeric or numeric text")


def score_number(column: Column, kind: T.DataType, row: Column) -> Column:
    """A score as double; text that Python's float() would refuse raises with its row."""
    if not isinstance(kind, T.StringType):
        return column.cast("double")
    number = F.regexp_replace(F.trim(column), "_", "").try_cast("double")
    wrong = F.raise_error(F.concat(F.lit("non-numeric score at row "), row.cast("string")))
    return F.when(column.isNull(), F.lit(None)).when(column.rlike(_FLOAT), number).otherwise(wrong.cast("double"))


def metadata_value(column: Column, kind: T.DataType) -> Column:
    """Metadata as text: bytes decoded with replacement, truth values as Python spells them."""
    if isinstance(kind, T.BinaryType):
        return F.make_valid_utf8(column.cast("string"))
    if isinstance(kind, T.BooleanType):
        return F.when(column, "True").when(~column, "False")
    return column.cast("string")


def filtered(frame: DataFrame, source: Source, min_chars: int, max_chars: int) -> DataFrame:
    """``DOCUMENT`` rows of a frame with the source's columns, ``file``, ``file_ord`` and ``row``."""
    check_schema(frame.schema, source)
    kinds = {f.name: f.dataType for f in frame.schema}
    text = F.col(source.content_column)
    kept = frame.where(text.isNotNull() & (text != "") & F.length(text).between(min_chars, max_chars))
    if source.language is not None:
        kept = kept.where(F.col(source.language_column) == source.language)
    has_score = source.score_column in kinds
    score = score_number(F.col(source.score_column), kinds[source.score_column], F.col("row")) if has_score else F.lit(None).cast("double")
    pairs = [F.struct(F.lit(alias).alias("key"), metadata_value(F.col(c), kinds[c]).alias("value")) for alias, c in sorted(source.metadata_columns.items()) if c in kinds]
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    metadata = F.map_filter(F.map_from_entries(F.array(*pairs)), lambda _, v: v.isNotNull()) if pairs else empty
    rows = kept.select("file", "file_ord", "row", text.alias("content"), score.alias("score"), metadata.alias("metadata"))
    # A missing score is dropped, NaN passes: Spark orders NaN above every number.
    return rows if source.min_score is None else rows.where(F.col("score") >= F.lit(float(source.min_score)))


def scan(spark: SparkSession, source: Source, files: FileList, min_chars: int, max_chars: int) -> DataFrame:
    """Documents of a source's files; only the columns that are used are read.

    Files are grouped by what columns they have, as optional ones may be missing in some.
    """
    groups: dict[str, list[tuple[int, str]]] = {}
    schemas: dict[str, T.StructType] = {}
    wanted = [source.content_column, source.score_column, source.language_column, *source.metadata_columns.values()]
    for k, path in enumerate(files.paths):
        schema = spark.read.parquet(path).schema
        check_schema(schema, source, path)
        own = T.StructType([f for f in schema if f.name in wanted])
        groups.setdefault(own.json(), []).append((k, path))
        schemas[own.json()] = own
    parts = []
    for key, members in groups.items():
        order = F.create_map(*[F.lit(x) for k, p in members for x in (p, k)])
        frame = spark.read.schema(schemas[key]).parquet(*[p for _, p in members])
        located = frame.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        bare = F.regexp_replace(F.col("file"), "^file:/+", "/")
        numbered = located.withColumn("file_ord", F.coalesce(order[F.col("file")], order[bare]))
        parts.append(filtered(numbered, source, min_chars, max_chars))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def in_memory(frame: DataFrame, source: Source, order: str, min_chars: int, max_chars: int) -> DataFrame:
    """Documents of a table with an explicit order column, as one file 0."""
    located = frame.withColumns({"file": F.lit("memory"), "file_ord": F.lit(0), "row": F.col(order).cast("long")})
    return filtered(located, source, min_chars, max_chars)


def dataset_url(repo: str, revision: str, path: str, host: str = "https://huggingface.co") -> str:
    """Address of one file of a dataset repository."""
    from urllib.parse import quote

    return f"{host}/datasets/{quote(repo, safe='/')}/resolve/{quote(revision, safe='')}/{quote(path, safe='/')}"


def synthetic_batches(spark: SparkSession, steps: int, rows: int, length: int, vocabulary: int, seed: int = 0) -> DataFrame:
    """(step, row, inputs, targets) of made-up tokens; a hash of the place, so partitioning doesn't matter."""
    place = spark.range(steps * rows).select((F.col("id") / rows).cast("long").alias("step"), (F.col("id") % rows).alias("row"))
    tokens = F.transform(F.sequence(F.lit(0), F.lit(length)), lambda i: F.pmod(F.xxhash64("step", "row", i, F.lit(seed)), F.lit(vocabulary)).cast("int"))
    return place.withColumn("t", tokens).select("step", "row", F.slice("t", 1, length).alias("inputs"), F.slice("t", 2, length).alias("targets"))
