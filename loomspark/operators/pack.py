"""Acceptance of documents: global exact deduplication, splits, quotas and token spans.

Order decides who is accepted, but the rule reduces to sets: within one source take
the first row of each digest that no earlier source's *accepted* rows have, then in
each split the prefix whose running token count is still below the target.  Duplicates
share their split and a full split never opens again, so that equals reading the
documents one by one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import cut

#: Rows that one task sums in order; offsets between such chunks come from a small table.
CHUNK_ROWS = 65_536


def first_occurrences(docs: DataFrame, key: str = "dedup_hash", order: Sequence[str] = ("file_ord", "row")) -> DataFrame:
    """The first row of each key; rows meet as small structs, combined before the shuffle."""
    rest = [c for c in docs.columns if c not in (key, *order)]
    first = docs.groupBy(key).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("x"))
    return first.select(*[F.col(f"x.{c}").alias(c) if c != key else F.col(c) for c in docs.columns])


def running_offsets(docs: DataFrame, value: str, keys: Sequence[str] = ("split",), file: str = "file_ord", row: str = "row") -> DataFrame:
    """``docs`` with ``offset``: the sum of ``value`` over earlier rows with the same keys.

    Sums are taken in chunks of rows, chunk totals are added up in a table with one row
    for each chunk, so a source of any size is not ordered in one task.
    """
    held = docs.withColumn("_chunk", F.floor(F.col(row) / CHUNK_ROWS))
    place = [*keys, file, "_chunk"]
    totals = held.groupBy(*place).agg(F.sum(value).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(file, "_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*place, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*place).orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    summed = held.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(bases, place).withColumn("offset", (F.col("_base") + F.col("_in")).cast("long")).drop("_chunk", "_base", "_in").select(*docs.columns, "offset")


def target_column(targets: Mapping[str, int]) -> Column:
    """Target of the row's split."""
    out = F.lit(None).cast("long")
    for split, n in targets.items():
        out = F.when(F.col("split") == split, F.lit(n)).otherwise(out)
    return out


def accept(docs: DataFrame, targets: Mapping[str, int], taken: DataFrame | None = None, filled: Mapping[str, int] | None = None) -> DataFrame:
    """Accepted rows of one source with ``start_token`` and ``end_token``.

    ``docs`` has dedup_hash, split, n_tokens, file_ord and row; ``taken`` the digests
    accepted so far; ``filled`` the tokens that earlier files of the source gave.
    """
    fresh = docs if taken is None else docs.join(taken.select("dedup_hash"), "dedup_hash", "left_anti")
    placed = running_offsets(first_occurrences(fresh), "n_tokens")
    start = F.col("offset") + (target_column(filled) if filled else F.lit(0))
    return placed.withColumn("start_token", start).where(F.col("start_token") < target_column(targets)).withColumn("end_token", F.col("start_token") + F.col("n_tokens")).drop("offset")


def accept_sources(sources: Sequence[tuple[str, DataFrame]], targets: Mapping[str, Mapping[str, int]], keep_lineage: bool = False) -> DataFrame:
    """``accept`` over sources in order; only accepted digests count against later sources."""
    out: DataFrame | None = None
    for name, docs in sources:
        got = accept(docs, targets[name], out).withColumn("source_id", F.lit(name))
        got = got if keep_lineage else cut(got)
        out = got if out is None else out.unionByName(got)
    assert out is not None, "no sources"
    return out


def accept_all(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """All sources at once: rows with source_id, source_ord, split, dedup_hash, file_ord, row, n_tokens.

    ``targets`` has (source_id, split, target).  Which earlier source blocks a digest
    depends on what that source accepted, so acceptance is iterated: source 1 is right
    after the first round, source k after k rounds at most, and a round that changes
    nothing proves all of them.  Duplicates across sources are few, so a few rounds do,
    however many sources there are.
    """
    keys = ["source_id", "source_ord"]
    rest = [c for c in docs.columns if c not in (*keys, "dedup_hash", "file_ord", "row")]
    order = F.struct("file_ord", "row")
    first = docs.groupBy(*keys, "dedup_hash").agg(F.min_by(F.struct("file_ord", "row", *rest), order).alias("x"))
    own = cut(first.select(*keys, "dedup_hash", "x.*"))
    owner = None
    while True:
        free = own
        if owner is not None:
            free = own.join(owner, "dedup_hash", "left").where(F.col("owner").isNull() | (F.col("owner") >= F.col("source_ord"))).drop("owner")
        placed = running_offsets(free, "n_tokens", ("source_id", "split"))
        # A row for each source and split.
        full = placed.join(F.broadcast(targets), ["source_id", "split"]).where(F.col("offset") < F.col("target")).drop("target")
        accepted = cut(full.withColumnRenamed("offset", "start_token").withColumn("end_token", F.col("start_token") + F.col("n_tokens")))
        held = cut(accepted.groupBy("dedup_hash").agg(F.min("source_ord").alias("owner")))
        if owner is not None and held.count() == owner.count() and held.join(owner, ["dedup_hash", "owner"], "left_anti").isEmpty():
            return accepted
        owner = held


def shard_segments(accepted: DataFrame, shard_tokens: int, by_file: bool = True) -> DataFrame:
    """Where each document's tokens lie: source_id, split, shard, from_token, to_token (in the source's stream).

    A file's end closes the open shard (``by_file``); tables given in memory never do.
    """
    keys = ["source_id", "split", *(["file_ord"] if by_file else [])]
    opened = accepted.groupBy(*keys).agg(F.min("start_token").alias("_open"))
    placed = accepted.join(opened, keys)
    a, b = F.col("start_token") - F.col("_open"), F.col("end_token") - F.col("_open")
    piece = F.explode(F.sequence(F.floor(a / shard_tokens), F.floor((b - 1) / shard_tokens))).alias("_k")
    cut_up = placed.where(F.col("n_tokens") > 0).select("source_id", "split", "file_ord", "row", "start_token", "end_token", "_open", piece)
    low = F.col("_open") + F.col("_k") * shard_tokens
    parts = cut_up.select(
        "source_id", "split", "file_ord", "row", "_k", "start_token",
        F.greatest("start_token", low).alias("from_token"), F.least("end_token", low + shard_tokens).alias("to_token"),
    )
    order = ["file_ord", "_k"] if by_file else ["_k"]
    listed = parts.select("source_id", "split", *order).distinct()
    numbered = listed.withColumn("shard", F.row_number().over(Window.partitionBy("source_id", "split").orderBy(*order)) - 1)
    return parts.join(numbered, ["source_id", "split", *order]).drop("_k")


def shard_table(segments: DataFrame) -> DataFrame:
    """source_id, split, shard, tokens, end: sizes of shards and their running ends."""
    sizes = segments.groupBy("source_id", "split", "shard").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("tokens"))
    upto = Window.partitionBy("source_id", "split").orderBy("shard")
    return sizes.withColumn("end", F.sum("tokens").over(upto))


def split_totals(accepted: DataFrame) -> DataFrame:
    return accepted.groupBy("source_id", "split").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))


def budget_report(totals: DataFrame, targets: DataFrame) -> DataFrame:
    """Totals against targets(source_id, split, requested, target): overshoot, reserve, and what is missing."""
    joined = targets.join(totals, ["source_id", "split"], "left").na.fill(0, ["tokens", "documents"])
    return joined.select(
        "source_id", "split", "requested", "target", "tokens", "documents",
        (F.col("tokens") - F.col("target")).alias("overshoot"),
        (F.col("tokens") - F.col("requested")).alias("reserve"),
        (F.col("tokens") >= F.col("target")).alias("complete"),
    )


def read_tokens(tokens: DataFrame, start: int, count: int) -> DataFrame:
    """Random access: the tokens [start, start + count) of every (source_id, split) stream in ``tokens``.

    ``tokens`` holds start_token and an array; runs that overlap the range are cut and
    put together in order.  The result is as long as the range that was asked for.
    """
    a, n = F.col("start_token"), F.size("tokens")
    hit = tokens.where((a < start + count) & (a + n > start))
    low = F.greatest(a, F.lit(start))
    part = F.slice("tokens", (low - a + 1).cast("int"), (F.least(a + n, F.lit(start + count)) - low).cast("int"))
    runs = hit.select("source_id", "split", F.struct(low.alias("at"), part.alias("t")).alias("x"))
    return runs.groupBy("source_id", "split").agg(F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"])).alias("tokens"))
