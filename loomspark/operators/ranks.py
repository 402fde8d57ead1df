"""Percentiles, mid-ranks, lanes and promotions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

LANES = ("quality", "balanced", "efficiency")


def mid_ranks(frame: DataFrame, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """``frame`` with ``out``: (smaller + (equal - 1) / 2) / (n - 1) among non-null values, 0 for one alone.

    Counts of distinct values are ordered, not rows: the table that meets in one task has
    one row for each different value.
    """
    keys = [*by, value]
    counts = frame.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    below = F.coalesce(F.sum("_k").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = F.sum("_k").over(group)
    ranked = counts.select(*keys, F.when(n > 1, (below + (F.col("_k") - 1) / 2) / (n - 1)).otherwise(0.0).alias(out))
    return frame.join(ranked, keys, "left").select(*frame.columns, out)


def nearest_rank(frame: DataFrame, by: Sequence[str], value: str, fractions: Mapping[str, float]) -> DataFrame:
    """Order statistics at round-half-even((n - 1) * fraction), named by ``fractions``."""
    order = Window.partitionBy(*by).orderBy(value)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    placed = frame.where(F.col(value).isNotNull()).select(*by, value, (F.row_number().over(order) - 1).alias("_i"), n.alias("_n"))
    picks = [F.max(F.when(F.col("_i") == F.bround((F.col("_n") - 1) * F.lit(f)).cast("int"), F.col(value))).alias(name) for name, f in fractions.items()]
    return placed.groupBy(*by).agg(F.max("_n").alias("n"), *picks)


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def lane_rows(records: DataFrame, lanes: Sequence[str] = LANES) -> DataFrame:
    """candidate_id, lane, score of the records that count in a lane: not failed, score finite."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("lane"), F.col(k).cast("double").alias("score")) for k in lanes]))
    rows = records.where(~F.col("status").eqNullSafe("failed")).select("candidate_id", pairs.alias("x")).select("candidate_id", "x.*")
    return rows.where(finite(F.col("score")))


def lane_top(records: DataFrame, counts: Mapping[str, int], lanes: Sequence[str] = LANES) -> DataFrame:
    """The best of each lane by (score, id as text), with their place."""
    order = Window.partitionBy("lane").orderBy("score", F.col("candidate_id").cast("string"))
    room = F.coalesce(F.create_map(*[F.lit(x) for kv in counts.items() for x in kv])[F.col("lane")], F.lit(0))
    return lane_rows(records, lanes).withColumn("place", F.row_number().over(order)).where(F.col("place") <= room)


def lane_leaders(records: DataFrame, lanes: Sequence[str] = LANES) -> DataFrame:
    best = F.min_by("candidate_id", F.struct("score", F.col("candidate_id").cast("string"))).alias("candidate_id")
    return lane_rows(records, lanes).groupBy("lane").agg(best, F.min("score").alias("score"))


def promotions(records: DataFrame, counts: Mapping[str, int]) -> DataFrame:
    """candidate_id and order: winners lane by lane without repeats, filled up from the balanced lane.

    Raises when there are not enough candidates.
    """
    wanted = sum(counts.values())
    lane_no = F.create_map(*[F.lit(x) for i, k in enumerate(LANES) for x in (k, i)])[F.col("lane")]
    winners = lane_top(records, counts).groupBy("candidate_id").agg(F.min(F.struct(lane_no.alias("lane"), "place")).alias("p"))
    spare = lane_top(records, {"balanced": wanted + len(LANES) * wanted}).select("candidate_id", F.struct(F.lit(len(LANES)).alias("lane"), "place").alias("p"))
    every = winners.unionByName(spare).groupBy("candidate_id").agg(F.min("p").alias("p"))
    # At most a few times ``wanted`` rows are ordered here.
    chosen = every.orderBy("p.lane", "p.place").limit(wanted).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("p.lane", "p.place")))
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    checked = F.when(n == wanted, F.col("place")).otherwise(F.raise_error(F.lit("not enough candidates for promotion")).cast("int"))
    return chosen.select("candidate_id", checked.alias("place"))


#: Lanes of the first and the second promotion, and of archive checkpoints.
PROMOTIONS = ({"quality": 2, "balanced": 1, "efficiency": 1}, {"quality": 1, "balanced": 1, "efficiency": 1})
RETAINED = {"quality": 2, "balanced": 2, "efficiency": 2}


def promote_rung(records: DataFrame, rungs: Sequence[int], rung: int) -> DataFrame:
    if rung not in rungs[:2]:
        raise ValueError("only the first two rungs promote")
    return promotions(records, PROMOTIONS[list(rungs).index(rung)])


def retained(records: DataFrame) -> DataFrame:
    """Candidates whose checkpoints stay: the two best of each lane."""
    return lane_top(records, RETAINED).select("candidate_id").distinct()


def top_half(records: DataFrame, lane: str) -> DataFrame:
    """The better half of a lane, rounded up, at least one."""
    rows = lane_rows(records, (lane,))
    order = Window.partitionBy("lane").orderBy("score", F.col("candidate_id").cast("string"))
    n = F.count(F.lit(1)).over(Window.partitionBy("lane"))
    return rows.withColumn("place", F.row_number().over(order)).withColumn("n", n).where(F.col("place") <= F.greatest(F.lit(1), F.ceil(F.col("n") / 2))).drop("n")


def finalists(records: DataFrame) -> DataFrame:
    """One row with a leader for each lane among confirmed candidates; an empty lane raises."""
    led = lane_leaders(records.where(F.col("status") == "confirmed"))
    wide = led.agg(*[F.max(F.when(F.col("lane") == k, F.col("candidate_id"))).alias(k) for k in LANES])
    return wide.select(*[F.when(F.col(k).isNotNull(), F.col(k)).otherwise(F.raise_error(F.lit(f"no finalist for {k}")).cast(wide.schema[k].dataType)).alias(k) for k in LANES])


def status_counts(records: DataFrame, key: str) -> DataFrame:
    """Counts by a key as text, in text order, gathered in a map as well."""
    counts = records.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias("counts"))


def roles(records: DataFrame, values: Mapping[str, str]) -> DataFrame:
    """One row with the best candidate for each role: least finite value, then least id as text."""
    ok = {role: finite(F.col(c).cast("double")) for role, c in values.items()}
    return records.agg(*[F.min_by(F.when(ok[role], F.col("candidate_id")), F.when(ok[role], F.struct(F.col(c).cast("double"), F.col("candidate_id").cast("string")))).alias(role) for role, c in values.items()])


def top_logits(logits: Column, k: int) -> Column:
    """The array with all that is below its k-th largest value at minus infinity; values equal to that one stay."""
    least = F.element_at(F.sort_array(logits, asc=False), F.least(F.lit(k), F.size(logits)))
    return F.transform(logits, lambda v: F.when(v >= least, v).otherwise(F.lit(float("-inf"))))


def time_budget(started: Column, now: Column, hours: float) -> Column:
    """struct(elapsed, left, over): seconds since the start, and what a budget of hours leaves."""
    elapsed = now.cast("double") - started.cast("double")
    left = F.lit(hours * 3600.0) - elapsed
    return F.struct(elapsed.alias("elapsed"), F.greatest(left, F.lit(0.0)).alias("left"), (left <= 0).alias("over"))
