"""Learning curves: regression on the last points, projections, candidate scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from .ranks import finite, mid_ranks

#: Where the six profile metrics lie, by the group that they score.
PROFILE = {
    "latency": {"prefill_512": "profile.latency.prefill_512.p50_seconds", "prefill_2048": "profile.latency.prefill_2048.p50_seconds", "decode_2048": "profile.latency.decode_2048.p50_seconds"},
    "memory": {"weight_bytes": "profile.static.weight_bytes", "state_bytes_2048": "profile.static.state_bytes.2048", "peak_vram": "profile.memory.peak_vram_bytes"},
}


def last_points(curve: Column, n: int = 3) -> Column:
    """The n points with most tokens, in order."""
    by_tokens = F.array_sort(curve)
    return F.when(F.size(curve) >= n, F.slice(by_tokens, -n, n))


def upsert_point(curve: Column, point: Column) -> Column:
    """The curve with a point put in its place; one with as many tokens is replaced."""
    return F.array_sort(F.concat(F.filter(curve, lambda p: p["tokens"] != point["tokens"]), F.array(point)))


def curve_until(curve: Column, rung: Column) -> Column:
    return F.filter(curve, lambda p: p["tokens"] <= rung)


def regressions(curves: DataFrame, key: str = "candidate_id", curve: str = "nll_curve") -> DataFrame:
    """Line through the last three points of nll against log2(tokens), for curves that have three.

    All within the row: three points need no aggregation.  A flat curve has r_squared 0.
    """
    rows = curves.select(key, last_points(F.col(curve)).alias("p")).where(F.col("p").isNotNull())
    x = F.transform("p", lambda q: F.log2(q["tokens"].cast("double")))
    y = F.transform("p", lambda q: q["nll"].cast("double"))

    def total(array: Column) -> Column:
        return F.aggregate(array, F.lit(0.0), lambda a, b: a + b)

    centred = rows.withColumn("x", x).withColumn("y", y).withColumn("mx", total(F.col("x")) / 3).withColumn("my", total(F.col("y")) / 3)
    sxx = total(F.transform("x", lambda v: (v - F.col("mx")) * (v - F.col("mx"))))
    syy = total(F.transform("y", lambda v: (v - F.col("my")) * (v - F.col("my"))))
    sxy = total(F.zip_with("x", "y", lambda a, b: (a - F.col("mx")) * (b - F.col("my"))))
    sums = centred.withColumn("sxx", sxx).withColumn("syy", syy).withColumn("slope", sxy / F.col("sxx"))
    level = sums.withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx"))
    residual = total(F.zip_with("x", "y", lambda a, b: F.pow(b - (F.col("intercept") + F.col("slope") * a), F.lit(2))))
    r2 = F.when(F.col("syy") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - residual / F.col("syy"))))
    good = F.forall("y", finite)
    slope = F.when(good, F.col("slope")).otherwise(F.raise_error(F.lit("nll must be finite")).cast("double"))
    return level.select(
        key,
        slope.alias("measured_slope"),
        r2.alias("r_squared"),
        F.element_at("p", 3)["tokens"].alias("current_tokens"),
        F.element_at("y", 3).alias("current_nll"),
        F.transform("p", lambda q: q["tokens"]).alias("fit_tokens"),
    )


def forecasts(regressed: DataFrame, horizon: int, key: str = "candidate_id") -> DataFrame:
    """Projection to ``horizon`` with each slope drawn to the median by what its fit leaves open."""
    median = regressed.agg(F.median("measured_slope").alias("median_slope"))  # one row
    r2, slope = F.col("r_squared"), F.col("measured_slope")
    joined = regressed.crossJoin(F.broadcast(median)).withColumn("effective_slope", r2 * slope + (1 - r2) * F.col("median_slope"))
    ahead = F.col("current_nll") + F.col("effective_slope") * F.log2(F.lit(float(horizon)) / F.col("current_tokens"))
    return joined.withColumns({"projected_tokens": F.lit(horizon).cast("long"), "projected_nll": ahead})


def quality_scores(candidates: DataFrame, horizon: int) -> DataFrame:
    """candidate_id, forecast columns and quality: the mean mid-rank of current and projected nll."""
    live = candidates.where(~F.col("status").eqNullSafe("failed"))
    told = forecasts(regressions(live), horizon)
    ranked = mid_ranks(mid_ranks(told, "current_nll", "current_rank"), "projected_nll", "projected_rank")
    return ranked.withColumn("quality", (F.col("current_rank") + F.col("projected_rank")) / 2)


def efficiency_scores(metrics: DataFrame, groups: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """candidate_id, latency, memory, efficiency for candidates that have all metrics (failed ones rank too)."""
    groups = groups or {g: list(m) for g, m in PROFILE.items()}
    names = [m for g in groups.values() for m in g]
    ranked = metrics
    for name in names:
        ranked = mid_ranks(ranked.withColumn(name, F.when(finite(F.col(name).cast("double")), F.col(name).cast("double"))), name, f"{name}_rank")
    means = {g: sum((F.col(f"{m}_rank") for m in ms), F.lit(0.0)) / len(ms) for g, ms in groups.items()}
    scored = ranked.select("candidate_id", *[v.alias(g) for g, v in means.items()])
    for g in groups:
        scored = scored.where(F.col(g).isNotNull())
    return scored.withColumn("efficiency", sum((F.col(g) for g in groups), F.lit(0.0)) / len(groups))


def metric(frame: DataFrame, path: str) -> Column:
    """A nested number as double; null where it is missing or not finite."""
    kind = frame.schema
    for name in path.split("."):
        if not isinstance(kind, StructType) or name not in kind.names:
            return F.lit(None).cast("double")
        kind = kind[name].dataType
    value = F.col(path).cast("double")
    return F.when(finite(value), value)


def score_candidates(candidates: DataFrame, metrics: DataFrame, horizon: int) -> DataFrame:
    """All scores of a cohort; none at all if no curve has three points."""
    quality = quality_scores(candidates, horizon).select("candidate_id", "current_nll", "projected_nll", "quality")
    some = quality.agg((F.count(F.lit(1)) > 0).alias("_some"))  # one row
    cheap = efficiency_scores(metrics).crossJoin(F.broadcast(some)).where("_some").drop("_some")
    joined = candidates.select("candidate_id", "status").join(quality, "candidate_id", "left").join(cheap, "candidate_id", "left")
    return joined.withColumn("balanced", (F.col("quality") + F.col("efficiency")) / 2)


def final_runs(runs: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean monitor and final nll of each candidate over exactly the named runs."""
    found = runs.groupBy("candidate_id").agg(F.array_sort(F.collect_list("run")).alias("runs"), F.avg("monitor_nll").alias("monitor_nll"), F.avg("final_nll").alias("final_nll"))
    whole = F.col("runs") == F.array(*[F.lit(n) for n in sorted(names)])
    return found.select("candidate_id", F.when(whole, F.col("monitor_nll")).otherwise(F.raise_error(F.lit("final runs are not complete")).cast("double")).alias("monitor_nll"), "final_nll")


def validation_loss(losses: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Loss averaged over steps, then over ranks, and its perplexity (of 20 at most)."""
    per_rank = losses.groupBy(*by, "rank").agg(F.avg("loss").alias("loss"))
    mean = per_rank.groupBy(*by).agg(F.avg("loss").alias("loss"))
    return mean.withColumn("perplexity", F.exp(F.least(F.col("loss"), F.lit(20.0))))


def lr_scale(step: Column, steps: int, warmup: int, floor: float) -> Column:
    """Linear warm-up, then a cosine down to ``floor``."""
    s = step.cast("double")
    t = F.least(F.lit(1.0), (s - warmup) / max(1, steps - warmup))
    return F.when(s < warmup, (s + 1) / (warmup or 1)).otherwise(F.lit(floor) + (1 - floor) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * t)))


def failure(message: Column) -> Column:
    """struct(type, message): what a failure text speaks of, and its last 8,000 characters."""
    low = F.lower(message)
    kind = F.when(low.contains("out of memory"), "oom").when(low.contains("non-finite") | low.contains("not finite"), "non_finite").otherwise("runtime")
    return F.struct(kind.alias("type"), F.right(F.trim(message), F.lit(8000)).alias("message"))


def step_report(steps: DataFrame, by: Sequence[str], tokens: int, flops: float, peak_flops: float) -> DataFrame:
    """Mean, median and 90th percentile step seconds, tokens/s, TFLOPS and utilisation."""
    from .ranks import nearest_rank

    base = steps.groupBy(*by).agg(F.avg("seconds").alias("mean_seconds"), F.median("seconds").alias("median_seconds"))
    rate = F.lit(float(tokens)) / F.col("mean_seconds")
    p90 = nearest_rank(steps, by, "seconds", {"p90_seconds": 0.9}).drop("n")
    return base.join(p90, list(by)).withColumns({"tokens_per_second": rate, "tflops": rate * flops / 1e12, "utilisation": rate * flops / peak_flops})
