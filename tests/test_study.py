import math
import statistics

import pytest
from pyspark.sql import functions as F

from loomspark.operators import curves, genome, ranks
from loomspark.queries import demo_configs

CURVE = "candidate_id string, status string, nll_curve array<struct<tokens:bigint,nll:double>>"


def plain_ranks(values):
    n = len(values)
    return {k: 0.0 if n == 1 else (sum(o < v for o in values.values()) + (sum(o == v for o in values.values()) - 1) / 2) / (n - 1) for k, v in values.items()}


def test_mid_ranks(spark):
    values = {"p": -3.0, "q": 8.5, "r": 0.0, "s": 8.5, "t": 8.5, "u": 2.25, "w": None}
    got = {r.k: r.r for r in ranks.mid_ranks(spark.createDataFrame(list(values.items()), "k string, v double"), "v", "r").collect()}
    assert got.pop("w") is None and got == plain_ranks({k: v for k, v in values.items() if v is not None})
    one = spark.createDataFrame([("a", 5.0)], "k string, v double")
    assert ranks.mid_ranks(one, "v", "r").first().r == 0.0


@pytest.mark.parametrize(("points", "r2"), [([(3, 7.5), (6, 6.0), (12, 4.5)], 1.0), ([(5, 2.0), (50, 2.0), (500, 2.0)], 0.0), ([(90, 2.1), (7, 6.3), (11, 2.9), (40, 3.7), (20, 3.1)], None)])
def test_regression(spark, points, r2):
    frame = spark.createDataFrame([("x", "ok", points)], CURVE)
    got = curves.regressions(frame).first()
    last = sorted(points)[-3:]
    x, y = [math.log2(p[0]) for p in last], [p[1] for p in last]
    assert got.measured_slope == pytest.approx(statistics.linear_regression(x, y).slope)
    assert got.r_squared == pytest.approx(statistics.correlation(x, y) ** 2 if r2 is None else r2)
    assert got.fit_tokens == [p[0] for p in last] and got.current_nll == y[-1]


def test_scores_against_plain_python(spark):
    rows = [(f"{k:02d}", "failed" if k == 4 else "completed", [(2**j, 5 - k / 10 - 0.2 * j + ((k * j) % 3) / 7) for j in range(1, (2 if k == 7 else 5))]) for k in range(12)]
    rows[3] = ("03", "completed", [(1, 4.0), (2, 4.0), (4, 4.0)])
    frame = spark.createDataFrame(rows, CURVE)
    fits = {}
    for k, status, points in rows:
        if status != "failed" and len(points) >= 3:
            last = sorted(points)[-3:]
            x, y = [math.log2(p[0]) for p in last], [p[1] for p in last]
            slope = statistics.linear_regression(x, y).slope
            fits[k] = (slope, 0.0 if len(set(y)) == 1 else statistics.correlation(x, y) ** 2, last[-1])
    median = statistics.median(f[0] for f in fits.values())
    now = {k: f[2][1] for k, f in fits.items()}
    ahead = {k: round(f[2][1] + (f[1] * f[0] + (1 - f[1]) * median) * math.log2(256 / f[2][0]), 12) for k, f in fits.items()}
    a, b = plain_ranks(now), plain_ranks(ahead)
    got = {r.candidate_id: r for r in curves.quality_scores(frame, 256).collect()}
    assert set(got) == set(fits)
    for k, r in got.items():
        assert r.projected_nll == pytest.approx(ahead[k]) and r.quality == pytest.approx((a[k] + b[k]) / 2)


def test_score_candidates_needs_a_curve(spark):
    short = spark.createDataFrame([("a", "ok", [(1, 2.0)])], CURVE)
    names = [m for g in curves.PROFILE.values() for m in g]
    metrics = spark.createDataFrame([("a", *map(float, range(6)))], "candidate_id string, " + ", ".join(f"{n} double" for n in names))
    row = curves.score_candidates(short, metrics, 8).first()
    assert row.quality is None and row.efficiency is None
    whole = spark.createDataFrame([("a", "ok", [(1, 4.0), (2, 3.0), (4, 2.0)])], CURVE)
    row = curves.score_candidates(whole, metrics, 8).first()
    assert row.balanced == 0.0


def test_lanes_and_promotions(spark):
    rows = [(f"{k:03d}", "failed" if k == 0 else "confirmed", float(k), float(10 - k), 5.0) for k in range(10)]
    frame = spark.createDataFrame(rows, "candidate_id string, status string, quality double, efficiency double, balanced double")
    assert {r.lane: r.candidate_id for r in ranks.lane_leaders(frame).collect()} == {"quality": "001", "efficiency": "009", "balanced": "001"}
    got = [r.candidate_id for r in ranks.promote_rung(frame, (8, 16, 32), 8).orderBy("place").collect()]
    assert got == ["001", "002", "009", "003"]  # the balanced winner is a repeat, so the lane fills up
    with pytest.raises(Exception, match="not enough"):
        ranks.promote_rung(frame.limit(3), (8, 16, 32), 8).collect()
    with pytest.raises(ValueError):
        ranks.promote_rung(frame, (8, 16, 32), 32)
    assert len(ranks.top_half(frame, "quality").collect()) == 5
    assert ranks.finalists(frame).first().asDict() == {"quality": "001", "balanced": "001", "efficiency": "009"}
    with pytest.raises(Exception, match="no finalist"):
        ranks.finalists(frame.withColumn("status", F.lit("completed"))).collect()


def test_nearest_rank_rounds_half_to_even(spark):
    frame = spark.createDataFrame([("g", float(v)) for v in range(6)], "g string, v double")
    assert ranks.nearest_rank(frame, ["g"], "v", {"p50": 0.5, "p90": 0.9}).first().asDict() == {"g": "g", "n": 6, "p50": 2.0, "p90": 4.0}


def test_scalars(spark):
    one = spark.range(1)
    for step, want in ((0, 0.5), (1, 1.0), (10, 0.1)):
        assert one.select(curves.lr_scale(F.lit(step), 10, 2, 0.1)).first()[0] == pytest.approx(want)
    for text, kind in (("CUDA out of memory", "oom"), ("non-finite training loss", "non_finite"), ("boom", "runtime")):
        assert one.select(curves.failure(F.lit(text)).alias("f")).first().f.type == kind
    curve = F.from_json(F.lit('[{"tokens":2,"nll":3.0},{"tokens":8,"nll":1.0}]'), "array<struct<tokens:bigint,nll:double>>")
    point = F.struct(F.lit(2).cast("long").alias("tokens"), F.lit(9.0).alias("nll"))
    assert [tuple(p) for p in one.select(curves.upsert_point(curve, point).alias("c")).first().c] == [(2, 9.0), (8, 1.0)]


def test_final_runs(spark):
    frame = spark.createDataFrame([("a", "r1", 1.0, 2.0), ("a", "r2", 3.0, 4.0)], "candidate_id string, run string, monitor_nll double, final_nll double")
    assert tuple(curves.final_runs(frame, ["r2", "r1"]).first()) == ("a", 2.0, 3.0)
    with pytest.raises(Exception, match="not complete"):
        curves.final_runs(frame, ["r1"]).collect()


def test_configuration_identity_and_rules():
    base = demo_configs(1)["000000"]
    assert genome.identity(base) == genome.identity(base | {"expected_parameters": 5})
    assert genome.identity(base) != genome.identity(base | {"embedding_size": 64})
    for change in ({"head_dim": 3}, {"head_dim": 48}, {"num_key_value_heads": 3}, {"window_size": 4}, {"scope": "sliding"}, {"kind": "x"}, {"more": 1}):
        bad = demo_configs(1)["000000"]
        bad["blocks"][0]["block"]["stages"][0]["branches"][0] |= change
        with pytest.raises((ValueError, KeyError)):
            genome.parse(bad)
    with pytest.raises(ValueError):
        genome.parse(base | {"bos_token_id": 8_000})


def test_search_space_rules(spark):
    space = {
        "widths": [256, 512, 128], "logical_depth_bounds": [1, 5], "repeat_counts": [1, 2, 3], "head_dimensions": [32], "kv_heads": [1, 2], "sliding_windows": [256],
        "convolution_ratios": [1.0, 1.25], "convolution_kernels": [3, 4], "swiglu_ratios": [1.0, 2.0], "parameter_bounds": [1, 10**9],
    }
    good = {"blocks": [{"block": {"hidden_size": 256, "stages": [{"branches": [{"kind": "attention", "head_dim": 32, "num_key_value_heads": 2}]}, {"branches": [{"kind": "swiglu", "intermediate_size": 512}]}]}}], "embedding_size": 128}
    wide = {"blocks": [{"block": {"hidden_size": 384, "stages": [{"branches": [{"kind": "swiglu", "intermediate_size": 500}]}]}, "repeat": 4}], "embedding_size": 128}
    got = {r.candidate_id: set(r.broken) for r in genome.outside_space(genome.genome_table(spark, {"good": good, "wide": wide}), space).collect()}
    assert got["good"] == set() and {"width", "repetition", "operation"} <= got["wide"]
