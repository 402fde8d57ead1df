import json

import pytest
from pyspark.sql import functions as F

from loomspark.operators import curves
from loomspark.plans import prepare as prep, search, study
from loomspark.streaming import ingest


def settings(**changes):
    """A small space of our own."""
    even = lambda *keys: {str(k): 1 / len(keys) for k in keys}
    lists = {"widths": [8, 16], "rungs": [20, 60, 100], "sliding_windows": [5], "head_dimensions": [4, 8], "kv_heads": [1, 3], "convolution_ratios": [0.5, 2.0], "convolution_kernels": [3], "swiglu_ratios": [1.5], "repeat_counts": [1, 2]}
    tables = {p: even(*lists[k]) for k, p in study.CHOICES.items() if p} | {k: even(*v) for k, v in study.NAMED.items()} | {"depth_probabilities": even(2, 3), "embedding_width_probabilities": even(8, 16)}
    return lists | tables | {
        "format_version": 1, "seed": 9, "generation_size": 4, "mutation_attempts": 3, "random_attempts": 3, "final_tokens": 140, "parameter_bounds": [1, 900], "logical_depth_bounds": [1, 6],
        "controlled_mutations": ["delete_block"], "random_immigrants": 1,
        "training": {"sequence_length": 5, "device_batch_size": 2, "batch_tokens": 20, "checkpoints": [20, 40, 60, 100], "schedule_tokens": 140, "deterministic": True},
        "evaluation": {"monitor_offset": 0, "monitor_tokens": 30, "final_offset": 30, "final_tokens": 10},
    } | changes


def test_settings_are_checked():
    good = settings()
    assert study.settings_faults(good) == []
    wrong = {
        "widths": [16, 8], "rungs": [20, 70], "parameter_bounds": [9, 1], "final_tokens": 100, "random_immigrants": 4, "controlled_mutations": ["no_such_edit"], "format_version": 2,
        "kv_head_probabilities": {"1": 1.0}, "mixer_probabilities": {"attention": 0.5, "convolution": 0.2, "none": 0.2}, "depth_probabilities": {"two": 1.0},
        "training": good["training"] | {"batch_tokens": 25}, "evaluation": good["evaluation"] | {"final_offset": 29}, "mutation_attempts": 0,
    }
    for key, value in wrong.items():
        assert study.settings_faults(settings(**{key: value})), key
    del good["widths"]
    with pytest.raises(ValueError, match="widths: missing"):
        study.check_settings(good)


def test_one_coordinator(tmp_path):
    with study.coordinator(tmp_path / "s"):
        with pytest.raises(RuntimeError, match="another process"), study.coordinator(tmp_path / "s"):
            pass
    with study.coordinator(tmp_path / "s"):
        pass


def test_state_goes_on(tmp_path):
    now = [100.0]
    clock = lambda: now[0]
    with pytest.raises(ValueError, match="limit"):
        study.Study(tmp_path / "s", settings(), {})
    s = study.Study(tmp_path / "s", settings(), {"data": "a"}, hours=0.01, clock=clock)
    s.start_clock()
    now[0] += 6
    s.save(phase="training")
    now[0] += 4
    assert s.elapsed() == 10 and s.seconds_left() == 26
    s.save()
    now[0] += 50  # a crash: nobody was at work
    again = study.Study(tmp_path / "s", settings(), {"data": "a"}, hours=0.02, clock=clock)
    assert again.elapsed() == 10 and again.seconds_left() == 62 and again.state["phase"] == "training"
    for kwargs, args in (({"hours": 0.01}, (settings(), {"data": "a"})), ({}, (settings(seed=1), {"data": "a"})), ({}, (settings(), {"data": "b"})), ({"generations": 0}, (settings(), {"data": "a"}))):
        with pytest.raises(ValueError):
            study.Study(tmp_path / "s", *args, **kwargs)
    (tmp_path / "s" / "search.json").unlink()
    with pytest.raises(RuntimeError):
        study.Study(tmp_path / "s", settings(), {"data": "a"})
    (tmp_path / "t" / "candidates" / "000000").mkdir(parents=True)
    with pytest.raises(RuntimeError):
        study.Study(tmp_path / "t", settings(), {}, generations=2)


PROFILE_NAMES = [m for g in curves.PROFILE.values() for m in g]


def records(spark):
    """Eight candidates whose curves fall ever faster, the last one failed; a curve of two points for number 6."""
    rows = [
        (f"{k:06d}", f"d{k}", 1 if k < 6 else 0, "failed" if k == 7 else "running", 60, 100, [(20 * i, 9.0 - i * (k + 1) / 10) for i in range(1, 3 if k == 6 else 6)], None, None, None, {"20": {"quality": 0.25}})
        for k in range(8)
    ]
    kind = "candidate_id string, digest string, generation int, status string, rung long, trained_tokens long, nll_curve array<struct<tokens:bigint,nll:double>>, quality double, balanced double, efficiency double, scores_by_rung map<string,map<string,double>>"
    metrics = [(f"{k:06d}", *[float((k * 3 + i) % 8) for i in range(len(PROFILE_NAMES))]) for k in range(8)]
    return spark.createDataFrame(rows, kind), spark.createDataFrame(metrics, "candidate_id string, " + ", ".join(f"{m} double" for m in PROFILE_NAMES))


def test_scores_by_rung_and_promotion(spark):
    rows, metrics = records(spark)
    scored = study.score_rung(rows, metrics, 1, 60, 140)
    got = {r.candidate_id: r for r in scored.collect()}
    assert scored.columns == rows.columns and len(got) == 8
    want = {r.candidate_id: r for r in curves.score_candidates(search.cohort(rows, 1, 60), metrics, 140).collect()}
    for k, r in want.items():
        assert got[k].quality == r.quality and got[k].scores_by_rung["60"]["balanced"] == r.balanced and got[k].scores_by_rung["20"] == {"quality": 0.25}
    assert [got[k].scores_by_rung for k in ("000006", "000007")] == [{"20": {"quality": 0.25}}] * 2
    early = {r.candidate_id: r for r in study.rescore_archive(rows, metrics, 60, 140).collect()}
    cut = rows.where("status <> 'failed'").withColumn("nll_curve", F.filter("nll_curve", lambda p: p["tokens"] <= 60))
    then = {r.candidate_id: r.quality for r in curves.score_candidates(cut, metrics, 140).collect()}
    for k, q in then.items():
        assert early[k].scores_by_rung["60"].get("quality") == q and early[k].quality is None
    assert "60" not in early["000007"].scores_by_rung
    after = {r.candidate_id: r.status for r in study.promote(scored, [60, 80, 100], 1, 60).collect()}
    won = {r.candidate_id for r in study.ranks.promote_rung(search.cohort(scored, 1, 60), [60, 80, 100], 60).collect()}
    assert after == {k: "pending" if k in won else "completed" if k in want else got[k].status for k in got}
    assert won


def test_final_report(spark, tmp_path):
    rows = [("a", 2.0, 1.0, 9.0), ("b", 2.5, 2.0, 1.0), ("c", 3.0, 3.0, 0.5)]
    verified = spark.createDataFrame(rows, "candidate_id string, final_nll double, slow double, big double")
    groups = {"time": ["slow"], "space": ["big"]}
    report = study.final_report(verified, {"quality": "a", "balanced": "a", "efficiency": "a"}, groups)
    # Mid-ranks: nll 0, .5, 1; slow 0, .5, 1; big 1, .5, 0: efficiency .5 for all, so the least id leads.
    assert report["roles_after"] == {"quality": "a", "balanced": "a", "efficiency": "a"}
    assert report["candidates"]["b"] == {"candidate_id": "b", "final_nll": 2.5, "quality": 0.5, "efficiency": 0.5, "balanced": 0.5}
    other = study.final_report(verified.withColumn("slow", F.lit(10.0) - F.col("slow")), {"quality": "a", "balanced": "a", "efficiency": "a"}, groups)
    assert other["roles_after"]["efficiency"] == "c" and other["role_changes"]["efficiency"]["changed"] and not other["role_changes"]["quality"]["changed"]


def test_checkpoints_and_going_on(tmp_path):
    assert not study.checkpoint_ready(tmp_path, 7, "d", 70)
    study.save_checkpoint(tmp_path, 7, b"m", b"o", {"architecture_digest": "d", "trained_tokens": 70})
    assert study.checkpoint_ready(tmp_path, 7, "d", 70) and not study.checkpoint_ready(tmp_path, 7, "e", 70) and not study.checkpoint_ready(tmp_path, 7, "d", 71)
    study.save_checkpoint(tmp_path, 9, b"m", b"o", {"architecture_digest": "d", "trained_tokens": 90})
    assert not study.checkpoint_ready(tmp_path, 7, "d", 70)  # not the newest
    (tmp_path / "optimizer_000009.pt").unlink()
    assert not study.checkpoint_ready(tmp_path, 9, "d", 90)
    same = dict.fromkeys(study.FROZEN, 1)
    study.check_resume(same, same | {"log_every": 5}, {"global_consumed_tokens": 40}, 40)
    for before, loader in ((same | {"lr": 2}, {"global_consumed_tokens": 40}), (same, {"global_consumed_tokens": 39}), (same, None)):
        with pytest.raises(ValueError, match="can't go on"):
            study.check_resume(before, same, loader, 40)

    class Tokenizer:
        vocab_size = 11

        def fingerprint(self):
            return "f"

    study.check_tokenizer({"tokenizer": {"vocab_size": 11, "fingerprint": "f"}}, Tokenizer())
    with pytest.raises(ValueError):
        study.check_tokenizer({"tokenizer": {"vocab_size": 12, "fingerprint": "f"}}, Tokenizer())


def test_ledger_finds_what_changed(spark):
    rows = [("s", "train", bytes([k] * 4), k, k + 1) for k in range(5)] + [("t", "train", bytes([k] * 4), k, k + 1) for k in range(9, 12)]
    kind = "source_id string, split string, dedup_hash binary, start_token long, end_token long"
    accepted = spark.createDataFrame(rows, kind)
    ledger = spark.createDataFrame(prep.source_ledger(accepted, ["s", "t"]).collect())
    assert {r.source_id: (r.start, r.end) for r in ledger.collect()} == {"s": (0, 5), "t": (5, 8)}
    problems = lambda table, led=ledger: {r.source_id: r.problem for r in prep.verify_sources(table, led, ["s", "t"]).collect()}
    assert problems(accepted.repartition(3)) == {}
    assert problems(accepted.where("start_token <> 2")) == {"s": "documents", "t": "gap"}
    assert problems(accepted.where("source_id = 's'")) == {"t": "missing"}
    assert problems(accepted.withColumn("dedup_hash", F.when(F.col("start_token") == 2, F.lit(b"x")).otherwise(F.col("dedup_hash")))) == {"s": "digests"}
    assert problems(accepted, ledger.where("source_id = 's'")) == {"t": "unlisted"}
    assert problems(accepted, ledger.withColumn("end", F.col("end") + 1)) == {"s": "length", "t": "length"}


def test_points_of_a_stream(spark, tmp_path):
    kind = "candidate_id string, tokens long, nll double, seq long"
    for k, batch in enumerate(([("a", 1, 5.0, 0), ("a", 1, 4.0, 1)], [("a", 1, 3.0, 2), ("b", 1, 9.0, 3)])):
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = ingest.start_points(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.processAllAvailable()
        q.stop()
        got = sorted(map(tuple, ingest.read_points(spark, str(tmp_path / "out")).collect()))
        assert got == ([("a", 1, 4.0)], [("a", 1, 3.0), ("b", 1, 9.0)])[k]


def test_manifest_is_checked_when_read(tmp_path):
    (tmp_path / "manifest.json").write_text(json.dumps({"format_version": 2}))
    with pytest.raises(ValueError):
        prep.load_manifest(tmp_path / "manifest.json")
    steps = prep.Commits(None, {})
    steps.add({"source": "t"})
    with pytest.raises(ValueError, match="first"):
        steps.check_order(["s", "t"])
