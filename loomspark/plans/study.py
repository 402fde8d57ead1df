"""A study's life: settings, one coordinator, state with a clock, scores by rung, the final report.

Records are tables (``plans.search``); a study's state is one small JSON file.  Checks
gather all faults before they raise, so a wrong file is mended in one go.
"""

from __future__ import annotations

import fcntl
import time
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..operators import curves, ranks
from ..storage import latest_complete, read_json, write_json
from . import search

LANES = ("quality", "balanced", "efficiency")
# Names of a study's settings.
#: Ascending lists of positive values, and the distribution over each.
CHOICES = {
    "widths": None,
    "rungs": None,
    "sliding_windows": None,
    "head_dimensions": "attention_head_dimension_probabilities",
    "kv_heads": "kv_head_probabilities",
    "convolution_ratios": "convolution_ratio_probabilities",
    "convolution_kernels": "convolution_kernel_probabilities",
    "swiglu_ratios": "swiglu_ratio_probabilities",
    "repeat_counts": "repeat_count_probabilities",
}
#: Distributions over names, and over any whole numbers.
NAMED = {
    "mutation_probabilities": tuple(search.EDITS),
    "block_width_probabilities": ("same", "narrower", "wider"),
    "mixer_probabilities": ("attention", "convolution", "none"),
    "swiglu_probabilities": ("enabled", "disabled"),
    "attention_scope_probabilities": ("global", "sliding"),
    "parent_lane_probabilities": LANES,
}
NUMBERED = ("depth_probabilities", "embedding_width_probabilities")
BOUNDS = ("parameter_bounds", "logical_depth_bounds")
POSITIVE = ("generation_size", "mutation_attempts", "random_attempts", "final_tokens")
#: What a training run may not change when it goes on.
FROZEN = ("sequence_length", "device_batch_size", "batch_tokens", "train_tokens", "lr", "weight_decay", "warmup_steps", "min_lr", "grad_clip", "optimizer", "world_size")


# --- settings -------------------------------------------------------------------------------------


def _is_distribution(table: Any, keys: Sequence[Any] | None) -> bool:
    if not isinstance(table, Mapping) or not table or (keys is not None and set(table) != {str(k) for k in keys}):
        return False
    numbers = all(isinstance(p, (int, float)) and p >= 0 for p in table.values())
    return numbers and abs(sum(table.values()) - 1) < 1e-9


def settings_faults(settings: Mapping[str, Any]) -> list[str]:
    """What is wrong with a study's settings; empty if they can be used."""
    faults = [f"{k}: missing" for k in (*CHOICES, *(p for p in CHOICES.values() if p), *NAMED, *NUMBERED, *BOUNDS, *POSITIVE, "seed", "training", "evaluation", "controlled_mutations", "random_immigrants") if k not in settings]
    if faults:
        return sorted(faults)

    def fault(ok: Any, what: str) -> None:
        if not ok:
            faults.append(what)

    fault(settings.get("format_version") == 1, "format_version: must be 1")
    for k in POSITIVE:
        fault(settings[k] >= 1, f"{k}: must be positive")
    for k in CHOICES:
        values = list(settings[k])
        fault(values and values[0] > 0 and all(a < b for a, b in zip(values, values[1:], strict=False)), f"{k}: must ascend from above zero")
    for k in BOUNDS:
        low, high = settings[k]
        fault(1 <= low <= high, f"{k}: must be a range from 1 on")
    tables = {p: settings[k] for k, p in CHOICES.items() if p} | NAMED | dict.fromkeys(NUMBERED)
    for k, keys in tables.items():
        fault(_is_distribution(settings[k], keys), f"{k}: must be probabilities of its choices")
    for k in NUMBERED:
        fault(all(str(x).isdigit() for x in settings[k]), f"{k}: must be keyed by whole numbers")
    size = settings["generation_size"]
    fault(0 <= settings["random_immigrants"] < size, "random_immigrants: must leave room in a generation")
    fault(len(settings["controlled_mutations"]) < size and set(settings["controlled_mutations"]) <= set(search.EDITS), "controlled_mutations: must be known edits that fit beside the baseline")
    training, last = settings["training"], settings["final_tokens"]
    micro = training["sequence_length"] * training["device_batch_size"]
    fault(micro >= 1 and training["batch_tokens"] % micro == 0, "training: a batch must be whole micro batches")
    fault(all(t % training["batch_tokens"] == 0 for t in training["checkpoints"]), "training: checkpoints must end a batch")
    fault(training["schedule_tokens"] == last, "training: the schedule must end with the final run")
    fault(training.get("deterministic") is True, "training: must be deterministic")
    fault(set(settings["rungs"]) <= set(training["checkpoints"]) and max(settings["rungs"], default=0) < last, "rungs: must be checkpoints before the final run")
    told = settings["evaluation"]
    fault(
        told["monitor_offset"] == 0 and told["final_offset"] == told["monitor_tokens"] and min(told["monitor_tokens"], told["final_tokens"]) > 0,
        "evaluation: the final slice must follow a monitor slice that starts at zero",
    )
    return faults


def check_settings(settings: Mapping[str, Any]) -> None:
    if faults := settings_faults(settings):
        raise ValueError(f"search settings: {'; '.join(faults)}")


# --- coordinator, state, clock --------------------------------------------------------------------


@contextmanager
def coordinator(folder: str | Path) -> Iterator[None]:
    """Hold a study's lock; a second coordinator is refused at once."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    with open(Path(folder) / ".lock", "a") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError:
            raise RuntimeError("the study is coordinated by another process") from None
        yield  # closing the file frees the lock


class Study:
    """``search.json`` (never changed) and ``state.json`` of a study's folder.

    The clock runs while ``active_since`` is set; each save adds what has passed.
    """

    def __init__(self, folder: str | Path, settings: Mapping[str, Any], inputs: Mapping[str, Any], hours: float | None = None, generations: int | None = None, clock: Any = time.time):
        self.folder, self.clock = Path(folder), clock
        asked = {k: v for k, v in (("hours", hours), ("generations", generations)) if v is not None}
        if any(v <= 0 for v in asked.values()):
            raise ValueError("limits must be positive")
        check_settings(settings)
        fixed, told = self.folder / "search.json", self.folder / "state.json"
        if told.exists():
            self._go_on(fixed, told, settings, inputs, asked)
            return
        if not asked:
            raise ValueError("a new study needs a limit of hours or generations")
        if any((self.folder / "candidates").glob("*")) or (fixed.exists() and read_json(fixed) != settings):
            raise RuntimeError("the folder holds parts of another study")
        (self.folder / "candidates").mkdir(parents=True, exist_ok=True)
        write_json(fixed, settings)
        self.state: dict[str, Any] = {
            "format_version": 1, "status": "running", "phase": "planning", "inputs": dict(inputs), "generation": 0, "seed": settings["seed"], "current_candidate": None,
            "limits": {"hours": 0, "generations": 0} | asked, "elapsed_seconds": 0.0, "active_since": None, "started_at": clock(),
        }
        self.save()

    def _go_on(self, fixed: Path, told: Path, settings: Mapping, inputs: Mapping, asked: Mapping) -> None:
        if not fixed.exists():
            raise RuntimeError("a state without its settings")
        self.state = read_json(told)
        if read_json(fixed) != settings or self.state["inputs"] != inputs:
            raise ValueError("settings or inputs of the study have changed")
        if less := [k for k, v in asked.items() if v < self.state["limits"][k]]:
            raise ValueError(f"limits may only grow: {less}")
        # Nobody was at work since the last save, whatever it says.
        self.state |= {"active_since": None, "limits": self.state["limits"] | asked}
        self.save()

    def save(self, **changes: Any) -> None:
        """Put the changes in, with the time that has passed."""
        now = self.clock()
        self.state["elapsed_seconds"] = self.elapsed(now)
        if self.state["active_since"] is not None:
            self.state["active_since"] = now
        self.state |= changes
        write_json(self.folder / "state.json", self.state | {"updated_at": now})

    def elapsed(self, now: float | None = None) -> float:
        since = self.state["active_since"]
        return self.state["elapsed_seconds"] + (max(0.0, (self.clock() if now is None else now) - since) if since is not None else 0.0)

    def start_clock(self) -> None:
        self.save(active_since=self.clock())

    def stop_clock(self) -> None:
        self.save(active_since=None)

    def seconds_left(self) -> float | None:
        """What the hours leave; None without such a limit."""
        hours = self.state["limits"]["hours"]
        return max(0.0, hours * 3600 - self.elapsed()) if hours else None


# --- scores by rung, promotion, report ------------------------------------------------------------


def _scored(records: DataFrame, scores: DataFrame, rung: int, current: bool) -> DataFrame:
    """Records with the scores noted under the rung and, if ``current``, as those that hold now (null ones, too)."""
    new = scores.select("candidate_id", F.struct(*LANES).alias("_new"))
    known = F.coalesce("scores_by_rung", F.create_map().cast("map<string,map<string,double>>"))
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_new.{k}").alias("v")) for k in LANES]), lambda x: x["v"].isNotNull())
    noted = F.map_concat(F.map_filter(known, lambda k, _: k != str(rung)), F.create_map(F.lit(str(rung)), F.map_from_entries(pairs)))
    told = F.col("_new").isNotNull()
    put = {"scores_by_rung": F.when(told, noted).otherwise(F.col("scores_by_rung"))}
    if current:
        put |= {k: F.when(told, F.col(f"_new.{k}")).otherwise(F.col(k)) for k in LANES}
    joined = records.join(new, "candidate_id", "left")
    return joined.select(*[put[c].alias(c) if c in put else F.col(c) for c in records.columns])


def score_rung(records: DataFrame, metrics: DataFrame, generation: int, rung: int, horizon: int) -> DataFrame:
    """Records with a generation's scores at a rung."""
    return _scored(records, curves.score_candidates(search.cohort(records, generation, rung), metrics, horizon), rung, True)


def rescore_archive(records: DataFrame, metrics: DataFrame, rung: int, horizon: int, current: bool = False) -> DataFrame:
    """Records with all candidates that reached a rung scored by what was known there."""
    reached = records.where(~F.col("status").eqNullSafe("failed") & (F.coalesce("trained_tokens", F.lit(0)) >= rung))
    then = reached.withColumn("nll_curve", curves.curve_until(F.col("nll_curve"), F.lit(rung)))
    return _scored(records, curves.score_candidates(then, metrics, horizon), rung, current)


def promote(records: DataFrame, rungs: Sequence[int], generation: int, rung: int) -> DataFrame:
    """Records with the winners of a generation's rung pending again and its others completed."""
    cohort = search.cohort(records, generation, rung)
    won = ranks.promote_rung(cohort, rungs, rung).select("candidate_id").distinct().withColumn("_won", F.lit(True))
    state = cohort.select("candidate_id").join(won, "candidate_id", "left").select("candidate_id", F.when(F.col("_won"), "pending").otherwise("completed").alias("status"))
    return search.update_records(records, state)


def final_scores(verified: DataFrame, groups: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """candidate_id, final_nll, quality (its mid-rank), efficiency, balanced of verified candidates."""
    quality = ranks.mid_ranks(verified, "final_nll", "quality").select("candidate_id", "final_nll", "quality")
    both = quality.join(curves.efficiency_scores(verified, groups).select("candidate_id", "efficiency"), "candidate_id", "left")
    return both.withColumn("balanced", (F.col("quality") + F.col("efficiency")) / 2)


def final_report(verified: DataFrame, before: Mapping[str, str], groups: Mapping[str, Sequence[str]] | None = None) -> dict[str, Any]:
    """Roles before and after verification, with the few finalists' scores."""
    scores = final_scores(verified, groups)
    after = ranks.roles(scores, {"quality": "final_nll", "balanced": "balanced", "efficiency": "efficiency"}).first().asDict()
    changes = {k: {"before": before.get(k), "after": after[k], "changed": before.get(k) != after[k]} for k in LANES}
    rows = {r["candidate_id"]: r.asDict() for r in scores.collect()}  # one leader for each lane
    return {"format_version": 1, "roles_before": dict(before), "roles_after": after, "role_changes": changes, "candidates": rows}


def finalize(study: Study, verified: DataFrame, before: Mapping[str, str]) -> dict[str, Any]:
    report = final_report(verified, before)
    write_json(study.folder / "finalists.json", report)
    study.save(status="finalized", phase="finalized", active_since=None)
    return report


# --- checkpoints and going on ---------------------------------------------------------------------

PARTS = {"model": "pt", "optimizer": "pt", "metadata": "json"}


def _part(folder: str | Path, name: str, step: int) -> Path:
    return Path(folder) / f"{name}_{step:06d}.{PARTS[name]}"


def save_checkpoint(folder: str | Path, step: int, model: bytes, optimizer: bytes, metadata: Mapping[str, Any]) -> None:
    """Write all parts, then the mark that they are whole."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    for name, data in (("model", model), ("optimizer", optimizer)):
        part = _part(folder, name, step)
        part.with_suffix(".tmp").write_bytes(data)
        part.with_suffix(".tmp").replace(part)
    write_json(_part(folder, "metadata", step), dict(metadata))
    write_json(Path(folder) / f"complete_{step:06d}", {"step": step})


def checkpoint_ready(folder: str | Path, step: int, digest: str, tokens: int) -> bool:
    """The newest whole checkpoint is of this step, this configuration and this much training."""
    if latest_complete(folder) != step or not all(_part(folder, name, step).is_file() for name in PARTS):
        return False
    try:
        told = read_json(_part(folder, "metadata", step))
    except (OSError, ValueError):
        return False
    return (told.get("architecture_digest"), told.get("trained_tokens")) == (digest, tokens)


def check_resume(before: Mapping[str, Any], now: Mapping[str, Any], loader: Any, trained_tokens: int) -> None:
    """Raise unless a run may go on: same settings, and a loader that stands where training stopped."""
    faults = [f"{k} has changed" for k in FROZEN if before.get(k) != now.get(k)]
    at = loader.get("global_consumed_tokens") if isinstance(loader, Mapping) else None
    if at != trained_tokens:
        faults.append(f"the loader is at {at}, training at {trained_tokens}")
    if faults:
        raise ValueError(f"can't go on: {'; '.join(faults)}")


def check_tokenizer(manifest: Mapping[str, Any], tokenizer: Any) -> None:
    """Raise if a dataset was packed with another tokenizer."""
    made = manifest["tokenizer"]
    if (made["vocab_size"], made["fingerprint"]) != (tokenizer.vocab_size, tokenizer.fingerprint()):
        raise ValueError("the dataset was packed with another tokenizer")


