"""Settings of a preparation run, checked as they are built.

Everything here is driver-side and small.  ``PrepSettings.parse`` takes the nested
dictionaries of a settings file and returns frozen records; whatever is unknown,
missing or out of range raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import PurePath
from typing import Any

#: The only deduplication policy there is.
DEDUP_POLICY = {"normalization": "NFKC+lower+whitespace", "hash": "blake2b-128", "scope": "global"}
#: Bounds of one tokenizer batch, and of one document.
MAX_BATCH_DOCUMENTS, MAX_BATCH_CHARS = 1_024, 2_000_000
#: Room for one raw file, least room for index and hashes.
RAW_FILE_BYTES, MIN_INDEX_BYTES = 20 * 1024**3, 5 * 1024**3


def canonical_json(value: Any) -> str:
    """Compact JSON with sorted keys; numbers must be finite."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)


def digest(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def whole(value: Any, name: str, least: int = 0) -> int:
    """``value`` if it is a true integer of at least ``least``."""
    if type(value) is not int or value < least:
        raise ValueError(f"{name}: an integer of {least} or more is needed, not {value!r}")
    return value


def _exactly(found: Mapping, allowed: set[str], needed: set[str], what: str) -> None:
    if extra := sorted(set(found) - allowed):
        raise ValueError(f"{what}: unknown settings {extra}")
    if lost := sorted(needed - set(found)):
        raise ValueError(f"{what}: missing settings {lost}")


@dataclass(frozen=True)
class Source:
    """Where documents come from, which columns matter, and what is filtered out."""

    id: str
    repo: str
    tree_path: str
    content_column: str
    revision: str | None = None
    score_column: str | None = None
    language_column: str | None = None
    metadata_columns: Mapping[str, str] = field(default_factory=dict)
    min_score: float | None = None
    language: str | None = None

    @staticmethod
    def parse(raw: Mapping) -> Source:
        needed = {"id", "repo", "tree_path", "content_column"}
        _exactly(raw, needed | {"revision", "score_column", "language_column", "metadata_columns", "filters"}, needed, "source")
        name = raw["id"]
        if not isinstance(name, str) or not name or PurePath(name).name != name:
            raise ValueError(f"source id {name!r} must be one path component")
        for key in ("repo", "tree_path", "content_column"):
            if not isinstance(raw[key], str) or not (raw[key] or key == "tree_path"):
                raise ValueError(f"source {name}: {key} must be text")
        for key in ("revision", "score_column", "language_column"):
            if not isinstance(raw.get(key), str | None):
                raise ValueError(f"source {name}: {key} must be text or null")
        metadata, filters = raw.get("metadata_columns", {}), raw.get("filters", {})
        if not isinstance(metadata, Mapping) or not all(isinstance(x, str) for kv in metadata.items() for x in kv):
            raise ValueError(f"source {name}: metadata_columns must map names to columns")
        if not isinstance(filters, Mapping):
            raise ValueError(f"source {name}: filters must be a mapping")
        _exactly(filters, {"min_score", "language"}, set(), f"filters of source {name}")
        if "min_score" in filters and not (raw.get("score_column") and isinstance(filters["min_score"], int | float)):
            raise ValueError(f"source {name}: min_score needs a number and a score_column")
        if "language" in filters and not raw.get("language_column"):
            raise ValueError(f"source {name}: a language filter needs a language_column")
        return Source(
            name, raw["repo"], raw["tree_path"], raw["content_column"], raw.get("revision"), raw.get("score_column"),
            raw.get("language_column"), dict(metadata), filters.get("min_score"), filters.get("language"),
        )


@dataclass(frozen=True)
class Phase:
    """A stretch of training tokens up to ``end``, mixed by percent weights."""

    end: int
    weights: Mapping[str, int]


def parse_phases(sources: Sequence[str], raw: Any, requested: int) -> list[Phase]:
    """Phases whose ends rise to ``requested`` and whose weights cover all sources and sum to 100."""
    whole(requested, "requested_train_tokens", 1)
    if not sources or len(set(sources)) != len(sources):
        raise ValueError("sources need ids that differ")
    if not isinstance(raw, Mapping) or not isinstance(raw.get("phases"), list) or not raw["phases"]:
        raise ValueError("mixture.phases must be a list with at least one phase")
    phases, start = [], 0
    for i, item in enumerate(raw["phases"]):
        if not isinstance(item, Mapping) or not isinstance(item.get("weights"), Mapping):
            raise ValueError(f"phase {i} must be an object with weights")
        end = whole(item.get("end_tokens"), f"phase {i} end_tokens", 1)
        _exactly(item["weights"], set(sources), set(sources), f"weights of phase {i}")
        weights = {s: whole(item["weights"][s], f"weight of {s}") for s in sources}
        if end <= start:
            raise ValueError("phase ends must rise")
        if sum(weights.values()) != 100:
            raise ValueError(f"weights of phase {i} must sum to 100")
        if any((end - start) * w % 100 for w in weights.values()):
            raise ValueError(f"phase {i} gives a source a fractional quota")
        phases.append(Phase(end, weights))
        start = end
    if start != requested:
        raise ValueError("the last phase must end at requested_train_tokens")
    return phases


def quotas(phases: Sequence[Phase]) -> dict[str, int]:
    """Training tokens of each source over all phases."""
    starts = [0, *(p.end for p in phases)]
    return {s: sum((p.end - a) * p.weights[s] // 100 for a, p in zip(starts, phases, strict=False)) for s in phases[0].weights}


@dataclass(frozen=True)
class PrepSettings:
    sources: tuple[Source, ...]
    phases: tuple[Phase, ...]
    requested: int
    validation_tokens: int
    validation_fraction: float
    min_chars: int
    max_chars: int
    shard_tokens: int
    microbatch_tokens: int
    seed: int = 42

    @property
    def quotas(self) -> dict[str, int]:
        return quotas(self.phases)

    @property
    def reserve(self) -> int:
        """Spare training tokens of each source: one microbatch for each phase and one more."""
        return (len(self.phases) + 1) * self.microbatch_tokens

    def target(self, source: str, split: str) -> int:
        return self.quotas[source] + self.reserve if split == "train" else self.validation_tokens

    @staticmethod
    def parse(raw: Mapping) -> PrepSettings:
        needed = {"sources", "mixture", "requested_train_tokens", "validation_tokens_per_source", "validation_fraction", "filtering", "dedup", "shards"}
        _exactly(raw, needed | {"seed"}, needed, "settings")
        if not isinstance(raw["sources"], list):
            raise ValueError("sources must be a list")
        sources = tuple(Source.parse(s) for s in raw["sources"])
        phases = parse_phases([s.id for s in sources], raw["mixture"], raw["requested_train_tokens"])
        fraction = raw["validation_fraction"]
        if isinstance(fraction, bool) or not isinstance(fraction, int | float) or not 0 < fraction <= 1:
            raise ValueError("validation_fraction must be above 0 and at most 1")
        chars, shards = raw["filtering"], raw["shards"]
        if not isinstance(chars, Mapping) or not isinstance(shards, Mapping):
            raise ValueError("filtering and shards must be objects")
        _exactly(chars, {"min_chars", "max_chars"}, {"min_chars", "max_chars"}, "filtering")
        low, high = whole(chars["min_chars"], "min_chars"), whole(chars["max_chars"], "max_chars", 1)
        if not low <= high <= MAX_BATCH_CHARS:
            raise ValueError(f"min_chars <= max_chars <= {MAX_BATCH_CHARS} is needed")
        if raw["dedup"] != DEDUP_POLICY:
            raise ValueError(f"dedup must be {DEDUP_POLICY}")
        names = {"tokens", "maximum_loader_microbatch_tokens"}
        _exactly(shards, names, names, "shards")
        return PrepSettings(
            sources, tuple(phases), raw["requested_train_tokens"], whole(raw["validation_tokens_per_source"], "validation_tokens_per_source", 1),
            float(fraction), low, high, whole(shards["tokens"], "shards.tokens", 1),
            whole(shards["maximum_loader_microbatch_tokens"], "maximum_loader_microbatch_tokens"), raw.get("seed", 42),
        )


def disk_needed(settings: PrepSettings, token_bytes: int = 2) -> dict[str, int]:
    """Bytes to set aside: packed tokens, one raw file, index and hashes."""
    tokens = settings.requested + len(settings.sources) * (settings.reserve + settings.validation_tokens)
    packed = token_bytes * tokens
    index = max(MIN_INDEX_BYTES, packed // 2)
    return {"packed": packed, "raw_file": RAW_FILE_BYTES, "index": index, "total": packed + RAW_FILE_BYTES + index}


def disk_preflight(settings: PrepSettings, free: int, staged: int = 0) -> dict[str, int]:
    """Raise unless ``free`` bytes and what is already staged cover the need."""
    need = disk_needed(settings)
    if free + staged < need["total"]:
        raise ValueError(f"{need['total']} bytes are needed, {free} are free and {staged} staged")
    return need | {"free": free, "staged": staged}
