"""Corpus preparation: from sources to accepted documents, shards and a manifest.

Sources are taken in order.  Within a source, files may be read in steps: after each
step the accepted rows are written and counted, and reading stops as soon as every
split has its tokens, so a source far larger than its quota is not tokenised whole.
A committed step's files are never read again (``Commits``); its rows are compared
with what was committed before a build goes on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from pathlib import Path
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..config import DEDUP_POLICY, PrepSettings, Source, digest
from ..functions.text import content_digest, fingerprint
from ..functions.tokens import check_vocabulary, token_count, token_ids
from ..operators.pack import accept, shard_segments, shard_table, split_totals
from ..sources.documents import FileList, scan
from ..storage import cut, publish, read_json, sha256_file, write_json

Fingerprint = Callable[[Column], Column]


def candidates(docs: DataFrame, tokenizer: Any, mark: Fingerprint) -> DataFrame:
    """Documents with their digest, split, token count and content hash."""
    marked = docs.withColumn("_f", mark(F.col("content")))
    return marked.select(
        "file", "file_ord", "row", "content", "score", "metadata", F.col("_f.dedup_hash").alias("dedup_hash"), F.col("_f.split").alias("split"),
        token_count(F.col("content"), tokenizer).alias("n_tokens"), content_digest(F.col("content")).alias("content_hash"),
    )


class Commits:
    """What a build has finished, in one JSON file, with the contract that it holds for."""

    def __init__(self, path: str | Path | None, contract: Mapping[str, Any]):
        self.path, self.contract = Path(path) if path else None, digest(contract)
        self.state: dict[str, Any] = {"contract": self.contract, "steps": []}
        if self.path and self.path.exists():
            self.state = read_json(self.path)
            if self.state["contract"] != self.contract:
                raise ValueError("the settings of the unfinished build differ; it can't be resumed")

    def check_order(self, sources: Sequence[str]) -> None:
        """Raise unless the sources with steps are the first ones, in order."""
        begun = list(dict.fromkeys(s["source"] for s in self.state["steps"]))
        if begun != list(sources[: len(begun)]):
            raise ValueError(f"the finished steps are of {begun}, which don't come first in {list(sources)}")

    def done(self, source: str) -> list[dict[str, Any]]:
        return [s for s in self.state["steps"] if s["source"] == source]

    def add(self, step: dict[str, Any]) -> None:
        self.state["steps"].append(step)
        if self.path:
            write_json(self.path, self.state)


def contract(settings: PrepSettings, tokenizer: Any, files: Mapping[str, FileList]) -> dict[str, Any]:
    """All that an unfinished build depends on."""
    return {
        "sources": [s.__dict__ | {"metadata_columns": dict(s.metadata_columns)} for s in settings.sources],
        "phases": [[p.end, dict(p.weights)] for p in settings.phases],
        "tokens": [settings.requested, settings.validation_tokens, settings.shard_tokens, settings.reserve],
        "split": [settings.validation_fraction, settings.seed],
        "chars": [settings.min_chars, settings.max_chars],
        "tokenizer": tokenizer.fingerprint(),
        "dedup": DEDUP_POLICY,
        "files": {k: [f.revision, f.sha256] for k, f in files.items()},
    }


def prepare(
    spark: SparkSession,
    settings: PrepSettings,
    tokenizer: Any,
    documents: Mapping[str, DataFrame] | None = None,
    files: Mapping[str, FileList] | None = None,
    files_per_step: int = 64,
    work: str | None = None,
    mark: Fingerprint | None = None,
) -> DataFrame:
    """Accepted documents of all sources: source_id, split, start_token, end_token, and the document.

    ``documents`` gives tables by source; sources without one are read from ``files``.
    With ``work``, each step's rows are a Parquet folder there and a rerun goes on after
    the last finished step; without it they are checkpointed.
    """
    check_vocabulary(tokenizer)
    mark = mark or (lambda text: fingerprint(text, settings.seed, settings.validation_fraction))
    files = files or {}
    commits = Commits(f"{work}/build_state.json" if work else None, contract(settings, tokenizer, files))
    commits.check_order([s.id for s in settings.sources])
    taken: DataFrame | None = None
    for source in settings.sources:
        targets = {s: settings.target(source.id, s) for s in ("train", "val")}
        filled = dict.fromkeys(targets, 0)
        steps = list(_steps(spark, settings, source, documents, files, files_per_step))
        finished = commits.done(source.id)
        for i, docs in enumerate(steps):
            if all(filled[s] >= targets[s] for s in targets):
                break
            if i < len(finished):
                got = spark.read.parquet(finished[i]["path"])
                if (check := fingerprint_of(got)[1]) != finished[i]["check"]:
                    raise ValueError(f"step {i} of {source.id} is not what was committed: {check}, {finished[i]['check']}")
                filled = finished[i]["filled"]
            else:
                rows = accept(candidates(docs(), tokenizer, mark), targets, taken, filled).withColumn("source_id", F.lit(source.id))
                if work:
                    path = f"{work}/accepted/{source.id}-{i:05d}"
                    rows.write.mode("overwrite").parquet(path)
                    got = spark.read.schema(rows.schema).parquet(path)
                else:
                    path, got = "", cut(rows)
                sums, check = fingerprint_of(got)
                filled = {s: filled[s] + sums.get(s, 0) for s in targets}
                commits.add({"source": source.id, "step": i, "path": path, "filled": filled, "check": check})
            taken = got if taken is None else taken.unionByName(got)
        if short := [s for s in targets if filled[s] < targets[s]]:
            raise ValueError(f"source {source.id} ended before its token budget for {short}: {filled} of {targets}")
    assert taken is not None
    return taken


def fingerprint_of(accepted: DataFrame) -> tuple[dict[str, int], str]:
    """Tokens by split, and a text that changes with any row's digest or span; order doesn't matter."""
    row = F.xxhash64("split", "dedup_hash", "start_token", "end_token").cast("decimal(38,0)")
    found = accepted.groupBy("split").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.sum(row).cast("string").alias("hashes")).collect()  # a row for each split
    return {r["split"]: r["tokens"] or 0 for r in found}, " ".join(f"{r['split']}:{r['documents']}:{r['hashes']}" for r in sorted(found))


def source_ledger(accepted: DataFrame, sources: Sequence[str]) -> DataFrame:
    """A row for each source: its documents, where its digests begin and end among all, and a sum over them."""
    order = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("source_id"))
    totals = accepted.groupBy("source_id").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.xxhash64("dedup_hash").cast("decimal(38,0)")).cast("string").alias("digests"))
    ends = F.sum("documents").over(Window.orderBy(order))  # a row for each source
    return totals.select("source_id", "documents", (ends - F.col("documents")).alias("start"), ends.alias("end"), "digests")


def verify_sources(accepted: DataFrame, ledger: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Sources whose digests are not those of the ledger, or don't follow the source before; with the problem."""
    now = source_ledger(accepted, sources).select("source_id", *[F.col(c).alias(f"_{c}") for c in ("documents", "start", "digests")])
    joined = ledger.join(now, "source_id", "full")
    problem = (
        F.when(F.col("documents").isNull(), "unlisted").when(F.col("_documents").isNull(), "missing").when(F.col("end") - F.col("start") != F.col("documents"), "length")
        .when(F.col("_documents") != F.col("documents"), "documents").when(F.col("_digests") != F.col("digests"), "digests").when(F.col("_start") != F.col("start"), "gap")
    )
    return joined.select("source_id", problem.alias("problem")).where(F.col("problem").isNotNull())


def load_manifest(path: str | Path) -> dict[str, Any]:
    """Read and check a finished build's manifest."""
    m = read_json(path)
    check_manifest(m)
    return m


def _steps(spark: SparkSession, settings: PrepSettings, source: Source, documents, files, size: int) -> Iterator[Callable[[], DataFrame]]:
    if documents and source.id in documents:
        yield lambda: documents[source.id]
        return
    listed: FileList = files[source.id]
    for a in range(0, len(listed.paths), size):
        part = FileList(listed.paths[a : a + size], listed.sha256, listed.revision)

        def read(part: FileList = part, a: int = a) -> DataFrame:
            return scan(spark, source, part, settings.min_chars, settings.max_chars).withColumn("file_ord", F.col("file_ord") + a)

        yield read


def document_index(accepted: DataFrame) -> DataFrame:
    """The index: identities, spans, and metadata with file and row put in."""
    place = F.create_map(F.lit("file"), F.col("file"), F.lit("row"), F.col("row").cast("string"))
    others = F.map_filter("metadata", lambda k, _: ~k.isin("file", "row"))
    merged = F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(others, place))))
    return accepted.select(
        "source_id", "split", "start_token", "end_token", "content_hash", F.lower(F.hex("dedup_hash")).alias("dedup_hash"), "score", merged.alias("metadata")
    )


def token_runs(accepted: DataFrame, tokenizer: Any) -> DataFrame:
    """Token ids of accepted documents with their places; ids are checked to fit 16 bits."""
    ids = accepted.select("source_id", "split", "file_ord", "row", "start_token", "end_token", token_ids(F.col("content"), tokenizer).alias("tokens"))
    fits = F.forall("tokens", lambda t: (t >= 0) & (t <= 65_535))
    return ids.withColumn("tokens", F.when(fits, F.col("tokens")).otherwise(F.raise_error(F.lit("a token id does not fit 16 bits")).cast("array<int>")))


def export_shards(accepted: DataFrame, tokenizer: Any, shard_tokens: int, folder: str, by_file: bool = True) -> DataFrame:
    """Write little-endian 16-bit shard files below ``folder`` (shared by all executors); their paths, sizes and hashes.

    One task writes one shard, whose size is a setting.
    """
    runs = token_runs(accepted, tokenizer)
    keys = ["source_id", "split", "file_ord", "row"]
    parts = shard_segments(accepted, shard_tokens, by_file).select(*keys, "shard", "from_token", "to_token")
    pieces = runs.join(parts, keys).select(
        "source_id", "split", "shard", "from_token",
        F.slice("tokens", (F.col("from_token") - F.col("start_token") + 1).cast("int"), (F.col("to_token") - F.col("from_token")).cast("int")).alias("tokens"),
    )

    def write(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("from_token")
        source, split, shard = part["source_id"].iloc[0], part["split"].iloc[0], int(part["shard"].iloc[0])
        data = np.concatenate([np.asarray(t) for t in part["tokens"]]).astype("<u2").tobytes()
        path = Path(folder) / source / split / f"{split}_{shard:05d}.bin"
        path.parent.mkdir(parents=True, exist_ok=True)
        staged = path.with_suffix(".tmp")
        staged.write_bytes(data)
        staged.replace(path)
        return pd.DataFrame({"source_id": [source], "split": [split], "shard": [shard], "path": [str(path.relative_to(folder))], "tokens": [len(data) // 2], "sha256": [hashlib.sha256(data).hexdigest()]})

    return pieces.groupBy("source_id", "split", "shard").applyInPandas(write, "source_id string, split string, shard int, path string, tokens long, sha256 string")


def manifest(settings: PrepSettings, tokenizer: Any, accepted: DataFrame, shards: DataFrame | None = None) -> dict[str, Any]:
    """The dataset's description, from two small aggregates."""
    totals = {(r["source_id"], r["split"]): r for r in split_totals(accepted).collect()}
    table = shards if shards is not None else shard_table(shard_segments(accepted, settings.shard_tokens, False)).withColumns({"path": F.lit(None).cast("string"), "sha256": F.lit(None).cast("string")})
    listed: dict[tuple[str, str], list] = {}
    for r in table.orderBy("source_id", "split", "shard").collect():  # a row for each shard
        listed.setdefault((r["source_id"], r["split"]), []).append({"path": r["path"], "tokens": r["tokens"], "sha256": r["sha256"]})
    sources, sums = [], {s: {"requested_tokens": 0, "tokens": 0, "documents": 0} for s in ("train", "val")}
    for source in settings.sources:
        splits = {}
        for split in sums:
            row, target = totals[source.id, split], settings.target(source.id, split)
            asked = settings.quotas[source.id] if split == "train" else settings.validation_tokens
            splits[split] = {
                "requested_tokens": asked, "preparation_target_tokens": target, "tokens": row["tokens"], "documents": row["documents"],
                "reserve_tokens": target - asked, "overshoot_tokens": row["tokens"] - target, "shards": listed[source.id, split],
            }
            for k, v in (("requested_tokens", asked), ("tokens", row["tokens"]), ("documents", row["documents"])):
                sums[split][k] += v
        sources.append({"id": source.id, "repo": source.repo, "revision": source.revision, "tree_path": source.tree_path, "documents": sum(s["documents"] for s in splits.values()), "splits": splits})
    return {
        "format": "packed-tokens", "format_version": 3, "dtype": "<u2", "requested_train_tokens": settings.requested, "validation_tokens_per_source": settings.validation_tokens,
        "mixture": {"phases": [{"end_tokens": p.end, "weights": dict(p.weights)} for p in settings.phases], "source_quotas": settings.quotas},
        "dedup": DEDUP_POLICY | {"accepted_hashes": sum(s["documents"] for s in sources), "collision_policy": "equal digests are duplicates"},
        "tokenizer": {"fingerprint": tokenizer.fingerprint(), "vocab_size": tokenizer.vocab_size, "bos_token_id": tokenizer.bos_id, "eos_token_id": tokenizer.eos_id},
        "documents": sum(s["documents"] for s in sources), "sources": sources, "splits": sums,
    }


def check_manifest(m: Mapping[str, Any]) -> None:
    """Raise unless the manifest's parts add up."""
    from ..config import parse_phases, quotas

    if m.get("format_version") != 3:
        raise ValueError("not a manifest of version 3")
    want = quotas(parse_phases([s["id"] for s in m["sources"]], m["mixture"], m["requested_train_tokens"]))
    wrong = [] if want == m["mixture"]["source_quotas"] else ["quotas"]
    for s in m["sources"]:
        for split, x in s["splits"].items():
            if sum(h["tokens"] for h in x["shards"]) != x["tokens"]:
                wrong.append(f"shards of {s['id']} {split}")
            if x["tokens"] < x["preparation_target_tokens"]:
                wrong.append(f"tokens of {s['id']} {split}")
    for split, x in m["splits"].items():
        if any(x[k] != sum(s["splits"][split][k] for s in m["sources"]) for k in x):
            wrong.append(f"totals of {split}")
    if m["documents"] != sum(s["documents"] for s in m["sources"]):
        wrong.append("documents")
    if wrong:
        raise ValueError(f"the manifest doesn't add up: {wrong}")


def verify_shards(spark: SparkSession, m: Mapping[str, Any], folder: str) -> DataFrame:
    """Shards whose file is missing, or has another size or hash than the manifest says."""
    rows = [(h["path"], h["tokens"] * 2, h["sha256"]) for s in m["sources"] for x in s["splits"].values() for h in x["shards"]]
    want = spark.createDataFrame(rows, "path string, bytes long, sha256 string")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.bin").load(folder)
    short = F.regexp_extract("path", r"([^/]+/[^/]+/[^/]+)$", 1)
    have = found.select(short.alias("path"), F.col("length").alias("has"), F.sha2("content", 256).alias("now"))
    joined = want.join(have, "path", "left")
    state = F.when(F.col("has").isNull(), "missing").when(F.col("has") != F.col("bytes"), "size").when(F.col("now") != F.col("sha256"), "hash")
    return joined.select("path", state.alias("problem")).where(F.col("problem").isNotNull())


def journal(accepted: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Digests of accepted documents in order of acceptance; a repeated one raises."""
    order = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("source_id"))
    many = accepted.groupBy("dedup_hash").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct(order.alias("source"), "file_ord", "row")).alias("at"))
    once = F.when(F.col("k") == 1, F.col("dedup_hash")).otherwise(F.raise_error(F.lit("a digest was accepted twice")).cast("binary"))
    return many.select("at.*", once.alias("dedup_hash"))


def save_manifest(m: Mapping[str, Any], staging: str | Path, target: str | Path) -> None:
    """Check, write and publish a finished build."""
    check_manifest(m)
    write_json(Path(staging) / "manifest.json", m)
    publish(staging, target)


def file_hashes(folder: str | Path) -> dict[str, str]:
    return {str(p.relative_to(folder)): sha256_file(p) for p in sorted(Path(folder).rglob("*")) if p.is_file()}
