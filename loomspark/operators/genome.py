"""Accounting of model configurations: parameters, state, FLOPs, as relational plans.

A configuration is a nested row: block groups with stages with parallel operations.
``executions`` unrolls it to a row for each executed operation; every figure is an
aggregate over that.  Parsing, checking and identity are driver-side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..config import digest

OPERATION = "struct<kind:string,head_dim:int,num_key_value_heads:int,scope:string,window_size:int,inner_size:int,kernel_size:int,intermediate_size:int>"
GENOME = (
    f"candidate_id string, blocks array<struct<block:struct<hidden_size:int,stages:array<struct<branches:array<{OPERATION}>>>>,repeat:int,weight_sharing:string>>, "
    "embedding_size int, vocab_size int, bos_token_id int, eos_token_id int, max_position_embeddings int, rope_theta double, rms_norm_eps double, initializer_range double, expected_parameters long"
)
#: Defaults of a configuration, and fields of each kind of operation.
DEFAULTS = {"vocab_size": 32_000, "bos_token_id": 1, "eos_token_id": 2, "max_position_embeddings": 4_096, "rope_theta": 10_000.0, "rms_norm_eps": 1e-5, "initializer_range": 0.02}
OPERATIONS = {"attention": ("head_dim", "num_key_value_heads", "scope", "window_size"), "gated_causal_conv": ("inner_size", "kernel_size"), "swiglu": ("intermediate_size",)}


def _need(ok: Any, what: str) -> None:
    if not ok:
        raise ValueError(what)


def _operation(raw: Mapping, width: int) -> dict[str, Any]:
    kind = raw.get("kind")
    _need(kind in OPERATIONS, f"unknown operation {kind!r}")
    _need(set(raw) <= {"kind", *OPERATIONS[kind]}, f"unknown fields of {kind}")
    op = {"kind": kind} | {k: raw.get(k) for k in OPERATIONS[kind]}
    if kind == "attention":
        op["scope"] = op["scope"] or "global"
        _need(op["head_dim"] >= 2 and op["head_dim"] % 2 == 0, "head_dim must be even and positive")
        _need(op["num_key_value_heads"] >= 1, "kv heads must be positive")
        _need(op["scope"] in ("global", "sliding"), "scope must be global or sliding")
        _need((op["window_size"] is not None and op["window_size"] >= 1) if op["scope"] == "sliding" else op["window_size"] is None, "only sliding attention has a window, and it needs one")
        _need(width % op["head_dim"] == 0, "the width must be a multiple of head_dim")
        _need(width // op["head_dim"] % op["num_key_value_heads"] == 0, "query heads must be a multiple of kv heads")
    elif kind == "swiglu":
        _need(op["intermediate_size"] >= 1, "intermediate_size must be positive")
    else:
        _need(op["inner_size"] >= 1 and op["kernel_size"] >= 2, "inner_size must be positive and kernel_size at least 2")
    return op


def parse(raw: Mapping[str, Any]) -> dict[str, Any]:
    """A checked configuration with all defaults filled in."""
    _need(set(raw) <= {"blocks", "embedding_size", "expected_parameters", *DEFAULTS}, "unknown settings of a configuration")
    _need(raw.get("blocks"), "a configuration needs blocks")
    groups = []
    for group in raw["blocks"]:
        width, stages, repeat = group["block"]["hidden_size"], group["block"]["stages"], group.get("repeat", 1)
        _need(width >= 1 and stages and repeat >= 1, "blocks need a width, stages and a positive repeat")
        _need(group.get("weight_sharing", "none") in ("none", "all"), "weight_sharing must be none or all")
        parsed = []
        for stage in stages:
            ops = [_operation(o, width) for o in stage["branches"]]
            _need(ops and len({o["kind"] for o in ops}) == len(ops), "a stage needs operations of different kinds")
            parsed.append({"branches": ops})
        groups.append({"block": {"hidden_size": width, "stages": parsed}, "repeat": repeat, "weight_sharing": group.get("weight_sharing", "none")})
    out = DEFAULTS | {k: raw[k] for k in DEFAULTS if k in raw} | {"blocks": groups, "embedding_size": raw["embedding_size"]}
    _need(min(out["embedding_size"], out["vocab_size"], out["max_position_embeddings"]) >= 1, "sizes must be positive")
    _need(min(out["rope_theta"], out["rms_norm_eps"], out["initializer_range"]) > 0, "scales must be positive")
    _need(all(0 <= out[k] < out["vocab_size"] for k in ("bos_token_id", "eos_token_id")), "special ids must be in the vocabulary")
    if raw.get("expected_parameters") is not None:
        _need(raw["expected_parameters"] >= 1, "expected_parameters must be positive")
        out["expected_parameters"] = raw["expected_parameters"]
    return out


def identity(config: Mapping[str, Any]) -> str:
    """Digest of what the configuration computes: one repeat shares nothing, and the expected size says nothing."""
    core = {k: v for k, v in parse(config).items() if k != "expected_parameters"}
    core["blocks"] = [g | {"weight_sharing": "none" if g["repeat"] == 1 else g["weight_sharing"]} for g in core["blocks"]]
    return digest(core)


def genome_table(spark: SparkSession, configs: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """One row for each configuration, by id."""
    return spark.createDataFrame([{"candidate_id": k, "expected_parameters": None} | parse(v) for k, v in configs.items()], GENOME)


def executed_blocks(genomes: DataFrame) -> DataFrame:
    """A row for each executed block: its place, width, the width before it, and whether its weights are new."""
    groups = genomes.select("candidate_id", "embedding_size", F.posexplode("blocks").alias("group", "g"))
    runs = groups.select("candidate_id", "embedding_size", "group", "g", F.explode(F.sequence(F.lit(0), F.col("g.repeat") - 1)).alias("repeat"))
    place = Window.partitionBy("candidate_id").orderBy("group", "repeat")  # one configuration
    shared = F.when(F.col("g.weight_sharing") == "all", 0).otherwise(F.col("repeat"))
    return runs.select(
        "candidate_id",
        (F.row_number().over(place) - 1).alias("occurrence"),
        "group",
        "repeat",
        F.format_string("group_%d_repeat_%d", F.col("group"), shared).alias("weight_key"),
        (shared == F.col("repeat")).alias("new_weights"),
        F.col("g.block.hidden_size").cast("long").alias("width"),
        F.lag("g.block.hidden_size").over(place).cast("long").alias("_before"),
        F.col("embedding_size").cast("long").alias("embedding"),
        F.col("g.block.stages").alias("stages"),
    ).withColumn("width_before", F.coalesce("_before", "embedding")).drop("_before")


def executions(genomes: DataFrame) -> DataFrame:
    """A row for each executed operation."""
    ops = F.explode(F.flatten(F.transform("stages", lambda s: s["branches"])))
    rows = executed_blocks(genomes).select("candidate_id", "occurrence", "weight_key", "new_weights", "width", ops.alias("op"))
    return rows.select("candidate_id", "occurrence", "weight_key", "new_weights", "width", "op.*")


def _linear() -> F.Column:
    """Matrix weights of an operation."""
    w, kv = F.col("width"), F.col("num_key_value_heads").cast("long") * F.col("head_dim")
    return (
        F.when(F.col("kind") == "attention", 2 * w * w + 2 * w * kv)
        .when(F.col("kind") == "gated_causal_conv", 4 * w * F.col("inner_size") + F.col("inner_size").cast("long") * F.col("kernel_size"))
        .otherwise(3 * w * F.col("intermediate_size"))
    )


def _context(length: int) -> F.Column:
    return F.when(F.col("scope") == "sliding", F.least(F.lit(length), F.col("window_size"))).otherwise(F.lit(length)).cast("long")


def state_bytes(length: int, batch: int = 1, element: int = 2) -> F.Column:
    """Decoding state of one operation at a length."""
    attention = F.lit(2 * batch * element).cast("long") * F.col("num_key_value_heads") * F.col("head_dim") * _context(length)
    convolution = F.lit(batch * element).cast("long") * F.col("inner_size") * (F.col("kernel_size") - 1)
    return F.when(F.col("kind") == "attention", attention).when(F.col("kind") == "gated_causal_conv", convolution).otherwise(F.lit(0).cast("long"))


def metrics(genomes: DataFrame, sequence_length: int, lengths: Sequence[int] = (512, 2048, 4096)) -> DataFrame:
    """Static figures of every configuration."""
    blocks, ops = executed_blocks(genomes), executions(genomes)
    adapters = F.sum(F.when(F.col("width_before") != F.col("width"), F.col("width_before") * F.col("width")).otherwise(0))
    per_model = blocks.groupBy("candidate_id").agg(
        adapters.alias("adapters"),
        F.max_by("width", "occurrence").alias("last_width"),
        F.count(F.lit(1)).alias("logical_depth"),
        F.countDistinct("weight_key").alias("unique_parameter_blocks"),
    )
    norm = F.col("width") + F.when(F.col("kind") == "attention", 2 * F.col("head_dim")).otherwise(0)
    per_ops = ops.groupBy("candidate_id").agg(
        F.sum(F.when(F.col("new_weights"), _linear() + norm).otherwise(0)).alias("op_parameters"),
        F.sum(_linear()).alias("linear"),
        F.sum(F.when(F.col("kind") == "attention", 12 * _context(sequence_length) * F.col("width")).otherwise(0)).alias("attention_flops"),
        *[F.sum(state_bytes(n)).alias(f"state_bytes_{n}") for n in lengths],
        *[F.count_if(F.col("kind") == k).alias(name) for k, name in (("attention", "attention"), ("gated_causal_conv", "convolution"), ("swiglu", "swiglu"))],
    )
    joined = genomes.select("candidate_id", F.col("embedding_size").cast("long").alias("e"), F.col("vocab_size").cast("long").alias("v"), "expected_parameters").join(per_model, "candidate_id").join(per_ops, "candidate_id")
    out = F.when(F.col("last_width") != F.col("e"), F.col("last_width") * F.col("e")).otherwise(0)
    fixed = F.col("v") * F.col("e") + F.col("adapters") + out
    parameters = fixed + F.col("op_parameters") + F.col("last_width")
    return joined.select(
        "candidate_id",
        parameters.alias("parameters"),
        (parameters * 4).alias("weight_bytes"),
        (6 * (fixed + F.col("linear")) + F.col("attention_flops")).alias("flops_per_token"),
        *[f"state_bytes_{n}" for n in lengths],
        "logical_depth",
        "unique_parameter_blocks",
        "attention",
        "convolution",
        "swiglu",
        F.coalesce(F.col("expected_parameters") == parameters, F.lit(True)).alias("as_expected"),
    )


def outside_space(genomes: DataFrame, space: Mapping[str, Any], sequence_length: int = 2048) -> DataFrame:
    """candidate_id and the rules of a search space that each configuration breaks."""

    def close(ratio: F.Column, values: Sequence[float]) -> F.Column:
        return F.greatest(F.lit(0), *[(F.abs(ratio - v) <= F.greatest(F.abs(ratio), F.lit(abs(v))) * 1e-9).cast("int") for v in values]) == 1

    sized = metrics(genomes, sequence_length).select("candidate_id", "parameters", "logical_depth")
    groups = genomes.select("candidate_id", "embedding_size", F.explode("blocks").alias("g"))
    kinds = F.transform("g.block.stages", lambda s: s["branches"][0]["kind"])
    shape = F.forall("g.block.stages", lambda s: F.size(s["branches"]) == 1) & (
        (F.size(kinds) == 1) | ((F.size(kinds) == 2) & (F.element_at(kinds, 1) != "swiglu") & (F.try_element_at(kinds, F.lit(2)) == "swiglu"))
    )
    repeat = F.col("g.repeat").isin(space["repeat_counts"]) & (F.col("g.weight_sharing") == F.when(F.col("g.repeat") > 1, "all").otherwise("none"))
    by_group = groups.groupBy("candidate_id").agg(
        F.min(F.col("embedding_size").isin(space["widths"])).alias("embedding"), F.min(F.col("g.block.hidden_size").isin(space["widths"])).alias("width"),
        F.min(repeat).alias("repetition"), F.min(shape).alias("block_shape"),
    )
    ratio = F.col("inner_size") / F.col("width")
    attention = F.col("head_dim").isin(space["head_dimensions"]) & F.col("num_key_value_heads").isin(space["kv_heads"]) & ((F.col("scope") == "global") | F.col("window_size").isin(space["sliding_windows"]))
    ok = (
        F.when(F.col("kind") == "attention", attention)
        .when(F.col("kind") == "swiglu", close(F.col("intermediate_size") / F.col("width"), space["swiglu_ratios"]))
        .otherwise(close(ratio, space["convolution_ratios"]) & F.col("kernel_size").isin(space["convolution_kernels"]))
    )
    by_op = executions(genomes).groupBy("candidate_id").agg(F.min(ok).alias("operation"))
    (d0, d1), (p0, p1) = space["logical_depth_bounds"], space["parameter_bounds"]
    rules = {"depth": F.col("logical_depth").between(d0, d1), "parameters": F.col("parameters").between(p0, p1)} | {k: F.col(k) for k in ("embedding", "width", "repetition", "block_shape", "operation")}
    broken = F.array_compact(F.array(*[F.when(~v, F.lit(k)) for k, v in rules.items()]))
    return sized.join(by_group, "candidate_id").join(by_op, "candidate_id").select("candidate_id", broken.alias("broken"))


def probabilities_ok(table: DataFrame, by: str, value: str) -> DataFrame:
    """Whether each table of probabilities is finite, not negative, and sums to 1."""
    p = F.col(value)
    good = F.min((p >= 0) & (p < float("inf")) & ~F.isnan(p))
    return table.groupBy(by).agg((good & (F.abs(F.sum(p) - 1) <= 1e-9)).alias("ok"))
