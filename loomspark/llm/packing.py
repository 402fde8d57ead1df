"""Packing by non-negative least squares over the histogram of piece lengths.

1. Every document is tokenised once, in place, and cut into windows of
   ``width`` tokens and a rest.  A row per piece is written, with no tokens in it.
2. The lengths, rounded up to ``grain`` tokens, make a histogram whose size does
   not depend on the corpus.  Shallow combinations of at most three lengths that
   fill a window exactly are enumerated; non-negative least squares finds how
   often to use each; the counts are rounded down, and what they leave is packed
   greedily, largest length first, by whole runs of equal windows.
3. A piece's place follows from its rank among the pieces of its length.  Ranks
   come from per-task counters plus a running sum over tasks, so no length,
   however common, meets in one task.

Cases: a null or empty text is one piece holding the end id; long documents give
many pieces; repeated rows are packed as often as they occur; pieces of equal length
are alike to the plan and are told apart by task and place; columns besides id and text
are not read; an empty table packs into nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .scratch import Scratch
from .tokens import WordIds

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bin int, task int, rank long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, width: int, grain: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece, with its rank among the pieces of its bin in the same task."""
    end, bins = int(end_id).to_bytes(4, "little"), -(-width // grain)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, task = WordIds(tokenizer), [0] * (bins + 1), TaskContext.get().partitionId()
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = words.ids(text.as_py() or "") + end
                n = len(ids) // 4
                for start in range(0, n, width):
                    size = min(width, n - start)
                    b = -(-size // grain)
                    rows.append((doc, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), n, b, task, seen[b]))
                    seen[b] += 1
            if rows:
                made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64()], strict=True)]
                yield pa.RecordBatch.from_arrays(made, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin", "task", "rank"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(cut, PIECES)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """min |ax - b|, x >= 0, by active sets (Lawson and Hanson)."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    gain = a.T @ (b - a @ x)
    tol = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        if active.all() or gain[~active].max(initial=0) <= tol:
            break
        active[np.where(~active, gain, -np.inf).argmax()] = True
        while True:
            s = np.zeros(n)
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if s[active].min(initial=1) > 0:
                break
            bad = active & (s <= 0)
            step = (x[bad] / np.maximum(x[bad] - s[bad], 1e-300)).min()
            x = x + step * (s - x)
            active &= x > 1e-12
            x[~active] = 0
        x = s
        gain = a.T @ (b - a @ x)
    return x


def plan(histogram: dict[int, int], bins: int) -> list[tuple[dict[int, int], int]]:
    """[(lengths in one window -> how many, number of such windows)] using up the histogram."""
    left = {b: int(c) for b, c in histogram.items() if c > 0}
    made: list[tuple[dict[int, int], int]] = []

    def use(pattern: dict[int, int], times: int) -> None:
        times = min([times, *(left.get(b, 0) // m for b, m in pattern.items())])
        if times > 0:
            made.append((pattern, times))
            for b, m in pattern.items():
                left[b] -= m * times
                if not left[b]:
                    del left[b]

    have = sorted(left)
    combos = [(bins,)] if bins in left else []
    for i, x in enumerate(have):
        if bins - x >= x and bins - x in left:
            combos.append((x, bins - x))
        combos += [(x, y, bins - x - y) for y in have[i:] if bins - x - y >= y and bins - x - y in left]
    if combos:
        at = {b: i for i, b in enumerate(have)}
        a = np.zeros((len(have), len(combos)))
        for j, c in enumerate(combos):
            for b in c:
                a[at[b], j] += 1
        counts = np.array([left[b] for b in have], float)
        x = nnls(a, counts / counts.max()) * counts.max()
        for j in np.argsort(-x):
            if x[j] < 1:
                break
            use({b: combos[j].count(b) for b in set(combos[j])}, int(x[j]))
    while left:  # each turn uses up at least one length
        room, pattern = bins, {}
        for b in sorted(left, reverse=True):
            if m := min(left[b], room // b):
                pattern[b] = m
                room -= m * b
        use(pattern, min(left[b] // m for b, m in pattern.items()))
    return made


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    width: int = 4096,
    grain: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark: SparkSession = docs.sparkSession
    scratch, bins = Scratch(spark, "packing"), -(-width // grain)
    cut = scratch.save(pieces(docs, tokenizer, end_id, width, grain, id_col, text_col))
    per_task = scratch.save(cut.groupBy("task", "bin").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["bin"]: r["n"] for r in per_task.groupBy("bin").agg(F.sum("n").alias("n")).collect()}  # `bins` rows at most
    intervals, used, first = [], dict.fromkeys(histogram, 0), 0
    for pattern, times in plan(histogram, bins):
        slot = 0
        for b, m in sorted(pattern.items(), reverse=True):
            intervals.append((b, used[b], used[b] + m * times, first, m, slot))
            used[b] += m * times
            slot += m
        first += times
    places = spark.createDataFrame(intervals, "bin int, low long, high long, first long, per long, slot long")
    before = Window.partitionBy("bin").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("task", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["task", "bin"]).withColumn("r", F.col("base") + F.col("rank"))
    # At most a few intervals for each pattern, and fewer patterns than bins and combinations: a fixed bound.
    placed = ranked.join(F.broadcast(places), (ranked["bin"] == places["bin"]) & (F.col("r") >= F.col("low")) & (F.col("r") < F.col("high")))
    nth = F.col("r") - F.col("low")
    located = placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first") + F.floor(nth / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("slot") + nth % F.col("per")).alias("slot"),
    )
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return located.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long")).drop("slot")
