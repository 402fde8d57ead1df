"""Column helpers that several operators share."""

from __future__ import annotations

import string
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Most bits of the map that picks rows out of a scan (8 MB); more rows only pick more in vain.
_BITS = 1 << 26

#: The contracts' white space: space and the five ASCII controls from tab on.
ASCII_SPACE = r"[\x20\x09-\x0D]+"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone; other letters stay as they are."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, even if used inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_hash(text: Column) -> Column:
    """128 bits of a text; null counts as the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def bit_of(*columns: Column) -> Column:
    """The place of a value in the largest map of ``bits``; a smaller one takes places modulo its size."""
    return F.pmod(F.xxhash64(*columns), F.lit(_BITS)).cast("long")


def bits(places: Column, rows: DataFrame) -> np.ndarray:
    """A bit per place that ``rows`` have, packed into bytes: 128 to 256 bits for each, a power of two, ``_BITS`` at most."""
    set_bits = rows.select(places.alias("bit"))
    packed = set_bits.groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    table = packed.toArrow()  # at most _BITS / 64 rows
    words = table["bits"].to_numpy().view(np.uint64)
    n = int(np.bitwise_count(words).sum())
    out = np.zeros(min(_BITS // 64, 1 << (2 * n).bit_length()), np.uint64)
    np.bitwise_or.at(out, table["word"].to_numpy() % len(out), words)
    return out.view(np.uint8)


def is_set(found: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the places have their bit set."""
    at = at & (8 * len(found) - 1)
    return ((found[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def split_by_bits(rows: DataFrame, places: Column, found: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """The rows whose bit is not set, and those whose bit is; nothing is shuffled and no Python runs on executors.

    The map is a subquery of one row, so plans only refer to it and tasks get it once, as a value.
    """
    words = rows.sparkSession.createDataFrame(pa.table({"words": [found.view(np.int64)]})).scalar()
    at = places.bitwiseAND(8 * len(found) - 1)
    picked = F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), at.bitwiseAND(63).cast("int")) == 1
    return rows.where(~picked), rows.where(picked)


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows whose id (null is one, too) and text hash are in ``gone`` (id, h).

    A map of bounded size tells which rows can be; they alone, and not all texts, may be shuffled for the join.
    """
    found = bits(bit_of(F.col("id"), F.col("h")), gone)
    if not found.any():
        return docs
    stay, asked = split_by_bits(docs, bit_of(docs[id_col], text_hash(docs[text_col])), found)
    return stay.union(asked.join(gone, asked[id_col].eqNullSafe(gone["id"]) & (text_hash(asked[text_col]) == gone["h"]), "left_anti").select(*docs.columns))


def running_sums(lens: str) -> str:
    """SQL for the running sums of an int array: within blocks of 128, over blocks, and both together."""
    return (
        f"transform(array({lens}), lens -> transform(array(transform(sequence(0, size(lens) div 128), b -> aggregate(slice(lens, b * 128 + 1, 128), 0, (a, x) -> a + x))), "
        "sums -> transform(array(transform(sequence(0, size(sums) - 1), b -> aggregate(slice(sums, 1, b), 0, (a, x) -> a + x))), "
        "base -> transform(lens, (x, i) -> base[i div 128] + aggregate(slice(lens, (i div 128) * 128 + 1, i % 128 + 1), 0, (a, y) -> a + y)))[0])[0])[0]"
    )
