"""Text identity: normalisation, digests and the validation split.

NFKC and BLAKE2 are not among Spark's functions, so ``fingerprint`` is one Arrow UDF
that gives both digests in a single crossing.  ``normalize_native`` stays in the JVM
and equals it wherever NFKC changes nothing.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

#: Fixed value: what ``str.split`` takes for white space.
WHITESPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def normalize(text: str) -> str:
    """NFKC, lower case, single spaces."""
    return " ".join(unicodedata.normalize("NFKC", text).lower().split())


def dedup_digest(text: str) -> bytes:
    """BLAKE2b-128 of the normalised text."""
    return hashlib.blake2b(normalize(text).encode(), digest_size=16).digest()


def split_person(seed: int) -> bytes:
    return hashlib.sha256(str(seed).encode()).digest()[:16]


def in_validation(normalised: str, seed: int, fraction: float) -> bool:
    """Whether the text's 64-bit hash, as a fraction, lies below ``fraction``."""
    h = hashlib.blake2b(normalised.encode(), digest_size=8, person=split_person(seed)).digest()
    return int.from_bytes(h, "big") / 2**64 < fraction


def fingerprint(text: Column, seed: int, fraction: float) -> Column:
    """struct(dedup_hash binary(16), split 'val' or 'train'), one Python crossing for both."""
    person, bound = split_person(seed), fraction

    @F.pandas_udf("dedup_hash binary, split string")
    def digest(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            hashes, splits = [], []
            for value in part:
                raw = normalize(value).encode()
                hashes.append(hashlib.blake2b(raw, digest_size=16).digest())
                h = int.from_bytes(hashlib.blake2b(raw, digest_size=8, person=person).digest(), "big")
                splits.append("val" if h / 2**64 < bound else "train")
            yield pd.DataFrame({"dedup_hash": hashes, "split": splits})

    return digest(text)


def normalize_native(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), WHITESPACE, " "))


def fingerprint_native(text: Column, fraction: float) -> Column:
    """The same struct from SHA-256 of the natively normalised text: another split, but SQL."""
    norm = normalize_native(text)
    share = F.conv(F.substring(F.sha2(norm, 256), 1, 15), 16, 10).cast("long")
    return F.struct(
        F.unhex(F.substring(F.sha2(norm, 256), 1, 32)).alias("dedup_hash"),
        F.when(share < int(fraction * 16**15), F.lit("val")).otherwise(F.lit("train")).alias("split"),
    )


def content_digest(text: Column) -> Column:
    """SHA-256 of the raw text, in hex."""
    return F.sha2(text, 256)
