"""Tokenizers behind one protocol, and token counts and ids as columns.

A tokenizer has ``vocab_size``, ``bos_id``, ``eos_id``, ``fingerprint()`` and
``encode_batch(texts, bos, eos)``.  ``length`` may be given natively by
``length_column``; otherwise an Arrow UDF encodes in batches bounded by documents
and by characters, one tokenizer for each Python worker.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, functions as F

from ..config import MAX_BATCH_CHARS, MAX_BATCH_DOCUMENTS

MAX_VOCABULARY = 65_536


class ByteTokenizer:
    """A token for each UTF-8 byte: byte + 3, begin 1, end 2."""

    vocab_size, bos_id, eos_id = 32_000, 1, 2

    def fingerprint(self) -> str:
        return "bytes+3"

    def encode_batch(self, texts: Sequence[str], bos: bool = False, eos: bool = False) -> list[list[int]]:
        return [[1] * bos + [b + 3 for b in t.encode()] + [2] * eos for t in texts]

    @staticmethod
    def length_column(text: Column) -> Column:
        return (F.octet_length(text) + 2).cast("long")


class PieceTokenizer:
    """A sentencepiece model file, loaded where it is used."""

    def __init__(self, path: str, expected_fingerprint: str | None = None):
        self.path, self.expected = path, expected_fingerprint
        model = self._model()
        self.vocab_size, self.bos_id, self.eos_id = model.get_piece_size(), model.bos_id(), model.eos_id()
        if expected_fingerprint and self.fingerprint() != expected_fingerprint:
            raise ValueError("the tokenizer file is not the expected one")

    def _model(self):
        return _piece_model(self.path)

    def fingerprint(self) -> str:
        with open(self.path, "rb") as f:
            return hashlib.file_digest(f, "sha256").hexdigest()

    def encode_batch(self, texts: Sequence[str], bos: bool = False, eos: bool = False) -> list[list[int]]:
        return self._model().encode(list(texts), add_bos=bos, add_eos=eos, num_threads=1)


@functools.lru_cache(maxsize=4)
def _piece_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def check_vocabulary(tokenizer: Any) -> None:
    if tokenizer.vocab_size > MAX_VOCABULARY:
        raise ValueError(f"token ids must fit 16 bits; the vocabulary has {tokenizer.vocab_size}")


def batches(texts: Sequence[str], documents: int = MAX_BATCH_DOCUMENTS, chars: int = MAX_BATCH_CHARS) -> Iterator[Sequence[str]]:
    """Consecutive runs of texts within both bounds; a longer text is a run of its own."""
    start = held = 0
    for i, text in enumerate(texts):
        if i > start and (i - start == documents or held + len(text) > chars):
            yield texts[start:i]
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield texts[start:]


def _encoder(tokenizer: Any, of: Callable[[list[int]], Any], returns: str):
    @F.pandas_udf(returns)
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out: list = []
            for run in batches(list(part)):
                ids = tokenizer.encode_batch(run, bos=True, eos=True)
                if len(ids) != len(run):
                    raise ValueError("the tokenizer lost documents")
                out += [of(x) for x in ids]
            yield pd.Series(out)

    return encode


def token_count(text: Column, tokenizer: Any) -> Column:
    if hasattr(tokenizer, "length_column"):
        return tokenizer.length_column(text)
    return _encoder(tokenizer, len, "long")(text)


def token_ids(text: Column, tokenizer: Any) -> Column:
    return _encoder(tokenizer, list, "array<int>")(text)
