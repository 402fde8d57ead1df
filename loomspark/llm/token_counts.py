"""Exact token counts of every prefix of a text, by dynamic programming.

A byte-level BPE splits a text into pieces that it encodes alone, so counts add up
over pieces: a text's table is the running sum over its chunks (a run of white space
and the word after it).  Within a piece the encoding of a prefix is the encoding of a
shorter prefix followed by one token: the only one that the merges keep apart from the
token before it.  So ``last[i]`` and ``count[i] = count[i - len(last[i])] + 1`` fill a
table over all byte prefixes of the piece without encoding any of them.  Every count,
of a whole piece, chunk or text too, is read from these tables, which are made once for
each distinct piece while a worker's cache holds it.

``PrefixTable`` answers: tokens in all, tokens in the first i characters, longest
prefix within a budget.  ``answers`` applies it to a table of documents.

Cases: null counts as empty, with no tokens; an empty table gives an empty result; extra
columns are not read; special strings in a text are one
token, as the library has it; very long words are cut into pieces by the
tokenizer's own splitter, and their tables are not kept; repeated rows repeat.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tokens import as_bytes, load, special_pattern, trim

ANSWERS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, chars_within_limit long"
#: A chunk ends where a space or line end follows something that is surely no white space.
_CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: Chunks of these characters alone are split here; others by the tokenizer.
_PLAIN = re.compile("[ \n!-~À-ÖØ-öø-ÿ]+")
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^ \n{_LETTER}0-9]+|[ \n]+(?![^ \n])|[ \n]+")
_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_UNSURE = re.compile(r"[^\S \n][ \n]")
#: Bytes at the start of a piece whose table is shared with other pieces.
_HEAD = 6


class Merges:
    """Which tokens can stand next to each other in an encoding, from the merge list alone.

    Two tokens stay apart if no merge that could have joined characters across their
    border comes before the merges that made them.  Ids of made tokens are in the order
    of the merges, so only the parts along the border have to be looked at.
    """

    def __init__(self, tokenizer):
        model = json.loads(tokenizer.to_str())["model"]
        vocab = model["vocab"]
        self._made: dict[tuple[int, int], int] = {}
        self._parts = {i: (i, i) for i in vocab.values()}
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair, made = (vocab[left], vocab[right]), vocab[left + right]
            self._made[pair] = made
            if self._parts[made] == (made, made):
                self._parts[made] = pair
        #: All tokens backwards, character by character; "" holds the id where one begins.
        self.tails: dict = {}
        for word, i in vocab.items():
            if len(tokenizer.model.tokenize(word)) == 1:  # others are never made
                node = self.tails
                for c in reversed(word):
                    node = node.setdefault(c, {})
                node[""] = i

    def apart(self, a: int, b: int) -> bool:
        """Whether ``a`` and ``b`` in a row are the encoding of their characters."""
        made, parts, before = self._made.get, self._parts, 1 << 32
        while True:
            joined = made((a, b))
            if joined is not None and joined < before:
                return False
            inner_a, inner_b = parts[a][1], parts[b][0]
            # The younger of both is taken apart; what it was made of met the other one before that.
            if a > b and inner_a != a or inner_b == b:
                if inner_a == a:
                    return True
                a, before = inner_a, a
            else:
                b, before = inner_b, b + 1


class Prefixes:
    """Prefix counts for pieces, chunks and texts of one tokenizer; one for each worker."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self._split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self._merges = Merges(self.tokenizer)
        self._special = special_pattern(self.tokenizer)
        self._pieces: dict[str, list[int]] = {}
        self._heads: dict[str, tuple[list[int], list[int]]] = {}
        self._apart: dict[int, bool] = {}
        self._whole: dict[str, int] = {}
        self._chunks: dict[str, int] = {}

    def piece(self, piece: str) -> list[int]:
        """Counts for the first 0, 1, .. bytes of a piece, which has a character per byte."""
        known = self._pieces.get(piece)
        if known is not None:
            return known
        count, last, size = [0], [-1], len(piece)
        if size > _HEAD and (head := self._heads.get(piece[:_HEAD])):  # pieces that begin alike share that part
            count, last = head[0].copy(), head[1].copy()
        tails, apart, get = self._merges.tails, self._apart, self._apart.get
        for i in range(len(count), size + 1):
            node, k = tails, i
            while True:  # tokens that end here, the shortest first; one of them fits
                k -= 1
                node = node.get(piece[k]) if k >= 0 else None
                if node is None:
                    raise ValueError(f"the tokenizer can't encode {piece[:i]!r}")
                token = node.get("")
                if token is None:
                    continue
                if k:
                    pair = last[k] << 32 | token
                    fits = get(pair)
                    if fits is None:
                        fits = apart[pair] = self._merges.apart(last[k], token)
                    if not fits:
                        continue
                count.append(count[k] + 1)
                last.append(token)
                break
            if i == _HEAD < size:
                self._heads[piece[:_HEAD]] = count.copy(), last.copy()
        if size <= 32:
            for cache in (self._pieces, self._heads, self._apart):
                trim(cache)
            self._pieces[piece] = count
        return count

    def plain(self, piece: str) -> int:
        """Tokens of a piece as it stands in the text: the last entry of its table."""
        known = self._whole.get(piece)
        if known is None:
            trim(self._whole)
            known = self._whole[piece] = self.piece(as_bytes(piece))[-1]
        return known

    def chunk(self, chunk: str) -> int:
        """Tokens of a whole chunk."""
        known = self._chunks.get(chunk)
        if known is None:
            if _PLAIN.fullmatch(chunk):
                known = sum([self.plain(p) for p in _PIECES.findall(chunk)])
            else:
                known = sum([self.piece(p)[-1] for p, _ in self._split(chunk)])
            if len(chunk) <= 48:
                trim(self._chunks)
                self._chunks[chunk] = known
        return known

    def inside(self, chunk: str) -> list[int]:
        """Counts for the first 0, 1, .. characters of a chunk, each as the text that ends there would have it."""
        out, base = [0], 0
        for piece, (start, end) in self._split(chunk):
            table, whole = self.piece(piece), chunk[start:end]
            size = np.cumsum([len(c.encode()) for c in whole])
            for j in range(1, len(whole) + 1):
                parts = None if j == len(whole) or whole[:j].isalpha() else self._split(whole[:j])
                if parts is None or len(parts) == 1:
                    out.append(base + table[size[j - 1]])
                else:  # cut here, the splitter sees other pieces
                    out.append(base + sum(self.piece(p)[-1] for p, _ in parts))
            base += table[-1]
        for run in _SPACE.finditer(chunk):  # a run that ends the text is one piece
            parts, size = self._split(run.group()), 0
            if len(parts) == 1:
                table = self.piece(parts[0][0])
                for j, c in enumerate(run.group(), run.start() + 1):
                    size += len(c.encode())
                    out[j] = out[run.start()] + table[size]
        return out

    def chunks(self, text: str) -> list[str]:
        """The text in chunks whose encodings, one after the other, are the text's."""
        if self._special and "<" in text and self._special.search(text):
            return [c for part in self._special.split(text) if part for c in ([part] if self._special.fullmatch(part) else self.chunks(part))]
        if _UNSURE.search(text):
            return [text[s:e] for s, e in self._safe(text)]
        return _CHUNK.findall(text)

    def _safe(self, text: str) -> Iterator[tuple[int, int]]:
        start = 0
        for m in re.finditer(r"(?<=\S)(?=[ \n])", text):
            yield start, m.start()
            start = m.start()
        if start < len(text):
            yield start, len(text)

    def table(self, text: str) -> "PrefixTable":
        return PrefixTable(self, text)

    def special(self, chunk: str) -> bool:
        return bool(self._special and chunk[:1] == "<" and self._special.fullmatch(chunk))

    def totals(self, chunks: list[str]) -> list[int]:
        known = self._chunks
        get, made = known.get, self.chunk
        if self._special and any([c[0] == "<" and self.special(c) for c in chunks]):
            return [1 if self.special(c) else made(c) for c in chunks]
        return [made(c) if (got := get(c)) is None else got for c in chunks]


@functools.lru_cache(maxsize=4)
def prefixes_of(path: str) -> Prefixes:
    """One for each worker process, so that tables outlive a task."""
    return Prefixes(path)


class PrefixTable:
    """Answers for one text from its table alone."""

    def __init__(self, prefixes: Prefixes, text: str):
        self._p, self.text = prefixes, text
        self._chunks = prefixes.chunks(text)
        self.tokens = prefixes.totals(self._chunks)
        self.total = sum(self.tokens)

    def ends(self) -> list[int]:
        """Characters up to the end of each chunk."""
        return np.cumsum([len(c) for c in self._chunks], dtype=np.int64).tolist()

    def everywhere(self) -> list[int]:
        """Tokens of the first 1, 2, .. characters."""
        out, at, before = [], 0, 0
        for c, n in zip(self._chunks, self.tokens, strict=True):
            inner = [self.count_at(at + j) for j in range(1, len(c))] + [before + n] if self._p.special(c) else [before + m for m in self._p.inside(c)[1:]]
            out += inner
            at, before = at + len(c), before + n
        return out

    def _locate(self, chars: int) -> tuple[int, int, int]:
        """Chunk that holds the character before ``chars``, where it starts, tokens before it."""
        at = tokens = 0
        for k, c in enumerate(self._chunks):
            if at + len(c) >= chars:
                return k, at, tokens
            at += len(c)
            tokens += self.tokens[k]
        raise IndexError(chars)

    def count_at(self, chars: int) -> int:
        """Tokens of the text's first ``chars`` characters."""
        if not chars:
            return 0
        k, at, tokens = self._locate(chars)
        c = self._chunks[k]
        if chars == at + len(c):
            return tokens + self.tokens[k]
        if self._p.special(c):  # a part of a special string is ordinary text and may join what is before it
            return PrefixTable(self._p, self.text[:chars]).total
        return tokens + self._p.inside(c)[chars - at]

    def longest_within(self, budget: int) -> int:
        """Characters of the longest prefix that has at most ``budget`` tokens."""
        if self.total <= budget:
            return len(self.text)
        at = tokens = 0
        for c, n in zip(self._chunks, self.tokens, strict=True):
            if tokens + n > budget:
                inner = self._p.inside(c) if not self._p.special(c) else [0]
                return at + max(j for j, m in enumerate(inner) if tokens + m <= budget)
            at += len(c)
            tokens += n
        return at


def answers(docs: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, chars_within_limit for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = prefixes_of(tokenizer)
        for batch in batches:
            rows = []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py() or ""
                table = prefixes.table(text)
                rows.append((doc, len(text.encode()), table.total, table.total > limit, table.longest_within(limit)))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_tokens", "over_limit", "chars_within_limit"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, ANSWERS)


def prefix_tables(docs: DataFrame, tokenizer: str, every: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ends (characters) and counts (tokens) at every chunk end, or with ``every`` after every character: the stored table, for later budget questions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = prefixes_of(tokenizer)
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = prefixes.table(value.as_py() or "")
                ends, counts = (range(1, len(t.text) + 1), t.everywhere()) if every else (t.ends(), np.cumsum(t.tokens, dtype=np.int64).tolist())
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([list(ends)], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64()))], ["doc_id", "ends", "counts"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, ends array<long>, counts array<long>")
