"""Language-model scoring with a hidden Markov model over words.

Counting.  Each task counts its words and sends a row per distinct word; the sums
give the unigram base exactly, and one more row per task counts its texts.  Words that
make up at least ``share`` of all training tokens travel to the tasks: at most
``1 / share`` words, whatever the corpus.  All other words stay in a table.

Training.  Texts become word numbers once, in a table.  Baum-Welch runs over all
whole training texts: each task sums expected counts and sends them in blocks, which
are added up in two levels.  Long texts are cut into segments that run side by side;
the matrix that carries a state distribution through a segment gives each one what it
would have got from its neighbours, so nothing is lost at the cuts.

Every word has emissions of its own.  Those of the words that travel change with each
pass.  All others share one emission in the first passes; the last one also sums the
expected counts of each of them, a table of words by states that grows with the
vocabulary.  With g(w, k) uses of word w in state k, c(w) in all and p(k) the share of
state k in all uses of such words (G, of ``kinds`` words), its part of their emission is

    e(w | k) = (h(w, k) + 1) / (G + kinds + 1),   h = (g(w, k) / p(k) + prior c(w)) / (1 + prior),

which adds up to 1 over all words and the unseen one, as the base does.

Scoring.  The scaled forward recursion runs over whole texts in the same way.  The
table of the other words is joined to the texts that hold them.

Cases: null and empty texts are the end token alone; repeated rows are scored (and
learned from) each; a null doc_id counts as training; without training texts every
token has the unseen probability; very long texts are whole, too, and may fill a group
of their own; ties in counts are broken by the word; columns besides id and text are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Scratch

_FLUSH = 300_000  # distinct words that a task's counter holds at most
_BLOCK = 8192  # numbers in one row of expected counts
_LANES = 256  # tasks whose blocks are added up first
_SEGMENT = 2048  # tokens of a text that run in one go
_GROUP = 1_000_000  # tokens that are looked at together, or one longer text


def held_out(ids: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(ids.cast("string")) % folds == fold, F.lit(False))


def words_of(text: str | None) -> list[bytes]:
    """Words, lower-cased in A-Z; bytes split at ASCII white space only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, c) over all texts; the row of the null word has the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes | None] = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "c"])
            counts.clear()
            return out

        for batch in batches:
            for value in batch.column(0):
                counts.update(words_of(value.as_py()))
                if len(counts) > _FLUSH:
                    yield rows()
            if batch.num_rows:
                counts[None] += batch.num_rows
        yield rows()

    return docs.select(text_col).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _pack(ids: np.ndarray) -> bytes:
    """32-bit numbers, compressed byte by byte: the upper ones are nearly all alike."""
    return zstandard.compress(np.ascontiguousarray(ids.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1) if len(ids) else b""


def _unpack(column: pa.BinaryArray) -> list[np.ndarray]:
    none = np.zeros(0, np.int32)
    raw = (zstandard.decompress(v.as_buffer()) if len(v.as_buffer()) else b"" for v in column)
    return [np.ascontiguousarray(np.frombuffer(r, np.uint8).reshape(4, -1).T).view("<i4").ravel() if r else none for r in raw]


def _rows(values: np.ndarray) -> pa.BinaryArray:
    """Each row's bytes."""
    size, raw = values.shape[1] * values.itemsize, np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(np.arange(0, size * len(values) + 1, size, dtype=np.int32)), pa.py_buffer(raw)])


def _short(values: np.ndarray) -> np.ndarray:
    """Rows of floats in 24 bits, rounded (by 2^-16 of them at most), their sign and exponent first."""
    bits = (np.ascontiguousarray(values, np.float32).view(np.uint32) + 0x80).astype(">u4")
    n, k = bits.shape
    return np.ascontiguousarray(bits.view(np.uint8).reshape(n, k, 4)[:, :, :3]).reshape(n, 3 * k)


def _long(raw: np.ndarray) -> np.ndarray:
    """What ``_short`` has packed."""
    n, k = len(raw), raw.shape[1] // 3
    wide = np.zeros((n, k, 4), np.uint8)
    wide[:, :, :3] = raw.reshape(n, k, 3)
    return wide.reshape(n, 4 * k).view(">f4").astype(np.float32)


def number_words(docs: DataFrame, words: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, held, ids, tail, tail_n): numbers of known words; -1 - j stands for the text's other word j, of tail."""
    known = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for batch in batches:
            lists, tails, tail_n, sizes = [], [], [np.zeros(0, np.int64)], [0]
            for value in batch.column(3):
                said = words_of(value.as_py())
                ids = np.fromiter(map(get, said, repeat(-1)), np.int32, len(said))
                rare: dict[bytes, int] = {}
                at = np.flatnonzero(ids < 0)
                if len(at):
                    ids[at] = [-1 - rare.setdefault(said[i], len(rare)) for i in at.tolist()]
                lists.append(_pack(ids))
                tails.extend(rare)
                tail_n.append(np.bincount(-1 - ids[at], minlength=len(rare)))
                sizes.append(len(rare))
            if lists:
                offsets = pa.array(np.cumsum(sizes), pa.int32())
                made = [pa.array(lists, pa.binary()), *(pa.ListArray.from_arrays(offsets, x) for x in (pa.array(tails, pa.binary()), pa.array(np.concatenate(tail_n), pa.int64())))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], ["rid", "doc_id", "held", "ids", "tail", "tail_n"])

    named = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held"), F.col(text_col))
    return named.mapInArrow(run, "rid long, doc_id long, held boolean, ids binary, tail array<binary>, tail_n array<long>")


@dataclass
class Hmm:
    """start (K), move (K, K) and emit (V + 2, K): words, the others in all (V), the end (V + 1)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @property
    def words(self) -> int:
        return len(self.emit) - 2

    def symbols(self, ids: np.ndarray) -> np.ndarray:
        """The text's rows of ``emit``, with its end."""
        return np.append(np.where(ids < 0, self.words, ids), self.words + 1)


def first_model(unigram: np.ndarray, states: int, seed: int = 7) -> Hmm:
    """Unigram emissions with noise, and states that last."""
    rng = np.random.default_rng(seed)
    emit = unigram[:, None] * np.exp(rng.normal(0, 1, (len(unigram), states)))
    emit /= emit.sum(0)
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Hmm(np.full(states, 1 / states), move, emit)


class Sweep:
    """Forward and backward through several texts, one token of each segment at a time, the longest first.

    ``texts`` hold rows of ``table`` (emissions).  By segment, ``first`` tells which begin
    a text, and ``before`` where the one before it is.
    """

    def __init__(self, model: Hmm, texts: list[np.ndarray], table: np.ndarray, segment: int = _SEGMENT):
        self.start, self.move, self.table = model.start.astype(np.float32), model.move.astype(np.float32), np.ascontiguousarray(table, np.float32)
        sizes = np.array([len(x) for x in texts])
        parts = -(-sizes // segment)
        text = np.repeat(np.arange(len(texts)), parts)
        part = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        lens = np.minimum(segment, sizes[text] - part * segment)
        order = np.argsort(-lens, kind="stable")
        self.rank = np.empty(len(order), np.int64)  # where each segment, in the order of the texts, has gone
        self.rank[order] = np.arange(len(order))
        self.text, self.first, self.lens = text[order], part[order] == 0, lens[order]
        self.before = np.where(self.first, -1, self.rank[np.maximum(order - 1, 0)])
        self.active = np.searchsorted(-self.lens, -np.arange(int(self.lens[0])), side="left")  # segments longer than t
        self.off = np.concatenate([[0], np.cumsum(self.active)])
        row = np.repeat(self.rank, lens)
        t = np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens)
        self.place = self.off[t] + row  # of each token, in the order of the texts
        self.symbols = np.empty(len(row), np.int64)
        self.symbols[self.place] = np.concatenate(texts)
        self.ones = np.ones(len(self.start), np.float32)
        self._matrices()

    def _emitted(self, at: np.ndarray | slice) -> np.ndarray:
        return np.take(self.table, self.symbols[at], axis=0)

    def _matrices(self) -> None:
        """What each segment that continues a text makes of a distribution, up to a factor."""
        k, more = len(self.start), np.flatnonzero(~self.first)
        self.where = np.full(len(self.first), -1)
        self.where[more] = np.arange(len(more))
        x, lens = np.tile(np.eye(k, dtype=np.float32), (len(more), 1, 1)), self.lens[more]
        for t in range(int(lens[0]) if len(more) else 0):
            n = int(np.searchsorted(-lens, -t, side="left"))
            now = x[:n] if t == 0 else (x[:n].reshape(n * k, k) @ self.move).reshape(n, k, k)
            now = now * self._emitted(self.off[t] + more[:n])[:, None, :]
            x[:n] = now / (now.reshape(n, k * k).sum(1) + 1e-30)[:, None, None]
        self.matrix = x

    def _run(self, enter: np.ndarray, rows: np.ndarray) -> None:
        """Forward through the segments at ``rows``, each from its row of ``enter``."""
        lens, now, whole = self.lens[rows], enter, len(rows) == len(self.lens)
        for t in range(int(lens[0]) if len(rows) else 0):
            n, at = int(np.searchsorted(-lens, -t, side="left")), self.off[t]
            here = slice(at, at + n) if whole else at + rows[:n]
            now = (now[:n] if t == 0 else now[:n] @ self.move) * self._emitted(here)
            scale = now @ self.ones + np.float32(1e-30)
            now /= scale[:, None]
            self.alpha[here], self.scale[here] = now, scale

    def forward(self, each: bool = True) -> np.ndarray:
        """Fills ``alpha`` and ``scale``, a row per token; returns the natural log-likelihood of each text, or of all together."""
        self.alpha, self.scale = np.empty((len(self.symbols), len(self.start)), np.float32), np.empty(len(self.symbols), np.float32)
        self.ends = self.off[self.lens - 1] + np.arange(len(self.lens))
        firsts, more = np.flatnonzero(self.first), np.flatnonzero(~self.first)
        self._run(np.tile(self.start, (len(firsts), 1)), firsts)
        enter, end = np.zeros((len(self.lens), len(self.start)), np.float32), {}
        for s in self.rank[np.flatnonzero(~self.first[self.rank])].tolist():  # a text's segments in turn
            b = int(self.before[s])
            enter[s] = (self.alpha[self.ends[b]] if self.first[b] else end[b]) @ self.move
            end[s] = enter[s] @ self.matrix[self.where[s]]
            end[s] /= end[s].sum() + 1e-30
        self._run(enter[more], more)
        if not each:  # in any order of the tokens
            return np.log(self.scale, dtype=np.float64).sum(keepdims=True)
        logs, sizes = np.log(self.scale[self.place], dtype=np.float64), np.bincount(self.text, self.lens).astype(np.int64)
        return np.add.reduceat(logs, np.cumsum(sizes) - sizes)

    def backward(self) -> np.ndarray:
        """Turns ``alpha`` into the tokens' state probabilities; returns the expected moves."""
        k = len(self.start)
        ends = self.ends
        leave = np.ones((len(self.lens), k), np.float32)
        for s in self.rank[::-1][np.flatnonzero(~self.first[self.rank[::-1]])]:  # from the last segment of each text
            got = self.move @ (self.matrix[self.where[s]] @ leave[s])
            b = self.before[s]
            leave[b] = got / (self.alpha[ends[b]] @ got + 1e-30)
        crossing = self.alpha[ends[self.before[~self.first]]]
        pairs, beta, there = np.zeros((k, k)), leave[:0], leave[:0]
        back = np.ascontiguousarray(self.move.T)
        for t in range(len(self.active) - 1, -1, -1):
            at, n, m = self.off[t], int(self.active[t]), len(there)
            alpha = self.alpha[at : at + n]
            if m:
                pairs += alpha[:m].T @ there
            beta = np.concatenate([there @ back, leave[m:n]])
            there = self._emitted(slice(at, at + n)) * beta
            there /= self.scale[at : at + n, None]
            alpha *= beta
        pairs += crossing.T @ there[~self.first]
        return pairs * self.move


def expected_counts(model: Hmm, texts: list[np.ndarray], segment: int = _SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, Sweep]:
    """Baum-Welch counts of whole texts (rows of ``emit``): start, move, emit, the log-likelihood, and the sweep with the tokens' state probabilities."""
    sweep = Sweep(model, texts, model.emit, segment)
    total = float(sweep.forward(each=False)[0])
    pairs = sweep.backward()
    emit = np.stack([np.bincount(sweep.symbols, sweep.alpha[:, j], len(model.emit)) for j in range(len(model.start))], axis=1)
    return sweep.alpha[: len(sweep.first)][sweep.first].sum(0, dtype=np.float64), pairs, emit, total, sweep


def _groups(lists: list[np.ndarray], most: int = _GROUP) -> Iterator[np.ndarray]:
    """Places of texts of similar lengths with at most ``most`` tokens, or one text that has more."""
    held, tokens = [], 0
    for i in np.argsort([-len(x) for x in lists], kind="stable"):
        if held and tokens + len(lists[i]) + 1 > most:
            yield np.array(held)
            held, tokens = [], 0
        held.append(i)
        tokens += len(lists[i]) + 1
    if held:
        yield np.array(held)


def _sum_blocks(sent: DataFrame) -> DataFrame:
    """(block, v) from (block, task, v): added up by lanes of tasks, then over lanes, in a fixed order."""

    def add(kind: type) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, total = None, None

            def row() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "task", "v"])

            for batch in batches:
                for b, lane, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    part = np.frombuffer(v.as_buffer(), kind).astype(np.float64)
                    if (b, lane) == key:
                        total += part
                        continue
                    if key is not None:
                        yield row()
                    key, total = (b, lane), part
            if key is not None:
                yield row()

        return run

    schema = "block int, task int, v binary"
    lanes = sent.withColumn("lane", F.expr(f"task div {_LANES}").cast("int")).repartition("block", "lane").sortWithinPartitions("block", "lane", "task")
    first = lanes.select("block", "lane", "v").mapInArrow(add(np.float32), schema)
    second = first.repartition("block").sortWithinPartitions("block", "task").select("block", F.lit(0).alias("lane"), "v")
    return second.mapInArrow(add(np.float64), schema).select("block", "v")


def e_step(numbered: DataFrame, model: Hmm, tail: bool = False, segment: int = _SEGMENT) -> DataFrame:
    """Expected counts of all training texts: rows (block, task, v), and with ``tail`` rows (word, n, g) of the words that don't travel."""
    shared, k = numbered.sparkSession.sparkContext.broadcast(model), len(model.start)
    width = k + k * k + len(model.emit) * k + 1
    names = ["block", "task", "v", "word", "n", "g"]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]

    def rows(*columns: object) -> pa.RecordBatch:
        size = max(len(c) for c in columns if c is not None)
        return pa.RecordBatch.from_arrays([pa.nulls(size, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, total = shared.value, np.zeros(width)
        for batch in batches:
            lists = _unpack(batch.column(0))
            words = batch.column(1).flatten().dictionary_encode() if tail else None
            if tail:
                codes, bases = words.indices.to_numpy(), np.concatenate([[0], np.cumsum(batch.column(1).value_lengths().to_numpy())])
                g = np.zeros((k, len(words.dictionary)))
            for held in _groups(lists):
                start, pairs, emit, ll, sweep = expected_counts(mine, [mine.symbols(lists[i]) for i in held], segment)
                total += np.concatenate([start, pairs.ravel(), emit.ravel(), [ll]])
                if tail:
                    said = np.concatenate([np.append(np.where(lists[i] < 0, bases[i] - 1 - lists[i], -1), -1) for i in held])
                    at = np.flatnonzero(said >= 0)
                    states, code = sweep.alpha[sweep.place[at]], codes[said[at]]
                    for j in range(k):
                        g[j] += np.bincount(code, states[:, j], g.shape[1])
            if tail and g.size:
                uses = np.zeros(g.shape[1], np.int64)
                np.add.at(uses, codes, batch.column(2).flatten().to_numpy())
                yield rows(None, None, None, words.dictionary, uses, _rows(g.T.astype(np.float32)))
        blocks, task = -(-width // _BLOCK), TaskContext.get().partitionId()
        yield rows(range(blocks), [task] * blocks, [total[b * _BLOCK : (b + 1) * _BLOCK].astype(np.float32).tobytes() for b in range(blocks)], None, None, None)

    return numbered.where(~F.col("held")).select("ids", "tail", "tail_n").mapInArrow(run, "block int, task int, v binary, word binary, n long, g binary")


def m_step(sent: DataFrame, model: Hmm, unigram: np.ndarray) -> tuple[Hmm, float, np.ndarray]:
    """The model that the counts give, the log-likelihood under the one before, and how often its states have words that don't travel."""
    k = len(model.start)
    summed = _sum_blocks(sent.where(F.col("block").isNotNull()).select("block", "task", "v")).toArrow()  # the size of one model
    parts = dict(zip(summed["block"].to_pylist(), summed["v"].to_pylist(), strict=True))
    got = np.concatenate([np.frombuffer(parts[b]) for b in sorted(parts)]) if parts else np.zeros(k + k * k + len(model.emit) * k + 1)
    start, pairs, used = got[:k] + 1, got[k : k + k * k].reshape(k, k) + 1, got[k + k * k : -1].reshape(-1, k)
    emit = used + 50 * unigram[:, None]
    return Hmm(start / start.sum(), pairs / pairs.sum(1, keepdims=True), emit / emit.sum(0)), float(got[-1]), used[model.words]


def emissions(sent: DataFrame, used: np.ndarray, below: float, prior: float) -> DataFrame:
    """(word, c, e): each other word's count, and its part of their emission in each state.

    Its rows meet in one task; it has less than ``share`` of all uses, so none is large.
    """
    k, state = len(used), (used + 1e-9) / (used + 1e-9).sum()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(words: pa.Array, n: np.ndarray, g: np.ndarray) -> pa.RecordBatch:
            e = ((g / state + prior * n[:, None]) / (1 + prior) + 1) / below
            return pa.RecordBatch.from_arrays([words, pa.array(n), _rows(_short(e))], ["word", "c", "e"])

        held: tuple[pa.Array, np.ndarray, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            words, n = batch.column(0), batch.column(1).to_numpy()
            g = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float32).reshape(-1, k).astype(np.float64)
            if held:
                words, n, g = pa.concat_arrays([held[0], words]), np.concatenate([held[1], n]), np.concatenate([held[2], g])
            starts = np.concatenate([[0], 1 + np.flatnonzero(pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False))])
            words, n, g = words.take(pa.array(starts)), np.add.reduceat(n, starts), np.add.reduceat(g, starts)
            if len(words) > 1:
                yield out(words[:-1], n[:-1], g[:-1])
            held = words[-1:], n[-1:], g[-1:]  # may go on in the next batch
        if held:
            yield out(*held)

    dealt = sent.where(F.col("word").isNotNull()).select("word", "n", "g").repartition("word").sortWithinPartitions("word")
    return dealt.mapInArrow(run, "word binary, c long, e binary")


def _scored(texts: DataFrame, model: Hmm, logs: np.ndarray, segment: int = _SEGMENT) -> DataFrame:
    """(doc_id, held, tail, n_words, hmm, in_top, top_log); ``tail_e`` has the emissions of the text's other words within their class, one after the other."""
    shared, k = texts.sparkSession.sparkContext.broadcast((model, logs)), len(model.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, log = shared.value
        for batch in batches:
            lists = _unpack(batch.column(3))
            if not lists:
                continue
            tails = [_long(np.frombuffer(b"".join(x.as_py()), np.uint8).reshape(-1, 3 * k + 4)[:, 4:]) for x in batch.column(4)]  # each after its place
            score = np.empty(len(lists))
            for held in _groups(lists):
                own = [tails[i] for i in held]
                bases = np.cumsum([len(mine.emit), *map(len, own)])
                table = np.vstack([mine.emit, *[mine.emit[mine.words] * x for x in own]])
                texts = [np.append(np.where(lists[i] < 0, b - 1 - lists[i], lists[i]), mine.words + 1) for i, b in zip(held, bases, strict=False)]
                score[held] = Sweep(mine, texts, table, segment).forward() / np.log(10)
            rows = [(len(x), len(top := x[x >= 0]), float(log[top].sum())) for x in lists]
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.float64()], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(score), *made], ["doc_id", "held", "tail", "hmm", "n_words", "in_top", "top_log"])

    schema = "doc_id long, held boolean, tail struct<log:double,known:long>, hmm double, n_words long, in_top long, top_log double"
    return texts.select("doc_id", "held", "tail", "ids", "tail_e").mapInArrow(run, schema)


def score(
    docs: DataFrame,
    states: int = 8,
    share: float = 1e-6,
    passes: int = 5,
    prior: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    scratch = Scratch(docs.sparkSession, "hmm")
    counted = scratch.save(word_counts(docs.where(~held_out(F.col(id_col))), text_col))
    counts = counted.where(F.col("word").isNotNull())
    is_word = F.col("word").isNotNull().cast("long")
    sums = counted.agg(F.coalesce(F.sum(is_word * F.col("c")), F.lit(0)).alias("n"), F.coalesce(F.sum(is_word), F.lit(0)).alias("v"), F.coalesce(F.sum((1 - is_word) * F.col("c")), F.lit(0)).alias("texts")).first()
    texts = sums["texts"]
    n, v = sums["n"] + texts, sums["v"] + (1 if texts else 0)  # the end is a token too
    many = F.col("c") >= F.lit(share * n)
    first = counts.where(many).toArrow().sort_by([("c", "descending"), ("word", "ascending")])  # 1 / share rows at most
    words, c = first["word"].to_pylist(), first["c"].to_numpy().astype(float)
    del first
    numbered = scratch.save(number_words(docs, words, id_col, text_col))
    rest, kinds = sums["n"] - c.sum(), sums["v"] - len(words)
    unigram = np.concatenate([c, [rest + 1, texts + 1]])
    unigram /= unigram.sum()
    model = first_model(unigram, states)
    scratch.drop(counted)
    for _ in range(passes - 1):
        model, *_ = m_step(e_step(numbered, model), model, unigram)
        scratch.tidy()
    last = scratch.save(e_step(numbered, model, tail=True))
    model, _, used = m_step(last, model, unigram)
    below = float(rest + kinds + 1)
    rare = scratch.save(emissions(last, used, below, prior))
    scratch.drop(last)
    scratch.tidy()
    spread = numbered.select("rid", F.posexplode(F.arrays_zip("tail", "tail_n")).alias("j", "x")).select("rid", "j", F.col("x.tail").alias("word"), F.col("x.tail_n").alias("k"))
    none = _short(np.full((1, states), 1 / below)).tobytes()
    place = F.to_binary(F.lpad(F.hex("j"), 8, "0"), F.lit("hex"))  # four bytes that sort as the number does
    per_text = spread.join(rare, "word", "left").groupBy("rid").agg(
        F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)).cast("double") + 1)).alias("tail_log"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("tail_known"),
        F.sort_array(F.collect_list(F.concat(place, F.coalesce("e", F.lit(none))))).alias("es"),  # of one text
    )
    wide = numbered.select("rid", "doc_id", "held", "ids").join(per_text, "rid", "left").select(
        "doc_id", "held", "ids",
        F.struct(F.coalesce("tail_log", F.lit(0.0)).alias("log"), F.coalesce("tail_known", F.lit(0).cast("long")).alias("known")).alias("tail"),
        F.coalesce("es", F.array().cast("array<binary>")).alias("tail_e"),
    )
    tokens = F.col("n_words") + 1
    return _scored(wide, model, np.log10(c + 1)).select(
        "doc_id",
        F.col("held").alias("held_out"),
        tokens.alias("n_tokens"),
        (F.col("in_top") + F.col("tail.known") + (1 if texts else 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("top_log") + F.col("tail.log") + float(np.log10(texts + 1)) - tokens * float(np.log10(n + v + 1))).alias("base_score"),
        F.col("hmm").alias("score"),
    )
