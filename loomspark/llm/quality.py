"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature, and every chosen pair of features, has a lookup table over bins of
its values; the tables' sum is the log-odds.  Tables are learned by cyclic
boosting: in turn, each one gets a small step of a shallow tree fitted to the
present residuals.  Pairs are chosen by how much of the residual a two-by-two
split of them explains.  Scoring a batch is one bin lookup and one addition for
each table.

Training takes at most ``max_rows`` labelled rows, those with the smallest
CRC-32 of a salted id: a documented bound, so training runs on the driver over a
matrix of ``max_rows`` by the number of features.  Scoring covers every row and
whole texts and needs no shuffle.

Cases: null and empty texts have all-zero features and get a score like any
other; labels that are null are not learned from; a document labelled more than
once counts with its largest label; without usable labels, or with one class
alone, the score is the smoothed share of that class; very long texts are read whole,
repeated rows are scored each; other columns, whatever their names, stay as they are;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

FEATURES = (
    "log_words", "log_bytes", "word_bytes", "upper", "lower", "digit", "space", "beyond_ascii", "stops", "marks", "symbols",
    "distinct_words", "top_word", "same_next", "log_line", "distinct_lines", "marked_words", "capital_words",
)
_CLASS = np.zeros(256, np.int64)
for _i in range(256):
    _c = chr(_i)
    _CLASS[_i] = (
        7 if _i > 127 else 1 if "A" <= _c <= "Z" else 2 if "a" <= _c <= "z" else 3 if _c.isdigit() else 4 if _c in " \t\n\r\x0b\x0c" else 5 if _c in ".," else 6 if _c in "!?;:'\"()-" else 0
    )


def features(text: str | None) -> list[float]:
    """Numbers about a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(raw)
    by_class = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8) / size
    kinds = Counter(words)
    lines = [x for x in raw.split(b"\n") if x]
    marked = capital = 0
    for word, k in kinds.items():
        last = word[-1]
        marked += k * (last < 48 and last not in b".,")
        capital += k * (len(word) > 1 and word.isupper())
    return [
        np.log1p(n), np.log1p(size), (size - n) / n, *by_class[[1, 2, 3, 4, 7, 5, 6, 0]],
        len(kinds) / n, max(kinds.values()) / n, sum(map(eq, words, words[1:])) / n,
        np.log1p(size / max(1, len(lines))), len(set(lines)) / max(1, len(lines)), marked / n, capital / n,
    ]


def matrix(texts: Iterator[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))


def _tree(weight: np.ndarray, grad: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """Values by bin of a tree with at most ``leaves`` leaves on one ordered feature."""
    out = np.zeros(len(weight))
    parts = [(0, len(weight))]
    w, g = np.concatenate([[0], np.cumsum(weight)]), np.concatenate([[0], np.cumsum(grad)])
    total = lambda a, b: (g[b] - g[a]) ** 2 / (w[b] - w[a] + 1e-9)
    while len(parts) < leaves:
        best = (1e-12, None)
        for k, (a, b) in enumerate(parts):
            cuts = np.arange(a + 1, b)
            cuts = cuts[(w[cuts] - w[a] >= least) & (w[b] - w[cuts] >= least)]
            if len(cuts):
                gain = (g[cuts] - g[a]) ** 2 / (w[cuts] - w[a] + 1e-9) + (g[b] - g[cuts]) ** 2 / (w[b] - w[cuts] + 1e-9) - total(a, b)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], (k, int(cuts[at])))
        if best[1] is None:
            break
        k, cut = best[1]
        a, b = parts.pop(k)
        parts += [(a, cut), (cut, b)]
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (w[b] - w[a] + 1e-9) if w[b] - w[a] > 0 else 0.0
    return out


@dataclass
class AdditiveModel:
    """Intercept, bin edges, a table for each feature and each pair."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    coarse: int = 8

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), int)

    def _coarse(self, bins: np.ndarray, j: int) -> np.ndarray:
        return bins[:, j] * self.coarse // (len(self.edges[j]) + 1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        bins, out = self.bins(x), np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            out += table[bins[:, j]]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[self._coarse(bins, i), self._coarse(bins, j)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 8, max_bins: int = 64, rate: float = 0.1) -> AdditiveModel:
    """Cyclic boosting of single tables, then of the most telling pairs."""
    share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    model = AdditiveModel(float(np.log(share / (1 - share))))
    if len(y) < 20 or y.min() == y.max():
        return model
    least = max(5.0, 0.002 * len(y)) / 4  # in units of p(1-p)
    for j in range(x.shape[1]):
        model.edges.append(np.unique(np.quantile(x[:, j], np.linspace(0, 1, max_bins + 1)[1:-1])))
    bins = model.bins(x)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    f = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            p = 1 / (1 + np.exp(-f))
            step = rate * _tree(np.bincount(bins[:, j], p * (1 - p) + 1e-6, len(table)), np.bincount(bins[:, j], y - p, len(table)), 3, min(least, 2.0))
            step = np.clip(step, -0.5, 0.5)
            table += step
            f += step[bins[:, j]]
    p = 1 / (1 + np.exp(-f))
    flat = [model._coarse(bins, j) for j in range(x.shape[1])]
    c, gains = model.coarse, []
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            cell = flat[i] * c + flat[j]
            g, w = np.bincount(cell, y - p, c * c).reshape(c, c), np.bincount(cell, p * (1 - p) + 1e-6, c * c).reshape(c, c)
            gains.append((_quarters(g, w)[0], i, j))
    model.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:n_pairs]]
    model.pair_tables = [np.zeros((c, c)) for _ in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            p = 1 / (1 + np.exp(-f))
            cell = flat[i] * c + flat[j]
            g, w = np.bincount(cell, y - p, c * c).reshape(c, c), np.bincount(cell, p * (1 - p) + 1e-6, c * c).reshape(c, c)
            step = rate * np.clip(_quarters(g, w)[1], -5, 5)
            table += step
            f += step[flat[i], flat[j]]
    return model


def _quarters(g: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Best two-by-two split of a grid: what it explains, and its values by cell."""
    gs, ws = g.cumsum(0).cumsum(1), w.cumsum(0).cumsum(1)
    best, out, n = 0.0, np.zeros_like(g), len(g)
    for a in range(n - 1):
        for b in range(n - 1):
            gq = np.array([gs[a, b], gs[a, -1] - gs[a, b], gs[-1, b] - gs[a, b], gs[-1, -1] - gs[a, -1] - gs[-1, b] + gs[a, b]])
            wq = np.array([ws[a, b], ws[a, -1] - ws[a, b], ws[-1, b] - ws[a, b], ws[-1, -1] - ws[a, -1] - ws[-1, b] + ws[a, b]])
            if wq.min() < 1.0:
                continue
            if (gain := float((gq**2 / wq).sum() - gs[-1, -1] ** 2 / ws[-1, -1])) > best:
                v = gq / wq
                best, out = gain, np.block([[np.full((a + 1, b + 1), v[0]), np.full((a + 1, n - b - 1), v[1])], [np.full((n - a - 1, b + 1), v[2]), np.full((n - a - 1, n - b - 1), v[3])]])
    return best, out


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5) -> AdditiveModel:
    """Learn from at most ``max_rows`` labelled rows outside the held-out fold."""
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col), folds))
    per_doc = usable.groupBy(id_col).agg(F.max(label_col).alias("label"))
    chosen = per_doc.orderBy(F.crc32(F.concat(F.lit("train:"), F.col(id_col).cast("string"))), id_col).limit(max_rows)
    # max_rows ids and labels: a fixed bound.
    picked = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).select(text_col, F.col("label").cast("double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(v.as_py() for v in batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), batch.column(1)], ["x", "label"])

    rows = picked.mapInArrow(run, "x array<double>, label double").toArrow()
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    y = (np.array(rows["label"].to_pylist(), float) > 0).astype(float)
    order = np.lexsort([y, *x.T])  # the same model whatever order the rows came in
    return fit(x[order], y[order])


def held_out(ids, folds: int = 5):
    """Rows that training never sees."""
    return F.coalesce(F.crc32(ids.cast("string")) % folds == 0, F.lit(False))


def score(docs: DataFrame, model: AdditiveModel, text_col: str = "text", out_col: str = "quality_score") -> DataFrame:
    """``docs`` with one more column, the probability of label 1; it takes the place of one of that name."""
    docs = docs.drop(out_col) if out_col != text_col else docs
    at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField(out_col, DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = model.score(matrix(v.as_py() for v in batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], [*batch.schema.names, out_col])

    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: AdditiveModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model accepts, with all their columns."""
    name = "_" * (1 + max(map(len, docs.columns)))  # longer than any there is
    return score(docs, model, text_col, name).where(F.col(name) >= threshold).select(*docs.columns)
