"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted feature by feature in a cycle, each adding to a lookup table over the bins
of its feature; then the pairs of features that explain most of the rest get two-way tables the same
way. A text is scored by adding one table entry per feature and pair.

Fitted on at most `most` labelled rows, those with the smallest hashes of doc_id (rows with crc32(doc_id)
mod 4 = 2 are never used). Nulls: a null text is empty and has a score like any other; labels that are null are not
used; of labels that repeat for a doc_id the smallest counts, and of texts that repeat for it one of them. Without labelled
rows every score is 0.7. Repeated rows and ties score alike; memory grows with the longest text only. An empty table gives none.
Other columns are ignored or kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NOT_SPACE, bounded_batches, buffers, find_words, learn_row, slices, smallest_hashes, span_hashes, text_of

SAMPLE_ROWS = 20_000
FEATURES = (
    "log_words", "word_length", "upper", "digits", "symbols", "bangs", "stops", "bars", "lines", "distinct_words", "repeated_lines",
    "top_word", "distinct_triples", "beyond_ascii", "one_byte_words", "sentence", "capitals", "line_length", "symbol_ends", "letters",
)


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _table("abcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 128)
_DIGIT, _SYMBOL, _BANG, _STOP, _BAR, _LINE = (_table(x) for x in ("0123456789", "#$%&*<>{}[]=+~^_\\/@", "!?", ".,;:", "|", "\n"))
_BEYOND = np.arange(256) >= 128
_NOT_LINE = ~_LINE


def distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """By document: the number of distinct hashes, and how often the most frequent one occurs."""
    order = np.lexsort((h, doc))
    d, h = doc[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(new)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, d[first], np.diff(np.append(first, len(d))))
    return np.bincount(d[first], minlength=n), top


def text_features(col: pa.Array) -> np.ndarray:
    """One row of FEATURES per text."""
    data, off = buffers(col)
    n = len(off) - 1
    size = np.diff(off)

    def share(member: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(member[data])])
        return (total[off[1:]] - total[off[:-1]]) / np.maximum(of, 1)

    s, e, rows = find_words(data, off, NOT_SPACE)
    words, doc = np.diff(rows), np.repeat(np.arange(n), np.diff(rows))
    h = span_hashes(data, s, e)
    kinds, top = distinct(doc, h, n)
    three = np.flatnonzero((doc[2:] == doc[:-2]) if len(doc) > 2 else np.zeros(0, bool))
    triples, _ = distinct(doc[three], h[three] * np.uint64(3) + h[three + 1] * np.uint64(5) + h[three + 2] * np.uint64(7), n)
    ls, le, lrows = find_words(data, off, _NOT_LINE)
    lines, line_doc = np.diff(lrows), np.repeat(np.arange(n), np.diff(lrows))
    line_kinds, _ = distinct(line_doc, span_hashes(data, ls, le), n)
    letters = share(_LETTER, size)

    def by_word(flag: np.ndarray) -> np.ndarray:
        return np.bincount(doc, flag, n) / np.maximum(words, 1)

    stops = share(_table("."), np.ones(n))
    return np.stack(
        [
            np.log1p(words), by_word(e - s), share(_UPPER, np.maximum(letters * size, 1)), share(_DIGIT, size), share(_SYMBOL, size), share(_BANG, words),
            share(_STOP, words), share(_BAR, words), share(_LINE, words), kinds / np.maximum(words, 1), 1 - line_kinds / np.maximum(lines, 1),
            top / np.maximum(words, 1), triples / np.maximum(words - 2, 1), share(_BEYOND, size), by_word(e - s == 1), words / (stops + 1),
            by_word(_UPPER[data[s]]) if len(s) else np.zeros(n), words / np.maximum(lines, 1), by_word(_SYMBOL[data[e - 1]]) if len(s) else np.zeros(n), letters,
        ],
        axis=1,
    )


def _cut(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, int]:
    """The best threshold along sums of gradients and weights: its gain, and the first bin to the right; 0 if both sides never weigh enough."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    fits = (hl > least) & (hr > least)
    if not fits.any():
        return 0.0, 0
    gain = np.where(fits, gl**2 / (hl + 1) + gr**2 / (hr + 1), 0) - g.sum() ** 2 / (h.sum() + 1)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, least: float) -> np.ndarray:
    """Values by bin of a tree of depth two."""
    out = np.zeros(len(g))
    gain, k = _cut(g, h, least)
    parts = [(0, len(g))] if gain <= 0 else [(0, k), (k, len(g))]
    for a, b in parts:
        gain, k = _cut(g[a:b], h[a:b], least)
        for x, y in [(a, b)] if gain <= 0 else [(a, a + k), (a + k, b)]:
            out[x:y] = g[x:y].sum() / (h[x:y].sum() + 1)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, least: float) -> tuple[np.ndarray, float]:
    """Values over a grid: one cut along the better side, then one along the other in each half; and the gain."""
    best = (np.zeros_like(g), 0.0)
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        _, k = _cut(gg.sum(1), hh.sum(1), least)
        k = k or gg.shape[0] // 2
        out, total = np.zeros_like(gg), 0.0
        for a, b in ((0, k), (k, gg.shape[0])):
            _, j = _cut(gg[a:b].sum(0), hh[a:b].sum(0), least)
            for x, y in ((0, j), (j, gg.shape[1])) if j else ((0, gg.shape[1]),):
                sg, sh = gg[a:b, x:y].sum(), hh[a:b, x:y].sum()
                out[a:b, x:y] = sg / (sh + 1)
                total += sg**2 / (sh + 1)
        if total > best[1]:
            best = (out.T if flip else out, total)
    return best


@dataclass
class Gam:
    edges: list[np.ndarray]
    start: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    grids: list[np.ndarray]
    coarse: int = 4

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], axis=1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        if not self.edges:
            return np.full(len(x), self.start)
        b = self.bins(x)
        out = np.full(len(x), self.start)
        for k, t in enumerate(self.tables):
            out += t[b[:, k]]
        for (i, j), g in zip(self.pairs, self.grids):
            out += g[b[:, i] // self.coarse, b[:, j] // self.coarse]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 8, rate: float = 0.1, least: float = 2.0) -> Gam:
    if not len(y):
        return Gam([], float(np.log(0.7 / 0.3)) + 1e-9, [], [], [])
    mean = np.clip(y.mean(), 0.01, 0.99)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    m = Gam(edges, float(np.log(mean / (1 - mean))), [np.zeros(len(e) + 1) for e in edges], [], [])
    b = m.bins(x)
    f = np.full(len(y), m.start)
    for _ in range(rounds):
        for k, t in enumerate(m.tables):
            p = 1 / (1 + np.exp(-f))
            step = rate * _tree(np.bincount(b[:, k], y - p, len(t)), np.bincount(b[:, k], p * (1 - p), len(t)), least)
            t += step
            f += step[b[:, k]]
    c = b // m.coarse
    size = [int(len(t) - 1) // m.coarse + 1 for t in m.tables]

    def grid(i: int, j: int, w: np.ndarray) -> np.ndarray:
        return np.bincount(c[:, i] * size[j] + c[:, j], w, size[i] * size[j]).reshape(size[i], size[j])

    p = 1 / (1 + np.exp(-f))
    gains = sorted(((_pair_tree(grid(i, j, y - p), grid(i, j, p * (1 - p)), least)[1], i, j) for i in range(len(edges)) for j in range(i)), reverse=True)
    m.pairs = [(i, j) for g, i, j in gains[:n_pairs] if g > 0]
    m.grids = [np.zeros((size[i], size[j])) for i, j in m.pairs]
    for _ in range(pair_rounds):
        for (i, j), t in zip(m.pairs, m.grids):
            p = 1 / (1 + np.exp(-f))
            step = rate * _pair_tree(grid(i, j, y - p), grid(i, j, p * (1 - p)), least)[0]
            t += step
            f += step[c[:, i], c[:, j]]
    return m


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> Gam:
    """Fits on the bounded sample; its features are computed by Spark, its tables on the driver."""
    few = labels.where(learn_row() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    few = smallest_hashes(few.withColumn("quality", F.col("quality").cast("int")), "doc_id", most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            x = text_features(text_of(piece))
            rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("quality"), rows], names=["doc_id", "quality", "x"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(few.withColumn("doc_id", F.col("doc_id").cast("long"))), "doc_id").mapInArrow(run, "doc_id long, quality int, x array<double>")
    rows = found.dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    return fit(x, rows["quality"].to_numpy(float))


def score(docs: DataFrame, model: Gam, name: str = "score") -> DataFrame:
    """docs with a score column in place of any column of that name."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.drop(name)
    schema = T.StructType([*plain.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(shared.value.score(text_features(text_of(piece))))], names=schema.names)

    return plain.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Gam, least: float = 0.7) -> DataFrame:
    """docs with a score of at least that; columns as before."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            yield piece.filter(pa.array(shared.value.score(text_features(text_of(piece))) >= least))

    return docs.mapInArrow(run, docs.schema)
