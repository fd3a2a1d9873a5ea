"""Language identification of mixed text: script ranges narrow the candidates of each word, hashed character
n-grams score it in every candidate, and Viterbi with a switching penalty labels spans of words.

Learnt from at most `most` texts with a language, those with the smallest hashes of doc_id, of rows whose crc32(doc_id)
mod 4 is not 2; n-grams are counted by Spark. A prediction sees the text only. The language of a text is the one whose
spans hold most letters (of equal ones the first by name), and score is their share of all letters.

Nulls: a text that is null or has no letter is `und` with score 0, as are all texts if no language is known; rows with a null
language are not learnt from. Words in a script that no language was seen in take the label of their neighbours
and add nothing to the score. Repeated rows are learnt from and labelled each, an empty table needs no care, and memory grows with the
longest text only. Other columns are ignored or kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import bounded_batches, buffers, learn_row, mix, slices, smallest_hashes, text_of

SAMPLE_ROWS = 8_000
BUCKETS = 1 << 15
#: Log-likelihood that a change of language costs.
SWITCH = 14.0
#: First code point of each range, and its script; a range ends where the next begins.
SCRIPTS = (
    (0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "other"),
    (0x900, "devanagari"), (0x980, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"),
    (0x3190, "other"), (0x31F0, "kana"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"),
    (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"),
)
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})

_lower: list[np.ndarray] = []


def _lower_points() -> np.ndarray:
    if not _lower:
        out = np.arange(0x110000, dtype=np.uint32)
        for i in [*range(0x2000), *range(0xA640, 0xA800), *range(0xFF00, 0x10500)]:
            low = chr(i).lower()
            if len(low) == 1:
                out[i] = ord(low)
        _lower.append(out)
    return _lower[0]


@dataclass
class Words:
    """Letters of a slice of texts: lower-cased code points, first letter of each word, first word of each text."""

    points: np.ndarray
    starts: np.ndarray
    rows: np.ndarray

    @property
    def lens(self) -> np.ndarray:
        return np.diff(np.append(self.starts, len(self.points)))


def letters_of(col: pa.Array) -> Words:
    """Words are runs of letters."""
    if not bpe._classes:
        bpe._classes.append(bpe.character_classes())
    data, off = buffers(col)
    point = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    cut = np.zeros(len(point) + 1, bool)
    cut[np.searchsorted(lead, off)] = True
    letter = bpe._classes[0][point] == bpe.LETTER
    first = letter.copy()
    first[1:] &= ~letter[:-1] | cut[1 : len(point)]
    at = np.flatnonzero(letter)
    starts = np.flatnonzero(first[at])
    rows = np.searchsorted(at[starts], np.searchsorted(lead, off)) if len(at) else np.zeros(len(off), np.int64)
    return Words(_lower_points()[point[at]], starts, rows)


def ngrams(w: Words) -> list[np.ndarray]:
    """For each letter the buckets of the 1-, 2- and 3-gram that end there (a word begins with a mark); last, of each word, its whole."""
    p = w.points.astype(np.uint64)
    inside = np.arange(len(p)) - np.repeat(w.starts, w.lens)
    back = [p]
    for k in (1, 2):
        q = np.zeros(len(p), np.uint64)
        q[k:] = p[:-k]
        q[inside == k - 1] = 1
        q[inside < k - 1] = 0
        back.append(q)
    out, key = [], np.zeros(len(p), np.uint64)
    for n, q in enumerate(back):
        key = key * np.uint64(0x110000) + q + np.uint64(n)
        out.append((mix(key + np.uint64(n << 62)) % np.uint64(BUCKETS)).astype(np.int64))
    out.append((word_keys(w) % np.uint64(BUCKETS)).astype(np.int64))
    return out


_codes: list[np.ndarray] = []


def word_keys(w: Words) -> np.ndarray:
    """64-bit hashes of the words."""
    if not len(w.starts):
        return np.zeros(0, np.uint64)
    if not _codes:
        _codes.append(mix(np.arange(0x110000, dtype=np.uint64) + np.uint64(1)))
    up = np.cumprod(np.full(int(w.lens.max()) + 1, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
    inside = np.arange(len(w.points)) - np.repeat(w.starts, w.lens)
    return mix(np.add.reduceat(_codes[0][w.points] * up[inside], w.starts))


def scripts_of(points: np.ndarray) -> np.ndarray:
    begin = np.array([a for a, _ in SCRIPTS], np.uint32)
    code = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])
    return code[np.searchsorted(begin, points, "right") - 1]


@dataclass
class Model:
    langs: list[str]
    #: By n-gram bucket and language: log-likelihood, less the mean over languages.
    table: np.ndarray
    #: By script and language: whether the language was seen in it.
    allowed: np.ndarray
    switch: float = SWITCH


def learn(docs: DataFrame, most: int = SAMPLE_ROWS) -> Model:
    bounded_batches(docs.sparkSession)
    few = smallest_hashes(docs.where(learn_row() & F.col("lang").isNotNull()).select("doc_id").distinct(), "doc_id", most)
    sample = docs.where("lang is not null").select("doc_id", "lang", "text").join(F.broadcast(few), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for piece in slices(batches):
            w = letters_of(text_of(piece))
            grams = ngrams(w)
            words = np.diff(w.rows)
            names, code = np.unique(np.array(piece.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
            by_word = np.repeat(code, words)
            by_letter = np.repeat(by_word, w.lens)
            script = scripts_of(w.points)
            for k, name in enumerate(names):
                t = total.setdefault(name, np.zeros(BUCKETS + len(SCRIPT_NAMES), np.int64))
                for g in grams[:-1]:
                    t[:BUCKETS] += np.bincount(g[by_letter == k], minlength=BUCKETS)
                t[:BUCKETS] += 2 * np.bincount(grams[-1][by_word == k], minlength=BUCKETS)
                t[BUCKETS:] += np.bincount(script[by_letter == k], minlength=len(SCRIPT_NAMES))
        for name, t in total.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at), pa.string()), "bucket": pa.array(at), "n": pa.array(t[at])})

    rows = sample.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    langs = sorted(set(rows["lang"]))
    counts = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(langs)))
    counts[rows["bucket"], [langs.index(x) for x in rows["lang"]]] = rows["n"]
    grams, script = counts[:BUCKETS], counts[BUCKETS:]
    logs = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * BUCKETS)) if langs else np.zeros((BUCKETS, 0))
    if langs:
        logs -= logs.mean(1, keepdims=True)
    return Model(langs, logs.astype(np.float32), script >= 0.01 * np.maximum(script.sum(0), 1))


def viterbi(score: np.ndarray, rows: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each word: texts advance side by side, those with few left word by word."""
    n_words, n_langs = score.shape
    label = np.zeros(n_words, np.int64)
    lens = np.diff(rows)
    order = np.argsort(-lens, kind="stable")
    start, lens = rows[:-1][order], lens[order]
    m = int((lens > 0).sum())
    if not m or n_langs < 2:
        return label
    value = np.zeros((m, n_langs))
    value += score[start[:m]]
    stay = np.ones((n_words, n_langs), bool)  # the label before is the same
    best = np.zeros(n_words, np.int64)  # else it is this one
    k = 1
    active = np.searchsorted(-lens[:m], -np.arange(1, int(lens[0]) + 1), "left")  # texts with more than k words
    while k < lens[0] and (a := int(active[k - 1])) > 6:
        at = start[:a] + k
        v = value[:a]
        top = v.argmax(1)
        jump = v[np.arange(a), top] - switch
        keep = v >= jump[:, None]
        stay[at], best[at] = keep, top
        value[:a] = np.where(keep, v, jump[:, None]) + score[at]
        k += 1
    for d in range(m):  # the rest of the longest texts
        if lens[d] <= k:
            break
        v, langs = value[d].tolist(), range(n_langs)
        tail = score[start[d] + k : start[d] + lens[d]].tolist()
        stays, bests = [], []
        for s in tail:
            top = max(langs, key=v.__getitem__)
            jump = v[top] - switch
            stays.append([x >= jump for x in v])
            bests.append(top)
            v = [(x if x >= jump else jump) + y for x, y in zip(v, s)]
        value[d] = v
        stay[start[d] + k : start[d] + lens[d]], best[start[d] + k : start[d] + lens[d]] = stays, bests
    now = value.argmax(1)
    for d in range(m):
        if lens[d] <= k:
            break
        x, keep, top, out = int(now[d]), stay[start[d] + k : start[d] + lens[d]].tolist(), best[start[d] + k : start[d] + lens[d]].tolist(), []
        for s, b in zip(reversed(keep), reversed(top)):
            out.append(x)
            x = x if s[x] else b
        label[start[d] + k : start[d] + lens[d]] = out[::-1]
        now[d] = x
    for j in range(min(k, int(lens[0])) - 1, -1, -1):
        a = int(np.searchsorted(-lens[:m], -j, "left"))
        at = start[:a] + j
        label[at] = now[:a]
        now[:a] = np.where(stay[at, now[:a]], now[:a], best[at])
    return label


def label_words(col: pa.Array, model: Model) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words, their labels, and whether the script of the word was known."""
    w = letters_of(col)
    n, langs = len(w.starts), len(model.langs)
    score = np.zeros((n, langs))
    known = np.zeros(n, bool)
    if n and langs:  # each distinct word is scored once
        _, first, inverse = np.unique(word_keys(w), return_index=True, return_inverse=True)
        lens = w.lens[first]
        u = Words(w.points[bpe.gather(w.starts[first], lens)], np.cumsum(lens) - lens, np.array([0, len(first)]))
        *letters, whole = ngrams(u)
        each = model.table[letters[0]]
        for g in letters[1:]:
            each += model.table[g]
        each = np.add.reduceat(each, u.starts, axis=0) / 2.0 + 2 * model.table[whole]
        allowed = model.allowed[scripts_of(u.points[u.starts])]
        some = allowed.any(1)
        each = np.where(allowed | ~some[:, None], np.where(some[:, None], each, 0), -50.0)
        score, known = each[inverse], some[inverse]
    return w, viterbi(score, w.rows, model.switch), known


def predict_texts(col: pa.Array, model: Model) -> tuple[list[str], np.ndarray, list[list[dict]]]:
    """Language and score of each text, and its spans: language, first word, words."""
    w, label, known = label_words(col, model)
    n, langs = len(col), max(1, len(model.langs))
    doc = np.repeat(np.arange(n), np.diff(w.rows))
    weight = np.bincount(doc * langs + label, w.lens * known, n * langs).reshape(n, langs)
    letters = np.bincount(doc, w.lens, n)
    by_label = np.bincount(doc * langs + label, w.lens, n * langs).reshape(n, langs)
    best = np.where(weight.any(1), weight.argmax(1), by_label.argmax(1))
    ok = (letters > 0) & bool(model.langs)
    score = np.where(ok, weight[np.arange(n), best] / np.maximum(letters, 1), 0.0)
    new = np.flatnonzero(np.append(True, (label[1:] != label[:-1]) | (doc[1:] != doc[:-1]))) if len(label) else np.zeros(0, np.int64)
    spans: list[list[dict]] = [[] for _ in range(n)]
    for a, b in zip(new.tolist(), np.append(new[1:], len(label)).tolist()):
        if model.langs:
            spans[doc[a]].append({"lang": model.langs[label[a]], "start": a - int(w.rows[doc[a]]), "n_words": b - a})
    return [model.langs[b] if o else "und" for b, o in zip(best.tolist(), ok.tolist())], score, spans


SPAN = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("n_words", pa.int64())]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and spans."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            langs, score, spans = predict_texts(text_of(piece), shared.value)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(langs, pa.string()), pa.array(score), pa.array(spans, SPAN)], names=["doc_id", "lang_pred", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<lang:string,start:long,n_words:long>>")


def keep_known(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """docs whose language is known and holds at least that share of their letters; columns as before."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            langs, score, _ = predict_texts(text_of(piece), shared.value)
            yield piece.filter(pa.array((np.array(langs, dtype=object) != "und") & (score >= least), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
