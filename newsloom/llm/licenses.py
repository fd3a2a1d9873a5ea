"""License scans: template markup compiled to token automata.

A template is license wording with `<<beginOptional>> ... <<endOptional>>` around regions that may be
missing (they nest) and `<<var;...>>` for a replaceable region: `words=a..b` gives its number of words; other attributes, as in
public template collections, are allowed, and without a number of words a region takes 0 to VAR_WORDS. The rest is mandatory and
must match word for word. Words are lower-cased runs of letters, digits and everything beyond ASCII, so
punctuation, case and line breaks never matter. A template compiles to an automaton over word hashes;
it is tried wherever its possible first two words stand. `read_templates` takes templates from a folder.

Nulls: a null text has no words. Repeated rows, ties and an empty table need no care. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, bounded_batches, hash_of, mix, slices, text_of, word_hashes
from .license_texts import PHRASES, TEMPLATES

#: Words that a replaceable region without a number of words takes at most.
VAR_WORDS = 60
#: Bytes of a folder of templates.
TEMPLATE_BYTES = 16_000_000
_MARK = re.compile(r"<<(beginOptional|endOptional|var)(?:;(.*?))?>>", re.S)
_WORDS = re.compile(r"(?:^|;)words=(\d+)\.\.(\d+)")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def words_of(text: str) -> list[str]:
    return _WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text))


@dataclass
class Automaton:
    """States 0 to end; arcs by word hash, by any word, and without a word."""

    by_word: dict[tuple[int, int], set[int]] = field(default_factory=dict)
    any_word: dict[int, set[int]] = field(default_factory=dict)
    free: dict[int, set[int]] = field(default_factory=dict)
    end: int = 0

    def new(self) -> int:
        self.end += 1
        return self.end

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free.get(todo.pop(), ()):
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def first_words(self) -> dict[int, set[int] | None]:
        """The words that can come first, each with those that can follow; None if it may end there or any word can follow."""
        start, out = self.closure({0}), {}
        if any(s in self.any_word for s in start) or self.end in start:
            raise ValueError("a template must begin with wording")
        for w in {w for s, w in self.by_word if s in start}:
            after = self.closure({t for s in start for t in self.by_word.get((s, w), ())})
            out[w] = None if self.end in after or any(s in self.any_word for s in after) else {v for s, v in self.by_word if s in after}
        return out

    def run(self, words: np.ndarray) -> int:
        """Words in the longest accepted prefix; 0 if none is accepted."""
        states, best = self.closure({0}), 0
        for k, w in enumerate(words[: self.end].tolist(), 1):
            states = self.closure({t for s in states for t in (*self.by_word.get((s, w), ()), *self.any_word.get(s, ()))})
            if not states:
                break
            if self.end in states:
                best = k
        return best


def compile_template(markup: str) -> Automaton:
    a, at, opened, pos = Automaton(), 0, [], 0

    def wording(text: str, at: int) -> int:
        for w in words_of(text):
            nxt = a.new()
            a.by_word.setdefault((at, hash_of(w)), set()).add(nxt)
            at = nxt
        return at

    for m in _MARK.finditer(markup):
        at = wording(markup[pos : m.start()], at)
        pos = m.end()
        if m[1] == "beginOptional":
            opened.append(at)
        elif m[1] == "endOptional":
            nxt = a.new()
            a.free.setdefault(at, set()).add(nxt)
            a.free.setdefault(opened.pop(), set()).add(nxt)
            at = nxt
        else:
            sized = _WORDS.search(m[2] or "")
            low, high = (int(sized[1]), int(sized[2])) if sized else (0, VAR_WORDS)
            skips = []
            for k in range(high):
                if k >= low:
                    skips.append(at)
                nxt = a.new()
                a.any_word.setdefault(at, set()).add(nxt)
                at = nxt
            nxt = a.new()
            for s in (*skips, at):
                a.free.setdefault(s, set()).add(nxt)
            at = nxt
    if opened:
        raise ValueError("an optional region is not closed")
    last, at = wording(markup[pos:], at), a.new()
    a.free.setdefault(last, set()).add(at)
    return a


def read_templates(spark: SparkSession, path: str) -> dict[str, str]:
    """Templates of a folder that Spark can read, such as a shared one: files of wording in markup, labelled by their names without the ending.

    They are a stated set that goes to every task, so more than TEMPLATE_BYTES of them are refused."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.template)?(?:\.txt)?$", 1).alias("label"), "value")
    if (files.agg(F.sum(F.octet_length("value"))).first()[0] or 0) > TEMPLATE_BYTES:
        raise ValueError(f"more than {TEMPLATE_BYTES} bytes of templates")
    return {r["label"]: r["value"] for r in files.orderBy("label").collect()}


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base: places of the phrases, first_word and last_word the smallest and largest of them. labels: of phrases and of
    templates that the text accepts anywhere. score: 1 if it accepts a template, 0.5 if it has a phrase only, else 0.
    spans: label, first word and words of each template match, longest at each place.
    """
    bounded_batches(docs.sparkSession)
    short = [(np.array([hash_of(w) for w in words_of(p)], np.uint64), label) for p, label in phrases.items()]
    machines = [(label, compile_template(t)) for label, t in templates.items()]
    one: dict[int, list[int]] = {}
    two: dict[int, list[int]] = {}
    for k, (_, m) in enumerate(machines):
        for w, after in m.first_words().items():
            if after is None:
                one.setdefault(w, []).append(k)
            else:
                for pair in pair_keys(np.full(len(after), w, np.uint64), np.array(sorted(after), np.uint64)).tolist():
                    two.setdefault(pair, []).append(k)
    heads, pairs = np.array(sorted(one), np.uint64), np.array(sorted(two), np.uint64)
    out = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("n_words", pa.int64())])))]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            h, rows = word_hashes(text_of(piece), ALNUM)
            doc = np.repeat(np.arange(len(piece)), np.diff(rows))
            count, base = np.zeros(len(piece), np.int64), [set() for _ in range(len(piece))]
            first, last = np.full(len(piece), np.iinfo(np.int64).max), np.full(len(piece), -1, np.int64)
            for wanted, label in short:
                at = np.flatnonzero(h == wanted[0])
                for k in range(1, len(wanted)):
                    at = at[at + k < len(h)]
                    at = at[(h[at + k] == wanted[k]) & (doc[at + k] == doc[at])]
                np.add.at(count, doc[at], 1)
                np.minimum.at(first, doc[at], at - rows[doc[at]])
                np.maximum.at(last, doc[at], at - rows[doc[at]])
                for d in np.unique(doc[at]).tolist():
                    base[d].add(label)
            spans: list[list[dict]] = [[] for _ in range(len(piece))]
            both = pair_keys(h[:-1], h[1:])
            tries = [(p, k) for keys, table in ((h, (heads, one)), (both, (pairs, two))) for p in np.flatnonzero(np.isin(keys, table[0])).tolist() for k in table[1][int(keys[p])]]
            for p, k in sorted(tries):
                d = int(doc[p])
                if n := machines[k][1].run(h[p : rows[d + 1]]):
                    spans[d].append({"label": machines[k][0], "start": p - int(rows[d]), "n_words": n})
            labels = [b | {s["label"] for s in found} for b, found in zip(base, spans)]
            none = last < 0
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(np.diff(rows)), pa.array(count), pa.array(first, mask=none), pa.array(last, mask=none),
                 pa.array([",".join(sorted(b)) for b in base]), pa.array([",".join(sorted(b)) for b in labels]),
                 pa.array([1.0 if s else 0.5 if b else 0.0 for s, b in zip(spans, base)]), pa.array(spans, out.field("spans").type)],
                schema=out,
            )

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,n_words:long>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, schema)
