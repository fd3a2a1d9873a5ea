"""Exact token counts of every prefix of a text, for a BPE vocabulary with word ends, by dynamic programming over prefixes.

A text is cut into words (contractions, runs of letters, single numbers, runs of other characters; white space is dropped).
A sequence of tokens is what BPE gives for its characters if each pair of neighbours is what BPE gives for theirs, as merges
come in rising order. So the last token of a prefix of a word is the one token ending there that goes with the last token of
the prefix before it, and its count is one more than the count there: each prefix is answered from shorter ones. As a
prefix ends a word wherever it stops, the last token of each is looked up with the mark of a word's end. Whether two
tokens go together is found by undoing the later merge of the two until a merge across their border would have come first, and remembered. Counts of words are kept
in a table of the worker process, which starts anew at a fixed number of words.

`prefix_counts` gives an array of (characters + 1) integers for each text, and questions about truncation and budgets are
expressions over it: nothing is encoded again. Characters are those of the text in NFC, as the vocabulary reads it; special strings
of the vocabulary count as one token where they are whole, as ordinary text where a prefix cuts them.

Nulls: a null text is empty and has the counts [0]. Repeated rows, ties and an empty table need no care; other columns stay, except one
that has the name of the result. Memory grows with the longest text only.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import NUMBER, PIECE_BYTES, SPACE, WordTable, byte_letters, character_classes, gather, read_vocabulary
from .common import bounded_batches, slices, span_hashes, text_of

#: Pairs of tokens of which a worker remembers whether they go together.
MEMO_PAIRS = 1_000_000
#: After an apostrophe that begins a word: letters that belong to it.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


class Merges:
    """Tokens of a vocabulary with word ends, and the merge that made each: its rank (-1 for bytes) and its two parts."""

    def __init__(self, text: str):
        file = json.loads(text)
        model = file["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        if model["type"] != "BPE" or not suffix or model.get("ignore_merges") or model.get("byte_fallback"):
            raise ValueError("a BPE vocabulary with word ends is needed")
        self.special = [t["content"] for t in file["added_tokens"]]
        code = {c: b for b, c in enumerate(byte_letters())}
        self.size = max(vocab.values()) + 1
        self.rank: dict[int, int] = {}
        self.made, self.left, self.right = [-1] * self.size, [-1] * self.size, [-1] * self.size
        single = {vocab[c + end] for c in code for end in ("", suffix) if c + end in vocab}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            if self.made[k] >= 0 or k in single or any(t not in single and self.made[t] < 0 for t in (i, j)):
                raise ValueError("merges must come in the order in which they build on each other, one for each token")
            self.rank[i * self.size + j], self.made[k], self.left[k], self.right[k] = r, r, i, j
        #: Tokens that BPE gives for their own characters.
        whole = single.copy()
        for k in sorted(set(vocab.values()) - single, key=self.made.__getitem__):
            if self.made[k] >= 0 and self.left[k] in whole and self.right[k] in whole and self.stay(self.left[k], self.right[k], self.made[k]):
                whole.add(k)
        #: These by their bytes, inside a word and at its end, and the lengths (from three) of those that end in each three bytes.
        self.inside: dict[bytes, int] = {}
        self.ending: dict[bytes, int] = {}
        for token, i in vocab.items():
            if i in whole:
                end = token.endswith(suffix)
                (self.ending if end else self.inside)[bytes(code[c] for c in (token[: -len(suffix)] if end else token))] = i
        self.lengths: list[dict[bytes, tuple[int, ...]]] = []
        for own in (self.inside, self.ending):
            found: dict[bytes, set[int]] = {}
            for piece in own:
                if len(piece) > 2:
                    found.setdefault(piece[-3:], set()).add(len(piece))
            self.lengths.append({k: tuple(sorted(v, reverse=True)) for k, v in found.items()})
        self.known: dict[int, bool] = {}

    def stay(self, a: int, b: int, before: int) -> bool:
        """Whether BPE makes a and b, side by side, without a merge across their border of a rank below `before`."""
        made, rank, size, none = self.made, self.rank, self.size, len(self.rank)
        while True:
            if rank.get(a * size + b, none) < before:
                return False
            if made[a] > made[b]:
                before, a = made[a], self.right[a]
            elif made[b] >= 0:  # of equal merges the left one comes first, so one across the border would precede this one
                before, b = made[b] + 1, self.left[b]
            else:
                return True

    def together(self, a: int, b: int) -> bool:
        """Whether BPE gives a and b for their characters side by side."""
        key = a * self.size + b
        if (good := self.known.get(key)) is None:
            if len(self.known) >= MEMO_PAIRS:
                self.known.clear()
            good = self.known[key] = self.stay(a, b, len(self.rank))
        return good

    def counts(self, words: Iterable[bytes]) -> Iterator[list[int]]:
        """For each of many words, best in sorted order, the number of tokens of its prefixes by their bytes; 0 for those that cut a character.

        What a word shares with the one before it is not computed again."""
        inside, ending, together = self.inside, self.ending, self.together
        inner, outer = self.lengths
        known, size = self.known, self.size
        before, last, number, closed = b"", [-1], [0], [0]
        for word in words:
            n = len(word)
            k, most = 0, min(n, len(before))
            while k < most and word[k] == before[k]:
                k += 1
            del last[k + 1 :], number[k + 1 :], closed[k + 1 :]
            for j in range(k + 1, n + 1):
                tail = word[j - 3 : j] if j > 2 else b""
                if j == n or word[j] & 0xC0 != 0x80:
                    for length in (*outer.get(tail, ()), 2, 1):
                        if length <= j and (t := ending.get(word[j - length : j])) is not None:
                            if length == j or (good := known.get((a := last[j - length]) * size + t)) or good is None and together(a, t):
                                closed.append(number[j - length] + 1)
                                break
                else:
                    closed.append(0)
                for length in (*inner.get(tail, ()), 2, 1):
                    if length <= j and (t := inside.get(word[j - length : j])) is not None:
                        if length == j or (good := known.get((a := last[j - length]) * size + t)) or good is None and together(a, t):
                            last.append(t)
                            number.append(number[j - length] + 1)
                            break
            before = word
            yield closed


_lower: list[np.ndarray] = []
_classes: list[np.ndarray] = []


def lower_table() -> np.ndarray:
    """The lower-case character of each one, taken alone; 0 where it has two."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (low := chr(c).lower()) != chr(c):
            out[c] = ord(low) if len(low) == 1 else 0
    return out


def composed(text: str, special: re.Pattern) -> str:
    """The text in NFC; what special strings separate is composed apart."""
    return text if unicodedata.is_normalized("NFC", text) and not special.search(text) else "".join(p if i % 2 else unicodedata.normalize("NFC", p) for i, p in enumerate(special.split(text)))


def word_starts(point: np.ndarray, kind: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Where words begin in lower-cased characters; cut marks places that part words (one more than characters)."""
    n = len(point)
    start = np.ones(n, bool)
    if n:
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER) | cut[1:n]
    start &= kind != SPACE
    quote = np.flatnonzero((point == 39) & start)
    if len(quote):
        p, c = np.concatenate([point, np.zeros(3, np.uint32)]), np.concatenate([cut, np.ones(3, bool)])
        for ending in ENDINGS:
            hit = np.ones(len(quote), bool)
            for i, letter in enumerate(ending, 1):
                hit &= (p[quote + i] == ord(letter)) & ~c[quote + i]
            at = quote[hit]
            start[at + 1] = False
            after = at + 1 + len(ending)
            after = after[after < n]
            start[after] = kind[after] != SPACE
    return start


class Counter:
    """Counts of all prefixes of the texts of a piece."""

    def __init__(self, merges: Merges):
        self.m, self.table = merges, WordTable()
        self.special = re.compile("(" + "|".join(sorted(map(re.escape, merges.special), key=len, reverse=True)) + ")") if merges.special else re.compile("((?!))")
        if not _lower:
            _lower.append(lower_table())
            _classes.append(character_classes())

    def fresh(self, raw: bytes, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts at all character ends of new words, flat, and their number by word."""
        words = [raw[a:b] for a, b in zip(s.tolist(), e.tolist())]
        order = sorted(range(len(words)), key=words.__getitem__)
        letters = {c: next(self.m.counts([c]))[1] for c in (b"r", b"v", b"l")}
        found: list[list[int]] = [[]] * len(words)
        for k, counts in zip(order, self.m.counts(words[k] for k in order)):
            word, own = words[k], [c for c in counts if c]
            if len(word) == 3 and word[0] == 39 and word[1:2] in letters:  # a prefix of two is an apostrophe and a letter
                own[1] = own[0] + letters[word[1:2]]
            found[k] = own
        return np.array([c for own in found for c in own], np.int32), np.array([len(own) for own in found])

    def __call__(self, col: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The texts in NFC, the counts after each of their characters, flat, and the offsets of the texts among them."""
        texts = ["" if t is None else t if t.isascii() else composed(t, self.special) for t in col.to_pylist()]
        text = "".join(texts)
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        n = len(text)
        cut = np.zeros(n + 1, bool)
        cut[off] = True
        marks = []
        for row in np.unique(np.searchsorted(off, [m.start() for m in self.special.finditer(text)], "right") - 1).tolist():
            marks += [(row, off[row] + m.start(), off[row] + m.end()) for m in self.special.finditer(texts[row])]
        cut[[b for _, _, b in marks]] = True
        point = _lower[0][(raw_point := np.frombuffer(text.encode("utf-32-le"), np.uint32))]
        ends = np.arange(1, n + 1)  # behind each character, in lower-cased ones
        low_cut = cut
        if n and (odd := np.flatnonzero(point == 0)[raw_point[point == 0] != 0]).size:  # characters of which the lower case has two
            wide = np.ones(n, np.int64)
            pairs = [chr(c).lower() for c in raw_point[odd].tolist()]
            wide[odd] = [len(p) for p in pairs]
            ends = np.cumsum(wide)
            point = np.repeat(point, wide)
            point[gather(ends[odd] - wide[odd], wide[odd])] = [ord(c) for p in pairs for c in p]
            low_cut = np.zeros(len(point) + 1, bool)
            low_cut[np.concatenate([[0], ends])[np.flatnonzero(cut)]] = True
        counts = self.words(point, low_cut)[ends - 1] if n else np.zeros(0, np.int64)
        base = np.concatenate([[0], counts])[off[:-1]]
        counts = counts - np.repeat(base, np.diff(off))
        if marks:  # from its end on, a special string has one token in place of those of its characters
            less = np.zeros(n, np.int64)
            for row, a, b in marks:
                less[b - 1] += counts[b - 1] - (counts[a - 1] if a > off[row] else 0) - 1
            total = np.cumsum(less)
            counts = counts - (total - np.repeat(np.concatenate([[0], total])[off[:-1]], np.diff(off)))
        return texts, counts, off

    def words(self, point: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Tokens from the beginning of the piece to each of its lower-cased characters, if the text ended there."""
        kind = _classes[0][point]
        space = kind == SPACE
        start = word_starts(point, kind, cut)
        n = len(point)
        end = ~space
        end[:-1] &= start[1:] | space[1:]
        s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
        if not len(s):
            return np.zeros(n, np.int64)
        raw = point.astype("<u4").tobytes().decode("utf-32-le").encode()
        data = np.frombuffer(raw, np.uint8)
        byte = np.concatenate([[0], np.cumsum(1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000), dtype=np.int64)])
        keys, first, inverse = np.unique(span_hashes(data, byte[s], byte[e], lower=False), return_index=True, return_inverse=True)
        part, place = self.table.find(keys)
        new = part < 0
        lens = (e - s)[first]
        flat, at, total = [], np.zeros(len(keys), np.int64), 0
        if new.any():
            own, number = self.fresh(raw, byte[s[first[new]]], byte[e[first[new]]])
            flat.append(own)
            at[new] = np.cumsum(number) - number
            total = len(own)
        for k, (_, off_k, ids_k) in enumerate(self.table.parts):
            old = np.flatnonzero(part == k)
            flat.append(ids_k[gather(off_k[place[old]], lens[old])])
            at[old] = total + np.cumsum(lens[old]) - lens[old]
            total += len(flat[-1])
        if new.any():
            self.table.add(keys[new], own, lens[new])
        inner = np.concatenate(flat)[gather(at[inverse], e - s)].astype(np.int64)
        word_total = inner[np.cumsum(e - s) - 1]
        before = np.cumsum(word_total) - word_total
        # white space behind a word keeps its count
        out = np.concatenate([[0], before + word_total])[np.cumsum(start)]
        out[gather(s, e - s)] = inner + np.repeat(before, e - s)
        return out


_counters: dict[str, Counter] = {}


def worker_counter(text: str) -> Counter:
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(Merges(text))
    return _counters[key]


def prefix_counts(docs: DataFrame, path: str, counts: str = "prefix_tokens", keep_text: bool = True) -> DataFrame:
    """docs with the token counts of the first 0, 1, 2, ... characters of `text`, which is put into NFC, or dropped without keep_text.

    path: a vocabulary file on the driver, of a few MB, which is broadcast."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    plain = docs.drop(counts)
    kept = [f for f in plain.schema.fields if keep_text or f.name != "text"]
    schema = T.StructType([*kept, T.StructField(counts, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(shared.value)
        for piece in slices(batches, most=PIECE_BYTES):
            texts, flat, off = counter(text_of(piece))
            with_zero = np.zeros(len(flat) + len(texts), np.int32)
            at = off + np.arange(len(off))
            with_zero[gather(at[:-1] + 1, np.diff(off))] = flat
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(with_zero))
            cols = [pa.array(texts, pa.string()) if f.name == "text" else piece.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*cols, lists], names=schema.names)

    return plain.mapInArrow(run, schema)


def n_tokens(counts: Column) -> Column:
    """Tokens of the whole text."""
    return F.element_at(counts, -1).cast("long")


def tokens_of(counts: Column, characters: Column) -> Column:
    """Tokens of the first so many characters; null beyond the text."""
    return F.get(counts, characters).cast("long")


def longest_prefix(counts: Column, budget: Column | int) -> Column:
    """The most characters that the budget of tokens holds (a longer prefix can have fewer tokens than a shorter one); null for a negative one."""
    fits = F.transform(F.reverse(counts), lambda c: c <= budget)
    return F.when(F.lit(budget) >= 0, F.size(counts) - F.array_position(fits, True))


def truncated(docs: DataFrame, path: str, budget: int) -> DataFrame:
    """docs with the longest prefix of `text` (in NFC) within the budget of tokens, its n_tokens, and whether it was cut."""
    rows = prefix_counts(docs.drop("n_tokens", "cut"), path, "_counts").withColumn("_most", longest_prefix(F.col("_counts"), budget))
    out = rows.withColumns({"text": F.substring(F.col("text"), F.lit(1), F.col("_most").cast("int")), "n_tokens": tokens_of(F.col("_counts"), F.col("_most")), "cut": F.col("_most") < F.size("_counts") - 1})
    return out.drop("_counts", "_most")


def budget_report(docs: DataFrame, path: str, budgets: list[int]) -> DataFrame:
    """For each budget of tokens a text: texts, texts over it, and the tokens left if those are cut to it, from one encoding."""
    counts = F.col("_counts")
    rows = prefix_counts(docs.select("text"), path, "_counts", keep_text=False)
    each = [F.struct(F.lit(b).alias("budget"), (n_tokens(counts) > b).alias("over"), tokens_of(counts, longest_prefix(counts, b)).alias("kept")) for b in budgets]
    rows = rows.select(F.explode(F.array(*each)).alias("r")).select("r.*")
    return rows.groupBy("budget").agg(F.count("*").alias("texts"), F.count_if("over").alias("over"), F.sum("kept").alias("tokens"))
