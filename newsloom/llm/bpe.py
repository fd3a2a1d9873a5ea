"""Byte-level BPE in numpy: words are found by character classes, distinct words are merged in batches.

The symbols of many words lie in one flat array; in each round the ranks of all neighbouring pairs
are found by binary search over sorted pair keys, and each word merges its lowest-ranked pair, until
no word has a pair left. Words seen before come from a table of the worker process, which starts anew
at a fixed number of words. Decoding gathers the bytes of the ids.

Nulls: a null text is empty and has no ids; a null list of ids decodes to an empty text. Repeated rows,
ties and an empty table need no care; other columns stay. Memory grows with the longest text only.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, buffers, slices, span_hashes, text_of

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: Words and bytes of text that a worker's table holds before it starts anew, and new words that it takes in at once.
MEMO_WORDS, FRESH_WORDS = 200_000, 20_000
#: Bytes of text that are encoded at once.
PIECE_BYTES = 500_000


def byte_letters() -> list[str]:
    """The printable characters by which byte-level vocabularies write the bytes 0 to 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Tables of a byte-level BPE in the JSON form of the tokenizers library."""

    def __init__(self, text: str):
        model = json.loads(text)
        vocab = model["model"]["vocab"]
        added = {t["content"]: t["id"] for t in model["added_tokens"]}
        code = {c: b for b, c in enumerate(byte_letters())}
        n = max([*vocab.values(), *added.values()]) + 1
        pieces = [b""] * n
        for token, i in vocab.items():
            if token not in added:
                pieces[i] = bytes(code[c] for c in token)
        for token, i in added.items():
            pieces[i] = token.encode()
        self.size = n
        self.added = {k.encode(): v for k, v in added.items()}
        self.byte_ids = np.array([vocab[c] for c in byte_letters()], np.int64)
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.piece_len = np.array([len(p) for p in pieces], np.int64)
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        key = np.array([vocab[a] * n + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.pair_keys, self.pair_rank = key[order], order
        self.pair_id = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]


def character_classes() -> np.ndarray:
    """Letter, number, white space or other for each code point."""
    import regex

    points = np.r_[0:0xD800, 0xE000:0x110000]
    text = points.astype("<u4").tobytes().decode("utf-32-le")
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, text):
            out[points[m.start() : m.end()]] = kind
    return out


_classes: list[np.ndarray] = []


def split_words(data: np.ndarray, off: np.ndarray, added: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of all texts, offsets of the texts among them, and the id of an added token, else -1.

    Words: a contraction ('s 't 're 've 'm 'll 'd); a run of letters, numbers or other characters with one
    space before it; white space, of which the last character stands alone before a word.
    """
    if not _classes:
        _classes.append(character_classes())
    raw = data.tobytes()
    point = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(point)
    kind = _classes[0][point]
    byte_cuts, special = [off], []
    for token, i in added.items():
        at = raw.find(token)
        while at >= 0:
            row = np.searchsorted(off, at, "right")
            if row < len(off) and at + len(token) <= off[row]:
                special.append((at, i))
                byte_cuts.append(np.array([at, at + len(token)]))
                at = raw.find(token, at + len(token))
            else:
                at = raw.find(token, at + 1)
    cut = np.zeros(n + 1, bool)
    cut[np.searchsorted(lead, np.concatenate(byte_cuts))] = True
    space = kind == SPACE
    before, after = np.empty(n, np.uint8), np.empty(n, np.uint8)
    before[1:], after[:-1] = kind[:-1], kind[1:]
    blank = np.zeros(n, bool)
    if n:
        before[0] = after[-1] = 255
        blank[1:] = point[:-1] == 32
    start = np.where(space, (before != SPACE) | ((after != SPACE) & ~cut[1:]), (before != kind) & ~blank)
    start |= cut[:n]
    # contractions: the word begins at the apostrophe and takes one or two letters
    quote = np.flatnonzero((point == 39) & start)
    if len(quote):
        p = np.concatenate([point, np.zeros(3, np.uint32)])
        c = np.concatenate([cut, np.ones(3, bool)])
        one, two = p[quote + 1], p[quote + 2]
        short = np.isin(one, [ord(x) for x in "stmd"]) & ~c[quote + 1]
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        pair &= ~c[quote + 1] & ~c[quote + 2] & ~short
        start[quote[short | pair] + 1] = False
        nxt = np.concatenate([quote[short] + 2, quote[pair] + 3])
        start[nxt[nxt < n]] = True
    s = lead[start[: len(lead)]]
    if special:  # an added token is one word, whatever its characters
        inside = np.zeros(len(data) + 1, bool)
        for at, i in special:
            inside[at + 1 : at + len(next(k for k, v in added.items() if v == i))] = True
        s = s[~inside[s]]
    e = np.append(s[1:], len(data))
    rows = np.searchsorted(s, off)
    forced = np.full(len(s), -1, np.int64)
    for at, i in special:
        forced[np.searchsorted(s, at)] = i
    return s, e, rows, forced


def merge_words(v: Vocabulary, symbols: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge rounds over a flat array of symbols of many words; the ids in the same order, and their number by word."""
    ids, word = v.byte_ids[symbols], np.repeat(np.arange(len(lens)), lens)
    done_ids, done_words = [], []
    top = len(v.pair_keys)
    while len(ids):
        key = ids[:-1] * v.size + ids[1:]
        at = np.minimum(np.searchsorted(v.pair_keys, key), top - 1)
        rank = np.full(len(ids), top, np.int64)
        rank[:-1] = np.where((v.pair_keys[at] == key) & (word[:-1] == word[1:]), v.pair_rank[at], top)
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(ids))))
        over = best == top
        done_ids.append(ids[over])
        done_words.append(word[over])
        hit = (rank == best) & ~over
        # of overlapping equal pairs, every second one counting from the left
        run = np.flatnonzero(hit)
        if len(run):
            fresh = np.append(True, (run[1:] != run[:-1] + 1) | (word[run[1:]] != word[run[:-1]]))
            run = run[(np.arange(len(run)) - np.maximum.accumulate(np.where(fresh, np.arange(len(run)), 0))) % 2 == 0]
        ids[run] = v.pair_id[at[run]]
        keep = ~over
        keep[run + 1] = False
        ids, word = ids[keep], word[keep]
    ids, word = np.concatenate(done_ids or [ids]), np.concatenate(done_words or [word])
    return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(lens))


def gather(at: np.ndarray, lens: np.ndarray, base: int = 0) -> np.ndarray:
    """Indices at[i], at[i] + 1, ... of lens[i] elements each, one after the other."""
    return np.repeat(at - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))


class WordTable:
    """Ids of words by hash: a large sorted part, and a small one of late words that is merged into it now and then."""

    def __init__(self):
        self.parts = [self.empty(), self.empty()]

    @staticmethod
    def empty() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted hashes, the offsets of their ids (one more), and the ids."""
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each hash the part that has it, or -1, and its place there."""
        part, place = np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        for k, (own, _, _) in enumerate(self.parts):
            if len(own):
                at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                hit = own[at] == keys
                part[hit], place[hit] = k, at[hit]
        return part, place

    def add(self, keys: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> None:
        if len(self.parts[0][0]) + len(self.parts[1][0]) + len(keys) > MEMO_WORDS:
            self.parts = [self.empty(), self.empty()]
        fresh = (keys, np.concatenate([[0], np.cumsum(lens)]), ids.astype(np.int32))
        self.parts[1] = self.merged(self.parts[1], fresh)
        if len(self.parts[1][0]) > FRESH_WORDS:
            self.parts = [self.merged(*self.parts), self.empty()]

    @staticmethod
    def merged(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = np.concatenate([a[0], b[0]])
        order = np.argsort(keys, kind="stable")
        at, lens = np.concatenate([a[1][:-1], b[1][:-1] + len(a[2])])[order], np.concatenate([np.diff(a[1]), np.diff(b[1])])[order]
        return keys[order], np.concatenate([[0], np.cumsum(lens)]), np.concatenate([a[2], b[2]])[gather(at, lens)]


class Encoder:
    """Encodes slices of texts; encode_new(data, starts, ends) gives the flat ids and their number for words not in the table."""

    def __init__(self, v: Vocabulary, encode_new: Callable | None = None):
        self.v, self.encode_new, self.table = v, encode_new or self.merge_new, WordTable()

    def merge_new(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return merge_words(self.v, data[gather(s, e - s)], e - s)

    def __call__(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts of the column, and the offsets of the texts among them."""
        data, off = buffers(col)
        s, e, rows, forced = split_words(data, off, self.v.added)
        keys, first, inverse = np.unique(span_hashes(data, s, e, lower=False), return_index=True, return_inverse=True)
        part, place = self.table.find(keys)
        new = part < 0
        ids, lens = self.encode_new(data, s[first[new]], e[first[new]]) if new.any() else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        # the ids of the distinct words of this piece, one after the other: known ones, then new ones
        flat, at, n = [ids.astype(np.int32)], np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at[new], n[new] = np.cumsum(lens) - lens, lens
        total = len(ids)
        for k, (_, off_k, ids_k) in enumerate(self.table.parts):
            own = np.flatnonzero(part == k)
            n[own] = off_k[place[own] + 1] - off_k[place[own]]
            flat.append(ids_k[gather(off_k[place[own]], n[own])])
            at[own] = total + np.cumsum(n[own]) - n[own]
            total += len(flat[-1])
        if new.any():
            self.table.add(keys[new], ids, lens)
        if (forced >= 0).any():  # an added token has an id of its own, whatever its characters
            special = np.flatnonzero(forced >= 0)
            flat.append(forced[special].astype(np.int32))
            inverse[special] = len(at) + np.arange(len(special))
            at, n = np.concatenate([at, total + np.arange(len(special))]), np.concatenate([n, np.ones(len(special), np.int64)])
        out = np.concatenate(flat)[gather(at[inverse], n[inverse])]
        return out, np.concatenate([[0], np.cumsum(n[inverse])])[rows]


def decode_flat(v: Vocabulary, ids: np.ndarray, off: np.ndarray) -> list[str]:
    lens = v.piece_len[ids]
    data = v.piece_bytes[gather(v.piece_at[ids], lens)].tobytes() if len(ids) else b""
    ends = np.concatenate([[0], np.cumsum(lens)])[off]
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]


_encoders: dict[tuple[str, bool], Encoder] = {}


def worker_encoder(text: str, maker: Callable[[str], Callable] | None = None) -> Encoder:
    """The encoder of this worker process for a vocabulary; maker gives its encode_new, else words are merged here."""
    key = (hashlib.sha256(text.encode()).hexdigest(), maker is None)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(Vocabulary(text), maker(text) if maker else None)
    return _encoders[key]


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """docs with a column of token ids of `text`; path: a vocabulary file on the driver, of a few MB, which is broadcast."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    plain = docs.drop(ids)
    schema = T.StructType([*plain.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared.value)
        for piece in slices(batches, most=PIECE_BYTES):
            flat, off = encoder(text_of(piece))
            col = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*piece.columns, col], names=schema.names)

    return plain.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """rows with the text of the ids; bytes that are no UTF-8 become U+FFFD."""
    bounded_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    plain = rows.drop(text)
    schema = T.StructType([*plain.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = worker_encoder(shared.value).v
        for batch in batches:
            at = 0
            while at < len(batch):  # a part of about a million ids, or one row
                piece = batch.slice(at, 1)
                n = 1
                while at + n < len(batch) and n < 512 and len(batch.column(ids).slice(at, n + 1).flatten()) < 1_000_000:
                    n += 1
                piece = batch.slice(at, n)
                col = piece.column(ids)
                lens = np.array([0 if x is None else len(x) for x in col], np.int64)
                out = decode_flat(v, col.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(lens)]))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(out, pa.string())], names=schema.names)
                at += n

    return plain.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (decimal, joined by commas) and of the text decoded from them.

    Encodes, decodes and digests a piece of texts in one pass of one worker, so that ids and decoded texts never leave it."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared.value)
        decimal = [f"{i},".encode() for i in range(encoder.v.size)]
        digits, digits_len = np.frombuffer(b"".join(decimal), np.uint8), np.array([len(d) for d in decimal])
        digits_at = np.cumsum(digits_len) - digits_len
        for piece in slices(batches, most=PIECE_BYTES):
            ids, off = encoder(text_of(piece))
            line = digits[gather(digits_at[ids], digits_len[ids])].tobytes()
            ends = np.concatenate([[0], np.cumsum(digits_len[ids])])[off]
            of_ids = [hashlib.sha256(line[a : max(a, b - 1)]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            of_text = [hashlib.sha256(t.encode()).hexdigest() for t in decode_flat(encoder.v, ids, off)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(np.diff(off)), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
