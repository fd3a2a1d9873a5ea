"""Benchmark decontamination with suffix arrays of the training words.

Each shard (a slice of documents, which grows with the benchmark up to a bound) gets a suffix array over its words; every distinct window
of the test items is binary-searched in it, which gives all its places. A window is `width` consecutive item words (a shorter
item is one window); document words inside any occurrence of a window are hit. From each place of a window the longest
verbatim match is read off the two neighbours that the place has among the sorted test suffixes with that window.

Places of different windows of one width differ, so work is linear in the words of a shard, however often words repeat.

Nulls: a null text has no words and no hits; items without words are ignored; a null item_id counts as
an empty one. Repeated rows and ties are treated row by row; of longest matches that tie the first one counts. An empty documents
table gives none, an empty benchmark no hits. Other columns of documents are kept, unless they have the names of results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, SLICE_BYTES, bounded_batches, mix, powers, slices, text_of, word_hashes

#: Benchmark text that is searched at once; the shard is as large, between SLICE_BYTES and SHARD_BYTES.
BLOCK_BYTES, SHARD_BYTES = 8_000_000, 3_000_000
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
#: Words: lower-cased A-Z, letters, digits and everything beyond ASCII.
RESULTS = {"n_words": T.LongType(), "hit_spans": SPANS, "hit_items": T.ArrayType(T.StringType()), "longest": T.LongType(), "longest_at": T.LongType()}


def suffix_array(h: np.ndarray, depth: int) -> np.ndarray:
    """Positions of h sorted by the words that follow, up to depth of them or an end mark (0)."""
    n = len(h)
    order = np.argsort(h, kind="stable")
    new = np.ones(n, bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (h[order[1:]] == 0)
    at = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, at, 0))
    step = 1
    while step < depth:
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            break
        pos = order[tied]
        key = rank[pos] * (n + 1) + rank[np.minimum(pos + step, n - 1)]
        by = np.argsort(key, kind="stable")
        order[tied] = pos[by]
        key = key[by]
        new[tied[1:]] |= key[1:] != key[:-1]
        rank[order[tied]] = np.maximum.accumulate(np.where(new, at, 0))[tied]
        step *= 2
    return order


def narrow(h: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each range of the suffix array, which agrees on k words, the part whose next word is the given one."""

    def bound(lo: np.ndarray, hi: np.ndarray, right: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) // 2
            found = h[order[mid] + k]
            up = found <= word[open_] if right else found < word[open_]
            lo[open_] = np.where(up, mid + 1, lo[open_])
            hi[open_] = np.where(up, hi[open_], mid)
        return lo

    first = bound(lo, hi, False)
    return first, bound(first, hi, True)


def search(h: np.ndarray, order: np.ndarray, test: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct windows that occur in the shard, each with its range of the suffix array."""
    who = np.arange(len(test["at"]))
    lo, hi, found = np.zeros(len(who), np.int64), np.full(len(who), len(order), np.int64), []
    k = 0
    while len(who):
        lo, hi = narrow(h, order, lo, hi, k, test["words"][test["at"][who] + k])
        live = lo < hi
        who, lo, hi = who[live], lo[live], hi[live]
        k += 1
        done = test["width"][who] == k
        found.append((who[done], lo[done], hi[done]))
        who, lo, hi = who[~done], lo[~done], hi[~done]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def prefix_sums(h: np.ndarray) -> np.ndarray:
    """By which runs of words are compared, see `common_words`."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(len(h) + 1)[0][: len(h)], dtype=np.uint64)])


def common_words(a: np.ndarray, p: np.ndarray, b: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How many words from p on equal those from q on, between low and high; a and b are prefix sums."""
    down = powers(max(len(a), len(b)) + 1)[1]
    low, high = low.copy(), np.minimum(high, np.minimum(len(a) - 1 - p, len(b) - 1 - q))
    while (open_ := low < high).any():
        mid = (low + high + 1) // 2
        same = (a[p + mid] - a[p]) * down[p] == (b[q + mid] - b[q]) * down[q]
        low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
    return low


def longest_matches(h: np.ndarray, place: np.ndarray, window: np.ndarray, test: dict) -> np.ndarray:
    """Words of the longest match with a test item that begins at each place, where the given window occurs."""
    a, b = prefix_sums(h), test["sums"]
    width, first, last = test["width"][window], test["off"][window], test["off"][window + 1]

    def match(q: np.ndarray) -> np.ndarray:
        return common_words(a, place, b, q, width, test["left"][q])

    lo, hi = first.copy(), last.copy()
    while (open_ := lo < hi).any():
        mid = np.minimum((lo + hi) // 2, last - 1)
        q = test["sorted"][mid]
        n = match(q)
        smaller = (test["left"][q] == n) | (test["words"][q + n] < h[place + n])  # an item that ends comes first
        lo, hi = np.where(open_ & smaller, mid + 1, lo), np.where(open_ & ~smaller, mid, hi)
    return np.maximum(match(test["sorted"][np.maximum(lo - 1, first)]), match(test["sorted"][np.minimum(lo, last - 1)]))


def match_shard(words: np.ndarray, rows: np.ndarray, test: dict) -> dict:
    """Hits of the items in the documents of one shard; rows: offsets of the documents among the words."""
    n, lens = len(rows) - 1, np.diff(rows)
    first = rows[:-1] + np.arange(n)  # an end mark stands after each document
    h = np.zeros(len(words) + n + test["most"] + 1, np.uint64)
    doc = np.repeat(np.arange(n), lens + 1)
    h[np.arange(len(words)) + np.repeat(np.arange(n), lens)] = words
    order = suffix_array(h[: len(words) + n], test["most"])
    who, lo, hi = search(h, order, test)
    times = hi - lo
    place = order[np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
    window = np.repeat(who, times)
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + test["width"][window], -1)
    covered = np.cumsum(edge)[: len(h)] > 0
    jump = np.diff(np.concatenate([[False], covered]).astype(np.int8))
    start, end = np.flatnonzero(jump == 1), np.flatnonzero(jump == -1)
    length = longest_matches(h, place, window, test)
    longest, where = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    by = np.lexsort((-place, length))
    longest[doc[place[by]]], where[doc[place[by]]] = length[by], place[by]
    # windows with the same items are one until here
    kinds = len(test["kind_off"]) - 1
    pairs = np.unique(doc[place] * kinds + test["kind"][window]) if len(place) else np.zeros(0, np.int64)
    own, kind = pairs // max(1, kinds), pairs % max(1, kinds)
    size = np.diff(test["kind_off"])[kind]
    item = test["kind_items"][np.repeat(test["kind_off"][kind] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    pairs = np.unique(np.repeat(own, size) * len(test["ids"]) + item) if len(item) else np.zeros(0, np.int64)
    return {"start": start - first[doc[start]], "end": end - first[doc[start]], "span_doc": doc[start], "pair_doc": pairs // max(1, len(test["ids"])), "pair_item": pairs % max(1, len(test["ids"])), "longest": longest, "longest_at": np.where(where >= 0, where - first, -1), "n_words": lens}


def prepare_items(ids: list[str], texts: pa.Array, width: int) -> dict:
    """The test words, their distinct windows (at, width, kind: the items that have it), and all suffixes by window, sorted."""
    words, rows = word_hashes(texts, ALNUM)
    n, lens = len(rows) - 1, np.diff(rows)
    test = np.zeros(len(words) + n, np.uint64)  # an end mark stands after each item
    test[np.arange(len(words)) + np.repeat(np.arange(n), lens)] = words
    item = np.repeat(np.arange(n), lens + 1)
    left = np.repeat(np.cumsum(lens + 1), lens + 1) - 1 - np.arange(len(test))
    size = np.minimum(width, lens[item])
    at = np.flatnonzero((left >= size) & (size > 0))
    sums, most = prefix_sums(test), int(max([width, *lens]))
    key = mix((sums[at + size[at]] - sums[at]) * powers(len(sums) + 1)[1][at] + size[at].astype(np.uint64))
    _, first, window = np.unique(key, return_index=True, return_inverse=True)
    rank = np.empty(len(test), np.int64)
    rank[suffix_array(test, most)] = np.arange(len(test))
    by = np.lexsort((rank[at], window))
    off = np.searchsorted(window[by], np.arange(len(first) + 1))
    # kinds: sets of items
    both = np.unique(window * n + item[at]) if n else np.zeros(0, np.int64)
    of, its = both // max(1, n), both % max(1, n)
    bounds = np.searchsorted(of, np.arange(len(first) + 1))
    marks = mix(its.astype(np.uint64) + np.uint64(77))
    whole = np.add.reduceat(marks, bounds[:-1]) if len(of) else np.zeros(0, np.uint64)
    _, lead, kind = np.unique(whole, return_index=True, return_inverse=True)
    kind_size = np.diff(bounds)[lead]
    kind_items = its[np.repeat(bounds[lead] - (np.cumsum(kind_size) - kind_size), kind_size) + np.arange(kind_size.sum())] if len(its) else its
    return {
        "ids": ids, "words": np.append(test, np.zeros(1, np.uint64)), "sums": sums, "left": left, "most": most, "at": at[first], "width": size[at[first]],
        "sorted": at[by], "off": off, "kind": kind, "kind_off": np.concatenate([[0], np.cumsum(kind_size)]), "kind_items": kind_items,
    }


def match_items(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """docs with RESULTS: words, merged spans of hit words, ids of items with occurring windows, longest match and its place.

    The benchmark is broadcast in blocks of bounded size; documents pass once over all shards for each block.
    """
    spark = docs.sparkSession
    total = benchmark.agg(F.sum(F.octet_length("text") + 40)).first()[0] or 0
    blocks = int(total // BLOCK_BYTES) + 1
    shard = int(min(max(SLICE_BYTES, total // blocks), SHARD_BYTES))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = docs.drop(*RESULTS)
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow()
        texts = block.column("text").combine_chunks()
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        test = spark.sparkContext.broadcast(prepare_items(block.column("item_id").to_pylist(), texts, width))
        out = _pass(out, test, shard, k > 0)
    return out


def _pass(docs: DataFrame, test, shard: int, more: bool) -> DataFrame:
    bounded_batches(docs.sparkSession)
    plain = [f for f in docs.schema.fields if f.name not in RESULTS]
    schema = T.StructType([*plain, *(T.StructField(k, t) for k, t in RESULTS.items())])

    def merge(a: list, b: list) -> list:
        out: list = []
        for s in sorted(a + b, key=lambda s: (s["start"], s["end"])):
            if out and s["start"] <= out[-1]["end"]:
                out[-1] = {"start": out[-1]["start"], "end": max(out[-1]["end"], s["end"])}
            else:
                out.append(s)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = test.value
        ids = np.array(t["ids"], dtype=object)
        spans_type, items_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())
        for piece in slices(batches, most=shard):
            words, rows = word_hashes(text_of(piece), ALNUM)
            m = match_shard(words, rows, t)
            n = len(piece)
            offsets = np.searchsorted(m["span_doc"], np.arange(n + 1)).astype(np.int32)
            spans = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(m["start"]), pa.array(m["end"])], ["start", "end"]))
            offsets = np.searchsorted(m["pair_doc"], np.arange(n + 1)).astype(np.int32)
            found = pa.ListArray.from_arrays(offsets, pa.array(ids[m["pair_item"]], pa.string()))
            longest, at = m["longest"], m["longest_at"]
            if more:
                spans = pa.array([merge(a, b) for a, b in zip(piece.column("hit_spans").to_pylist(), spans.to_pylist())], spans_type)
                found = pa.array([sorted({*a, *b}) for a, b in zip(piece.column("hit_items").to_pylist(), found.to_pylist())], items_type)
                old = piece.column("longest").to_numpy()
                at = np.where(old >= longest, piece.column("longest_at").to_numpy(), at)
                longest = np.maximum(old, longest)
            cols = [piece.column(f.name) for f in plain] + [pa.array(m["n_words"]), spans, found, pa.array(longest), pa.array(at)]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.mapInArrow(run, schema)


def hit_report(matched: DataFrame) -> DataFrame:
    ids = F.array_sort(F.array_distinct("hit_items"))
    return matched.select(
        "doc_id", "n_words", F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s.end - s.start).alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"), "longest", "longest_at",
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """docs without those in which a window occurs; columns as before."""
    rest = [c for c in docs.columns if c != "text"]
    only = docs.select(F.struct(F.lit(0), *rest).alias("row"), "text")
    kept = match_items(only, benchmark, width).where(F.size("hit_spans") == 0)
    return kept.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
