"""MinHash near-duplicates by a chosen-path set similarity join.

A document is the set of its distinct five-word shingles. Independent trees branch documents by the values of
selected minwise coordinates: a document falls into one child per selected coordinate, so two documents with
similarity s meet again in about s / SPLIT children of a node they share. Nodes of at most LEAF documents
are compared exhaustively by their minwise values. In a larger one, those alike to a picked document form a cluster with it,
as branching would not part them; each of the others is compared with all of them, and the others branch on. Nodes of at most
LOCAL documents branch inside one task, larger ones as a round of Spark jobs, in pairs of blocks where they compare. Nodes that
are still large at the last level are compared exhaustively too, so no size loses a pair. Trees are added until, at the depth
that they reached, all of them together lose at most MISS of the pairs at exactly the threshold that have enough equal minwise
values to be candidates.

What is alike by minwise values forms clusters. In a cluster, chunks of documents and the cluster's best connected ones
are compared exhaustively on the full shingle sets; of clusters with several chunks, documents outside the component of
the best connected one are then compared with all others in blocks. Equal sets count as one class until the end.
Pairs are never written: each group gives stars of what is linked in it.

Nulls: a null text, or one without words, has an empty set and is linked with nothing; a text of fewer words is one shingle.
doc_id identifies documents: rows that repeat it share one component, to which each of their texts can link; rows without it have
no component and are not kept. An empty table gives none. Other columns are ignored or kept.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import mark, settled, small
from .common import BROADCAST_BYTES, NOT_SPACE, bounded_batches, mix, slices, text_of, whole_groups, word_hashes, written
from .components import components

WIDTH = 5
#: Similarity in hundredths.
LEAST = 75
COORDINATES, TREES, LEVELS = 96, 12, 10
#: Documents of a node that are compared exhaustively, and of one that branches inside a task.
LEAF, LOCAL = 2000, 8000
#: Share of the candidate pairs at exactly the threshold that all trees may lose.
MISS = 3e-5
#: Documents of a large node of which the one that is alike to most of the others is picked; documents of one side of a comparison.
PICKS, BLOCK = 8, 4096
#: Best connected documents of a cluster that come to each of its chunks; documents and shingles of a chunk.
HUBS, CHUNK_DOCS, CHUNK_SHINGLES = 8, 700, 400_000
#: Shingles that so many documents of a chunk have are counted by matrix products, that many at once.
COMMON, MARKED = 16, 2048
#: Selected coordinates of a node on average are 1 / SPLIT.
SPLIT = 0.7
#: Equal minwise values, of COORDINATES, that make a candidate: four standard deviations below the threshold.
ALIKE = int(COORDINATES * LEAST / 100 - 4 * (COORDINATES * LEAST / 100 * (1 - LEAST / 100)) ** 0.5)
_FACTORS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB)) | np.uint64(1)
_PLACES = mix(np.arange(11, 11 + WIDTH, dtype=np.uint64) * np.uint64(0x8EBC6AF09C88C6E3)) | np.uint64(1)


def shingle_sets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and their offsets."""
    h, rows = word_hashes(col, NOT_SPACE)
    lens = np.diff(rows)
    n = np.where(lens >= WIDTH, lens - WIDTH + 1, np.minimum(lens, 1))
    off = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(rows[:-1] - off[:-1], n) + np.arange(off[-1])
    size = np.repeat(np.minimum(lens, WIDTH), n)
    key = size.astype(np.uint64)
    padded = np.concatenate([h, np.zeros(WIDTH, np.uint64)])
    for k in range(WIDTH):
        key += np.where(size > k, padded[at + k], 0) * _PLACES[k]
    key = mix(key)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        if b - a > 1:
            key[a:b].sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    new[off[:-1][n > 0]] = True
    return key[new], np.concatenate([[0], np.cumsum(new)])[off]


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (equal for equal sets), values (minwise, 4 bytes each) and brief (their lowest bytes)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, most=300_000):
            key, off = shingle_sets(text_of(piece))
            n = np.diff(off)
            some = np.flatnonzero(n)
            starts = off[:-1][some]
            values = np.zeros((len(piece), COORDINATES), np.uint32)
            sums = np.zeros((2, len(piece)), np.uint64)
            if len(some):
                for k in range(COORDINATES):
                    values[some, k] = np.minimum.reduceat(key * _FACTORS[k], starts) >> np.uint64(32)
                sums[0, some] = np.add.reduceat(key, starts)
                sums[1, some] = np.add.reduceat(mix(key ^ np.uint64(0x2545F4914F6CDD1D)), starts)
            cols = [piece.column("doc_id"), pa.array(n), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64))]
            for v in (values, values.astype(np.uint8)):
                width = v.shape[1] * v.itemsize
                cols.append(pa.Array.from_buffers(pa.binary(), len(piece), [None, pa.py_buffer((np.arange(len(piece) + 1) * width).astype(np.int32)), pa.py_buffer(v.tobytes())]))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "set_a", "set_b", "values", "brief"])

    schema = "doc_id long, n_shingles long, set_a long, set_b long, values binary, brief binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def matrix(col: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if not len(col):
        return np.zeros((0, COORDINATES), kind)
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]].view(kind).reshape(len(col), COORDINATES)


def chosen(node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each node its first coordinate, and a second one or -1: 1 / SPLIT of them on average."""
    h = mix(node.view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    first = (h % np.uint64(COORDINATES)).astype(np.int64)
    other = (first + 1 + ((h >> np.uint64(20)) % np.uint64(COORDINATES - 1)).astype(np.int64)) % COORDINATES
    more = ((h >> np.uint64(40)) & np.uint64(0xFFFF)).astype(np.float64) / 65536 < 1 / SPLIT - 1
    return first, np.where(more, other, -1)


def children(node: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children that rows of nodes fall into: row numbers and child ids."""
    rows, ids = [], []
    for c in chosen(node):
        r = np.flatnonzero(c >= 0)
        key = node[r].view(np.uint64) * np.uint64(0x9FB21C651E98DF25) + (c[r].astype(np.uint64) << np.uint64(32)) + values[r, c[r]]
        rows.append(r)
        ids.append(mix(key + np.uint64(1)).view(np.int64))
    return np.concatenate(rows), np.concatenate(ids)


def lost(depth: int, trees: int) -> float:
    """Share of pairs at exactly the threshold that are candidates but meet at that depth of no tree.

    A pair with k equal values meets in a child of each selected coordinate with a chance of k / COORDINATES; all trees see the same values."""
    s, total = LEAST / 100, 0.0
    for k in range(ALIKE, COORDINATES + 1):
        p, gone = k / COORDINATES, 0.0
        for _ in range(depth):
            gone = (1 - p * (1 - gone)) * (1 - (1 / SPLIT - 1) * p * (1 - gone))
        total += math.comb(COORDINATES, k) * s**k * (1 - s) ** (COORDINATES - k) * gone**trees
    return total


def trees_for(depth: int) -> int:
    return next(n for n in itertools.count(TREES) if lost(depth, n) <= MISS)


#: TREES at least, and as many as the deepest level may ask for.
ROOTS = mix(np.arange(1, trees_for(LEVELS) + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)).view(np.int64)


def first_level(reps: DataFrame, roots: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                piece = batch.slice(at, 4096)
                values, ids = matrix(piece.column("values"), np.uint32), piece.column("doc_id").to_numpy()
                for root in roots:
                    r, node = children(np.full(len(ids), root), values)
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(ids[r])], names=["node", "doc_id"])

    return reps.select("doc_id", "values").mapInArrow(run, "node long, doc_id long")


def words_of(m: np.ndarray) -> np.ndarray:
    """Rows of bytes as columns of 8-byte words."""
    return np.ascontiguousarray(m.copy().view(np.uint64).T)


def equal(words: np.ndarray, one: np.ndarray) -> np.ndarray:
    """For each column of words the bytes that equal those of one."""
    x = words ^ one[:, None]
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    return COORDINATES - np.bitwise_count((((x & low) + low) | x) & ~low).sum(0, dtype=np.uint16)


def picked(large: DataFrame, brief: DataFrame) -> DataFrame:
    """(node, first, first_brief): of PICKS documents of each node, picked by hashes, the one that most of them are alike."""
    picks = large.groupBy("node").agg(F.array_distinct(F.array(*[F.min_by("doc_id", F.xxhash64("node", "doc_id", F.lit(k))) for k in range(PICKS)])).alias("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in whole_groups(batches, ["node"]):
            w = words_of(matrix(t.column("brief"), np.uint8))
            best = [a + int(np.argmax([(equal(w[:, a:b], w[:, k]) >= ALIKE).sum() for k in range(a, b)])) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            t = t.take(pa.array(best)).combine_chunks()
            yield pa.RecordBatch.from_arrays([t.column(c).chunk(0) for c in ("node", "doc_id", "brief")], names=["node", "first", "first_brief"])

    n = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = picks.withColumn("doc_id", F.explode("doc_id")).join(brief, "doc_id").repartition(n, "node").sortWithinPartitions("node", "doc_id")
    return dealt.mapInArrow(run, "node long, first long, first_brief binary")


def next_level(rows: DataFrame) -> DataFrame:
    """Rows of large nodes (node, doc_id, first, values, brief, first_brief): whether it is alike to the node's picked document, and if not, its children."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                piece = batch.slice(at, 4096)
                node = piece.column("node").to_numpy()
                near = (matrix(piece.column("brief"), np.uint8) == matrix(piece.column("first_brief"), np.uint8)).sum(1) >= ALIKE
                far = np.flatnonzero(~near)
                r, child = children(node[far], matrix(piece.column("values"), np.uint32)[far])
                r = far[r]
                order = np.argsort(r, kind="stable")
                off = np.searchsorted(r[order], np.arange(len(piece) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("node"), piece.column("doc_id"), piece.column("first"), pa.array(near), pa.ListArray.from_arrays(pa.array(off), pa.array(child[order]))],
                    names=["node", "doc_id", "first", "near", "children"],
                )

    return rows.mapInArrow(run, "node long, doc_id long, first long, near boolean, children array<long>")


def all_of(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def in_blocks(large: DataFrame) -> DataFrame:
    """(node, level, doc_id) of large nodes(node, n, doc_id), with a node for each pair of blocks that a document belongs to."""
    rows = large.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("node", "doc_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("blocks = 1 or own <> with or own = 0")
    return rows.select(F.xxhash64("node", F.least("own", "with"), F.greatest("own", "with")).alias("node"), F.lit(LEVELS).alias("level"), "doc_id")


def in_sides(step: DataFrame, counts: DataFrame) -> DataFrame:
    """(node, i, j, doc_id, first, near): documents alike to the picked one beside all that are not, in pairs of blocks."""
    rows = step.where("doc_id <> first").join(counts.where("took > 1 and took < n"), "node")
    near, far = F.ceil(F.col("took") / BLOCK).cast("int"), F.ceil((F.col("n") - F.col("took")) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node", "doc_id"), F.when(F.col("near"), near).otherwise(far)).cast("int")
    rows = rows.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.when(F.col("near"), far).otherwise(near) - 1)))
    i, j = (F.when(F.col("near"), F.col(a)).otherwise(F.col(b)) for a, b in (("own", "with"), ("with", "own")))
    return rows.select("node", i.alias("i"), j.alias("j"), "doc_id", "first", "near")


def alike_stars(reps: DataFrame) -> DataFrame:
    """(a, b, n) of what is alike in the trees: stars; n is a number of documents that b is alike."""
    found, done, need = [], 0, TREES
    while len(roots := ROOTS[done:need]):
        stars, depth = stars_of(reps, roots)
        found.append(stars)
        done, need = need, max(need, trees_for(depth))
    return all_of(found).groupBy("a", "b").agg(F.sum("n").alias("n"))


def stars_of(reps: DataFrame, roots: np.ndarray) -> tuple[DataFrame, int]:
    """(a, b, n) of what is alike in the trees of the roots, and the number of levels that they have."""
    rows, groups, sides, stars = first_level(reps, roots), [], [], []
    brief = reps.select("doc_id", "brief")
    for level in range(1, LEVELS + 1):
        sizes = rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        both = written(rows.join(sizes, "node"), "nodes")
        groups.append(both.where(F.col("n") <= LOCAL).select("node", F.lit(level).alias("level"), "doc_id"))
        large = both.where(F.col("n") > LOCAL)
        if large.isEmpty():
            break
        if level == LEVELS:
            groups.append(in_blocks(large))
            break
        firsts = written(picked(large, brief), "picked")
        step = written(next_level(large.select("node", "doc_id").join(firsts, "node").join(reps.select("doc_id", "values", "brief"), "doc_id")), "branches")
        counts = step.groupBy("node", F.col("first").alias("b")).agg(F.count_if("near").alias("took"), F.count("*").alias("n"))
        stars.append(counts.where("took > 1").select(F.col("b").alias("a"), "b", (F.col("took") - 1).alias("n")))
        stars.append(step.where("near and doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"), F.lit(1).cast("long").alias("n")))
        sides.append(in_sides(step, counts.drop("b")))
        rows = step.where("not near").select(F.explode("children").alias("node"), "doc_id")
    stars.append(branched(all_of(groups), brief))
    if sides:
        stars.append(beside(all_of(sides), brief))
    stars = written(all_of(stars), "stars")
    deepest = stars.where("a is null").agg(F.max("n")).first()[0]
    return stars.where("a is not null"), max(level, deepest or 0)


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def alike_in(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each column of words the first one that it reaches by what is alike, and how many it is alike."""
    top, n = np.arange(w.shape[1]), np.zeros(w.shape[1], np.int64)
    for k in range(w.shape[1] - 1):
        near = k + 1 + np.flatnonzero(equal(w[:, k + 1 :], w[:, k]) >= ALIKE)
        if not len(near):
            continue
        n[k] += len(near)
        n[near] += 1
        own = np.append(top[near], top[k])
        if (own != own[0]).any():
            top[np.isin(top, own)] = own.min()
    return top, n


def alike_across(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each right column of words the number of left ones that it is alike."""
    n = np.zeros(right.shape[1], np.int64)
    if left.shape[1] <= right.shape[1]:
        for k in range(left.shape[1]):
            n += equal(right, left[:, k]) >= ALIKE
    else:
        for k in range(right.shape[1]):
            n[k] = (equal(left, right[:, k]) >= ALIKE).sum()
    return n


def branch(m: np.ndarray, node: int, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Branches the rows of brief values m from a node on that level: stars (a, b, n) of row numbers, and the deepest level."""
    words, out, deepest = words_of(m), [(np.zeros(0, np.int64),) * 3], level
    todo = [(node, level, np.arange(len(m)))]
    while todo:
        node, level, rows = todo.pop()
        deepest = max(deepest, level)
        if len(rows) == 2:
            if (m[rows[0]] == m[rows[1]]).sum() >= ALIKE:
                out.append((rows[:1], rows[1:], np.ones(1, np.int64)))
            continue
        if len(rows) <= LEAF or level >= LEVELS:
            top, n = alike_in(words[:, rows])
            some = np.flatnonzero(n)
            out.append((rows[top[some]], rows[some], n[some]))
            continue
        own = words[:, rows]
        picks = np.argsort(mix(rows.astype(np.uint64) ^ np.int64(node).view(np.uint64)), kind="stable")[:PICKS]
        near = max((equal(own, own[:, k]) >= ALIKE for k in picks.tolist()), key=lambda x: int(x.sum()))
        inner, outer = np.flatnonzero(near), np.flatnonzero(~near)
        if len(inner) > 1:
            first = rows[inner[0]]
            n = alike_across(own[:, inner], own[:, outer])
            some = np.flatnonzero(n)
            ends = np.concatenate([rows[inner], rows[outer[some]]])
            out.append((np.full(len(ends), first), ends, np.concatenate([np.full(len(inner), len(inner) - 1), n[some]])))
        r, child = children(np.full(len(outer), node), m[rows[outer]])
        order = np.argsort(child, kind="stable")
        cuts = np.flatnonzero(np.diff(child[order])) + 1
        todo += [(int(child[order[a]]), level + 1, rows[outer[r[order[a:b]]]]) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(r)]) if b - a > 1]
    a, b, n = (np.concatenate(x) for x in zip(*out))
    return a, b, n, deepest


def branched(rows: DataFrame, brief: DataFrame) -> DataFrame:
    """(a, b, n) of what is alike in each node of rows(node, level, doc_id), which branches on in one task; the deepest level as n beside null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deepest = 0
        for t, bounds in whole_groups(batches, ["node"]):
            ids, node, level = (t.column(c).to_numpy() for c in ("doc_id", "node", "level"))
            m = matrix(t.column("brief"), np.uint8)
            two = bounds[:-1][np.diff(bounds) == 2]
            two = two[(m[two] == m[two + 1]).sum(1) >= ALIKE]
            out = [(ids[two], ids[two + 1], np.ones(len(two), np.int64))]
            for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if y - x > 2:
                    a, b, n, depth = branch(m[x:y], int(node[x]), int(level[x]))
                    deepest = max(deepest, depth)
                    out.append((ids[x + a], ids[x + b], n))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=PAIR)
        yield pa.RecordBatch.from_pydict({"a": [None], "b": [None], "n": [deepest]}, schema=PAIR)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.join(brief, "doc_id").repartition(parts, "node").sortWithinPartitions("node", "doc_id")
    return dealt.mapInArrow(run, "a long, b long, n long")


def beside(rows: DataFrame, brief: DataFrame) -> DataFrame:
    """(a, b, n): documents of the far side that are alike to n of the near side of a group, joined to its picked document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in whole_groups(batches, ["node", "i", "j"]):
            ids, first = t.column("doc_id").to_numpy(), t.column("first").to_numpy()
            near, words = t.column("near").to_numpy(zero_copy_only=False).astype(bool), words_of(matrix(t.column("brief"), np.uint8))
            out = [(ids[:0], ids[:0], ids[:0])]
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                left, right = a + np.flatnonzero(near[a:b]), a + np.flatnonzero(~near[a:b])
                n = alike_across(words[:, left], words[:, right])
                some = np.flatnonzero(n)
                out.append((first[right[some]], ids[right[some]], n[some]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=PAIR)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.join(brief, "doc_id").repartition(n, "node", "i", "j").sortWithinPartitions("node", "i", "j", "doc_id")
    return dealt.mapInArrow(run, "a long, b long, n long")


def shared_shingles(key: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For documents i < j the number of shingles that both have, [i, j] of a square matrix."""
    n = len(off) - 1
    doc = np.repeat(np.arange(n), np.diff(off))
    order = np.argsort(key, kind="stable")
    doc = doc[order]
    first = np.flatnonzero(np.append(True, np.diff(key[order]) != 0)) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(key)))
    both = np.zeros((n, n), np.float32)
    for t in range(2, COMMON):
        start = first[times == t]
        for part in np.array_split(start, 1 + len(start) * t * t // 2_000_000):
            who = doc[part[:, None] + np.arange(t)]
            i, j = np.triu_indices(t, 1)
            both += np.bincount((who[:, i] * n + who[:, j]).ravel(), minlength=n * n).reshape(n, n)
    start, times = first[times >= COMMON], times[times >= COMMON]
    for at in range(0, len(start), MARKED):
        size = times[at : at + MARKED]
        marks = np.zeros((n, len(size)), np.float32)
        marks[doc[np.repeat(start[at : at + MARKED] - (np.cumsum(size) - size), size) + np.arange(size.sum())], np.repeat(np.arange(len(size)), size)] = 1
        both += marks @ marks.T
    return both


def joined_rows(text: pa.Array, component: np.ndarray, query: np.ndarray) -> np.ndarray:
    """The component of each text after links between a query and any other; equal numbers are joined already."""
    key, off = shingle_sets(text)
    size, (_, top) = np.diff(off), np.unique(component, return_inverse=True)
    both = np.triu(shared_shingles(key, off), 1)
    link = (100 * both >= LEAST * (size[:, None] + size[None, :] - both)) & (both > 0) & (query[:, None] | query[None, :]) & (top[:, None] != top[None, :])
    i, j = np.nonzero(link)
    while len(i):  # smaller numbers spread along links and through components until none changes
        least = top.copy()
        np.minimum.at(least, i, top[j])
        np.minimum.at(least, j, top[i])
        lead = np.arange(top.max() + 1)
        np.minimum.at(lead, top, least)
        lead = lead[lead]
        if (lead[top] == top).all():
            break
        top = lead[top]
    return top


def linked(rows: DataFrame, docs: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b): what reaches the threshold on full sets in each group of rows(keys, doc_id, source, set_a, component, query), as stars.

    Compared are all pairs of which one is a query and whose components differ. Texts, found by the id `source`, come to the rows: if few are
    needed the rows are broadcast to the documents, else both are shuffled by that id. Of texts under one id that with the row's set counts."""
    rows = written(rows.select(*keys, "doc_id", F.col("source").alias("text_id"), "set_a", "component", "query"), "groups")
    if rows.count() * 80 <= BROADCAST_BYTES:
        rows = F.broadcast(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("text_id"), "text").join(rows, "text_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in whole_groups(batches, keys):
            ids, comp, want = (t.column(c).to_numpy() for c in ("doc_id", "component", "set_a"))
            query, text = t.column("query").to_numpy(zero_copy_only=False).astype(bool), t.column("text").combine_chunks()
            text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
            out = [(ids[:0], ids[:0])]
            for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                own = pc.fill_null(text.slice(x, y - x), "")
                new = np.append(True, np.diff(ids[x:y]) != 0)
                if not new.all():  # ids with several rows or texts: the first row with the right set
                    key, off = shingle_sets(own)
                    right = np.array([int(key[p:q].sum(dtype=np.uint64).astype(np.int64)) == w for p, q, w in zip(off, off[1:], want[x:y].tolist())])
                    _, first = np.unique(ids[x:y][right], return_index=True)
                    keep = np.flatnonzero(right)[first]
                else:
                    keep = np.arange(y - x)
                if len(keep) < 2:
                    continue
                at = x + keep
                top = joined_rows(own.take(pa.array(keep)), comp[at], query[at])
                order = np.argsort(top, kind="stable")
                lead = order[np.flatnonzero(np.append(True, np.diff(top[order]) != 0))]
                first = np.zeros(top.max() + 1, np.int64)
                first[top[lead]] = at[lead]
                some = comp[at] != comp[first[top]]
                out.append((ids[first[top[some]]], ids[at[some]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], names=["a", "b"])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = texts.select(*keys, "doc_id", "set_a", "component", "query", "text").repartition(n, *keys).sortWithinPartitions(*keys, "doc_id")
    return by.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs(doc_id, text)."""
    start = mark()
    every = written(describe(docs), "sets")
    some = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    classes = every.where(some).groupBy("set_a", "set_b").agg(F.min("doc_id").alias("source")).withColumn("class", F.monotonically_increasing_id())
    classes = written(classes, "classes")
    full = every.where(some).withColumnRenamed("doc_id", "source").join(classes, ["source", "set_a", "set_b"]).dropDuplicates(["class"])
    reps = written(full.select(F.col("class").alias("doc_id"), "source", "set_a", "n_shingles", "values", "brief"), "reps")  # from here on ids are those of classes
    alike = written(alike_stars(reps), "alike")
    cluster = written(components(alike.select("a", "b")).withColumnsRenamed({"id": "doc_id", "component": "cluster"}), "clusters")

    # chunks of each cluster, and its best connected documents in each of them
    own = cluster.join(reps.select("doc_id", "source", "set_a", "n_shingles"), "doc_id")
    sizes = own.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / CHUNK_DOCS), F.ceil(F.sum("n_shingles") / CHUNK_SHINGLES)).cast("int").alias("chunks"))
    own = written(own.join(sizes, "cluster").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int")), "members")
    degree = alike.groupBy(F.col("b").alias("doc_id")).agg(F.sum("n").alias("degree"))
    wide = own.where("chunks > 1").join(degree, "doc_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    best = wide.withColumn("place", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("degree"), "doc_id"))).where(F.col("place") <= HUBS)
    best = written(best.drop("degree"), "hubs")
    spread = best.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("to <> chunk")
    rows = own.select("cluster", "chunk", "doc_id", "source", "set_a").union(spread.select("cluster", F.col("to").alias("chunk"), "doc_id", "source", "set_a"))
    links = written(linked(rows.select("*", F.col("doc_id").alias("component"), F.lit(True).alias("query")), docs, ["cluster", "chunk"]), "links")

    # of clusters with several chunks: what is outside the best document's component, against all
    if not best.isEmpty():
        found = written(components(links), "components")
        state = own.where("chunks > 1").join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        main = best.where("place = 1").select("cluster", "doc_id").join(state.select("doc_id", F.col("component").alias("main")), "doc_id").select("cluster", "main")
        state = state.join(F.broadcast(main) if main.count() * 32 <= BROADCAST_BYTES else main, "cluster").withColumn("query", F.col("component") != F.col("main"))
        open_ = state.groupBy("cluster").agg(F.ceil(F.count_if("query") / CHUNK_DOCS).cast("int").alias("blocks")).where("blocks > 0")
        state = written(state.join(open_, "cluster"), "open")
        asked = state.where("query").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("blocks")).cast("int"))
        asked = asked.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        base = state.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cols = ["cluster", "chunk", "block", "doc_id", "source", "set_a", "component", "query"]
        rows = asked.withColumn("chunk", F.col("to")).select(*cols).union(base.select(*cols)).groupBy(*cols[:-1]).agg(F.max("query").alias("query"))
        links = links.union(written(linked(rows, docs, ["cluster", "chunk", "block"]), "links"))

    # classes that hold rows of one doc_id are one component; a component is named by its smallest doc_id
    ids = every.where(some).select("doc_id", "set_a", "set_b").join(classes.drop("source"), ["set_a", "set_b"]).select("doc_id", "class").distinct()
    ids = written(ids.join(ids.groupBy("doc_id").agg(F.min("class").alias("first")), "doc_id"), "ids")
    more = ids.where("class <> first").select(F.col("first").alias("a"), F.col("class").alias("b"))
    found = written(components(links.union(more)), "components")
    own = ids.where("class = first").join(found, ids["first"] == found["id"], "left").select("doc_id", F.coalesce("component", "first").alias("group"))
    names = own.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    named = own.join(names, "group").select(F.col("doc_id").alias("id"), "component_id")
    out = every.select("doc_id", "n_shingles").join(named, F.col("doc_id") == named["id"], "left")
    component = F.coalesce("component_id", "doc_id")
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
    return settled(out, "near-duplicates", start)


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without those whose component holds a smaller doc_id; columns as before."""
    gone = small(near_duplicates(docs).where("doc_id is not null and not kept").select(F.col("doc_id").alias("gone")), 16)  # ids only; texts stay where they are
    return docs.alias("docs").join(gone.alias("found"), F.col("docs.doc_id") == F.col("found.gone"), "left_anti")
