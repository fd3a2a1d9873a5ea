"""Embedding near-duplicates by spherical-cap filters from a structured random product code.

Each of `CODES` codes turns the space at random and cuts it in two blocks; its filters are all concatenations of one of
`WORDS` random codewords for each block, so WORDS squared directions on the sphere. A vector is list-decoded to every
direction with which its inner product is at least a cap, without looking at the others: the best word of one block
bounds which words of the other can follow. The cap is `CAP` at 64 dimensions. Shorter vectors are filled with zeros to 64, which
changes no inner product, so their filters are as many and as good; beyond 64 the cap is that which a vector exceeds as often as
CAP at 64. Of pairs with a cosine of exactly 0.93 about 998 in 1000 share a filter, whatever the dimension, and more of closer ones;
a vector exceeds about 71 filters on average.

Vectors of a label meet in a filter and are compared there exactly, in double precision. Those that have a link in a filter come
again with the list of their filters; then each pair counts in the first filter that both exceed. Filters with many
vectors are compared in pairs of chunks, as n_links counts every pair.

Equal vectors of a label count as one class, with a weight, until the end. Vectors without a label, null or zero vectors and those
with null or non-finite components link with nothing, nor do vectors of different lengths. vec_id identifies vectors: rows that
repeat it are one vector, never linked with each other, in one component; n_links sums the links of its rows with rows of other ids (to
take out links within an id, rows of one id that differ are compared in all pairs). Rows without vec_id have no links and no
component and are not kept. An empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import mark, settled
from .common import whole_groups, written
from .components import components

LEAST = 0.93
CODES, WORDS, CAP, SEED = 4, 512, 0.455, 20240131
#: Dimensions that CAP is made for, and the filters that a vector must be expected to exceed.
CAP_DIM, FEWEST = 64, 50
#: Vectors of a filter that are compared in one piece, and filters whose members are marked at once.
CHUNK, MARKED = 500, 2048


def product_codes(dim: int, seed: int = SEED) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each code of at least CAP_DIM dimensions a rotation and the words of its two blocks, of length 1 / sqrt(2)."""
    out, dim = [], max(dim, CAP_DIM)
    for k in range(CODES):
        rng = np.random.default_rng([seed, dim, k])
        turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        words = [rng.standard_normal((WORDS, d)) for d in (dim // 2, dim - dim // 2)]
        out.append((turn, *(w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-12) / 2**0.5 for w in words)))
    return out


def share_beyond(cap: float, dim: int) -> float:
    """The share of the unit sphere whose inner product with a direction is at least cap."""

    def mass(t: np.ndarray) -> float:
        return float(np.trapezoid(np.exp((dim - 3) / 2 * np.log(np.maximum(1 - t * t, 1e-300))), t))

    return mass(np.linspace(cap, 1, 20_001)) / (2 * mass(np.linspace(0, 1, 20_001)))


@functools.cache
def cap_of(dim: int) -> float:
    """CAP, or in more dimensions the cap that vectors exceed as often."""
    if dim <= CAP_DIM:
        return CAP
    want, low, high = share_beyond(CAP, CAP_DIM), 0.0, CAP
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if share_beyond(mid, dim) > want else (low, mid)
    if (expected := CODES * WORDS**2 * share_beyond(low, dim)) < FEWEST:
        raise ValueError(f"vectors of {dim} dimensions exceed {expected:.1f} filters on average, fewer than {FEWEST}")
    return low


def list_decode(x: np.ndarray, codes: list[tuple[np.ndarray, np.ndarray, np.ndarray]], cap: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unit vectors x, ascending, and the filters that they exceed: (code * WORDS + first word) * WORDS + second word."""
    cap = cap_of(x.shape[1]) if cap is None else cap
    rows, ids = [], []
    x = np.pad(x, ((0, 0), (0, max(0, len(codes[0][0]) - x.shape[1]))))
    for c, (turn, first, second) in enumerate(codes):
        y = x @ turn
        left, right = y[:, : first.shape[1]] @ first.T, y[:, first.shape[1] :] @ second.T
        can_left = left >= cap - right.max(1, keepdims=True)
        can_right = right >= cap - left.max(1, keepdims=True)
        for k in range(len(x)):
            i, j = np.flatnonzero(can_left[k]), np.flatnonzero(can_right[k])
            a, b = np.nonzero(left[k, i][:, None] + right[k, j] >= cap)
            rows.append(np.full(len(a), k))
            ids.append((c * WORDS + i[a]) * WORDS + j[b])
    r, f = np.concatenate(rows), np.concatenate(ids)
    order = np.argsort(r, kind="stable")
    return r[order], f[order]


def unit_rows(col: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    """Packed vectors of one length as unit rows of doubles."""
    x = np.frombuffer(b"".join(col.to_pylist()), kind).reshape(len(col), -1).astype(float)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def marked(vectors: DataFrame) -> DataFrame:
    """vec_id, label, vector (doubles), and fine: whether it can link."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    fine = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("vector"), fine.alias("fine"))


def filters(classes: DataFrame, kind: str) -> DataFrame:
    """class, label, dim, n, packed (the vector), found (bytes of the filters it exceeds) and filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, list] = {}
        for batch in batches:
            for at in range(0, len(batch), 512):
                piece = batch.slice(at, 512)
                lens = pc.list_value_length(piece.column("vector")).to_numpy()
                for dim in np.unique(lens).tolist():
                    take = piece.take(pa.array(np.flatnonzero(lens == dim)))
                    packed = take.column("vector").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)
                    packed = pa.array([v.tobytes() for v in packed], pa.binary())
                    if dim not in codes:
                        codes[dim] = product_codes(dim)
                    r, f = list_decode(unit_rows(packed, kind), codes[dim])
                    off = np.searchsorted(r, np.arange(len(take) + 1))
                    f = f.astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(f))
                    found = pa.array([f[a:b].tobytes() for a, b in zip(off[:-1], off[1:])], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [take.column("class"), take.column("label"), pa.array(np.full(len(take), dim, np.int32)), take.column("n"), packed, found, lists],
                        names=["class", "label", "dim", "n", "packed", "found", "filters"],
                    )

    label = classes.schema["label"].dataType.simpleString()
    return classes.mapInArrow(run, f"class long, label {label}, dim int, n long, packed binary, found binary, filters array<int>")


KEYS = ["label", "dim", "filter"]


def chunked(rows: DataFrame) -> DataFrame:
    """Rows (label, dim, filter, class) of filters with two vectors or more, once for each pair (low, high) of chunks that they belong to."""
    sizes = rows.groupBy(KEYS).agg(F.count("*").alias("size")).where("size > 1")
    met = rows.join(sizes, KEYS).withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int"))
    met = met.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return met.select(*KEYS, "class", "chunk", F.least("chunk", "with").alias("low"), F.greatest("chunk", "with").alias("high"))


def groups_of(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Tables of whole groups with vectors of one length, the offsets of the groups, and the unit vectors."""
    for t, bounds in whole_groups(batches, [*KEYS, "low", "high"]):
        dims = t.column("dim").to_numpy()[bounds[:-1]]
        for dim in np.unique(dims).tolist():
            for run in np.split(own := np.flatnonzero(dims == dim), np.flatnonzero(np.diff(own) > 1) + 1):
                part = t.slice(int(bounds[run[0]]), int(bounds[run[-1] + 1] - bounds[run[0]]))
                yield part, bounds[run[0] : run[-1] + 2] - bounds[run[0]], unit_rows(part.column("packed"), kind)


def linked_pairs(x: np.ndarray, chunk: np.ndarray, cross: bool, least: float = LEAST) -> tuple[np.ndarray, np.ndarray]:
    hit = np.triu(x @ x.T >= least, 1)
    if cross:
        hit &= chunk[:, None] != chunk[None, :]
    return np.nonzero(hit)


def dealt(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *KEYS, "low", "high").sortWithinPartitions(*KEYS, "low", "high", "class")


def meeting(rows: DataFrame, kind: str) -> DataFrame:
    """label, dim, filter and class of vectors that have a link in the filter, or miss it by a rounding error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds, x in groups_of(batches, kind):
            chunk, cross = t.column("chunk").to_numpy(), t.column("low").to_numpy() != t.column("high").to_numpy()
            some = np.zeros(len(t), bool)
            two = bounds[:-1][np.diff(bounds) == 2]
            near = two[(np.einsum("ij,ij->i", x[two], x[two + 1]) >= LEAST - 1e-9) & (~cross[two] | (chunk[two] != chunk[two + 1]))]
            some[near] = some[near + 1] = True
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if b - a > 2:
                    i, j = linked_pairs(x[a:b], chunk[a:b], cross[a], LEAST - 1e-9)
                    some[a + i] = some[a + j] = True
            yield from t.select([*KEYS, "class"]).filter(pa.array(some)).to_batches()

    label = rows.schema["label"].dataType.simpleString()
    return dealt(rows).mapInArrow(run, f"label {label}, dim int, filter int, class long").distinct()


def apart(found: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For pairs (i, j) of members whether their sorted lists have no common value; values of one member only need no look."""
    names, code, times = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    who = np.repeat(np.arange(len(found)), [len(f) for f in found])
    code, who = (np.cumsum(times > 1) - 1)[code[keep := times[code] > 1]], who[keep]
    order = np.argsort(code, kind="stable")
    code, who = code[order], who[order]
    met = np.zeros(len(i), bool)
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, MARKED):
        a, b = np.searchsorted(code, [at, at + MARKED])
        sets = np.zeros((len(found), MARKED), np.float32)
        sets[who[a:b], code[a:b] - at] = 1
        met |= (sets @ sets.T)[i, j] > 0
    return ~met


def counted(rows: DataFrame, kind: str) -> DataFrame:
    """Links of each vector, each pair in the first filter of both (id, null, n), and a spanning forest (id, other, 0)."""

    def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
        root, tree = list(range(n)), []

        def top(v: int) -> int:
            while root[v] != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        for p, q in zip(i.tolist(), j.tolist()):
            if (u := top(p)) != (v := top(q)):
                root[max(u, v)] = min(u, v)
                tree.append((p, q))
        return tree

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds, x in groups_of(batches, kind):
            rep, n, chunk, this = (t.column(c).to_numpy() for c in ("class", "n", "chunk", "filter"))
            cross = t.column("low").to_numpy() != t.column("high").to_numpy()
            found = [np.frombuffer(v, np.int32) for v in t.column("found").to_pylist()]
            out: list[tuple[int, int | None, int]] = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                i, j = linked_pairs(x[a:b], chunk[a:b], cross[a])
                if len(i):
                    first = apart([f[f < this[a]] for f in found[a:b]], i, j)
                    i, j = i[first], j[first]
                if len(i):
                    own, w = rep[a:b], n[a:b]
                    total = np.bincount(i, w[j], b - a) + np.bincount(j, w[i], b - a)
                    out += [(int(own[k]), None, int(total[k])) for k in np.flatnonzero(total)]
                    out += [(int(own[p]), int(own[q]), 0) for p, q in forest(b - a, i, j)]
            cols = zip(*out) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["id", "other", "n"])

    return dealt(rows).mapInArrow(run, "id long, other long, n long")


def within_ids(rows: DataFrame) -> DataFrame:
    """(vec_id, own): ordered pairs of linked rows of one vec_id, a row with itself included, from rows(vec_id, class, label, vector, times)."""
    same = rows.groupBy("vec_id").agg(F.sum(F.col("times") * F.col("times")).alias("own"), F.count("*").alias("kinds"))
    repeated = rows.join(same.where("kinds > 1").select("vec_id"), "vec_id")
    a, b = (repeated.select("vec_id", "label", *(F.col(c).alias(f"{c}_{k}") for c in ("class", "vector", "times"))) for k in "ab")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda t, v: t + v)
    cosine = dot("vector_a", "vector_b") / F.sqrt(dot("vector_a", "vector_a") * dot("vector_b", "vector_b"))
    pairs = a.join(b, ["vec_id", "label"]).where((F.col("class_a") != F.col("class_b")) & (F.size("vector_a") == F.size("vector_b")) & (cosine >= LEAST))
    more = pairs.groupBy("vec_id").agg(F.sum(F.col("times_a") * F.col("times_b")).alias("more"))
    return same.join(more, "vec_id", "left").select("vec_id", (F.col("own") + F.coalesce("more", F.lit(0))).alias("own"))


def link_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors(vec_id, label, embedding)."""
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    start = mark()
    every = marked(vectors)
    rows = every.where("fine").groupBy("vec_id", "label", "vector").agg(F.count("*").alias("times"))
    classes = written(rows.groupBy("label", "vector").agg(F.sum("times").alias("n")).withColumn("class", F.monotonically_increasing_id()), "classes")
    rows = written(rows.join(classes.select("class", "label", "vector"), ["label", "vector"]), "vectors")
    coded = written(filters(classes, kind), "filters")
    met = chunked(coded.select("label", "dim", "class", F.explode("filters").alias("filter")))
    near = written(meeting(met.join(coded.select("class", "packed"), "class"), kind), "meetings")
    found = written(counted(chunked(near).join(coded.select("class", "n", "packed", "found"), "class"), kind), "links")

    counts = found.where("other is null").groupBy(F.col("id").alias("class")).agg(F.sum("n").alias("links"))
    every_class = classes.select("class", "n").join(counts, "class", "left").select("class", (F.coalesce("links", F.lit(0)) + F.col("n")).alias("links"))
    ids = rows.select("vec_id", "class", "times").join(every_class, "class").groupBy("vec_id").agg(F.sum(F.col("times") * F.col("links")).alias("links"), F.min("class").alias("first"))
    # classes that hold rows of one vec_id are one component; a component is named by its smallest vec_id
    joined = rows.select("vec_id", "class").join(ids.select("vec_id", "first"), "vec_id").where("class <> first").select(F.col("class").alias("a"), F.col("first").alias("b"))
    reach = written(components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")).union(joined)), "components")
    own = ids.select("vec_id", F.col("first").alias("id")).join(reach, "id", "left").select("vec_id", F.coalesce("component", "id").alias("component"))
    names = own.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    known = ids.join(within_ids(rows), "vec_id").join(own.join(names, "component"), "vec_id").select(F.col("vec_id").alias("id"), (F.col("links") - F.col("own")).alias("n_links"), "component_id")
    out = every.select("vec_id").join(known, F.col("vec_id") == known["id"], "left")
    component = F.coalesce("component_id", "vec_id")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
    return settled(out, "vector-links", start)
