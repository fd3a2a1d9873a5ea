"""Hard negatives by angular triangle filtering.

Components c become integers x = floor(SCALE * c); a score is the integer inner product of two such vectors. Each row stores
its angles to DIRECTIONS reference directions. Rows are sorted by label, nearest direction and the angle to it, and cut into windows
of up to WINDOW rows, which know the least and largest angle to each direction and the least and largest length. By the triangle
inequality on the sphere the angle between an anchor and any row of a window lies between the largest gap and the
smallest sum of their angles to a direction; the cosines of that interval times the lengths, widened for rounding, bound all scores
of the window. Only windows whose bounds overlap what an anchor still looks for are scored, exactly, in integers.

Anchors are dealt in the same order into blocks. A first round meets each block with the windows of its own labels and
directions, which gives every anchor a score that its positives must reach; then windows are sent only to the blocks whose
bounds they overlap, where they stream past the anchors, which keep their best rows and raise what they look for. Memory of a task is a block of anchors
and a batch of windows. A hot label or many equal vectors are cut into windows and blocks like others.

The directions come from at most SAMPLE rows (those with the smallest hashes of vec_id); the result does not depend on them. The driver collects, and
broadcasts, a summary for each block of anchors: at most BLOCKS times DIRECTIONS rows, as blocks grow with the number of anchors beyond BLOCKS * ANCHORS.

Rows take part if label and vec_id are not null and their vector has no null or non-finite component, has the most frequent
length (of equally frequent ones the largest) and a squared integer length below 2^62, so that scores are longs. Zero vectors score 0. Rows that
repeat a vec_id stand for themselves, as anchors and as candidates, but are never positives of each other. Ties go to the smaller
vec_id. Anchors without positives, and positives without negatives, have no rows; nor has an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import mark, settled
from .common import bounded_batches, release, smallest_hashes, written

SCALE = 256
DIRECTIONS, SAMPLE = 16, 2_000
#: Rows and bytes of a window; anchors of a block, and most blocks before they grow.
WINDOW, WINDOW_BYTES, ANCHORS, BLOCKS = 128, 65_536, 2_048, 4_096
#: Radians by which an angle may be off, and the share of the product of lengths by which a bound may.
PAD, PAD_SCORE = 1e-6, 1e-9
#: Stands for no bound.
NO_LOW, NO_HIGH = -(2**63), 2**63 - 1
#: Rows found that are held before they are cut to the best.
HELD = 8_192

ORDER = ["label", "cell", "angle", "vec_id"]
PACK = "label long, cell int, pack long, n int, rows binary, ids binary, x binary, near binary, far binary, short double, long double"


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """row, vec_id, label, anchor and v (doubles) of the rows that take part, and the length of their vectors."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & (F.size(v) > 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = vectors.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.coalesce("anchor", F.lit(False)).alias("anchor"), v.alias("v"))
    length = F.aggregate("v", F.lit(0.0), lambda t, c: t + F.floor(c * SCALE).cast("double") * F.floor(c * SCALE).cast("double"))
    rows = rows.where(F.forall("v", lambda c: F.abs(c) < 2.0**31 / SCALE) & (length < 2.0**62 * (1 - 1e-9)))
    most = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    dim = most.dim if most else 0
    return rows.where(F.size("v") == dim).withColumn("row", F.monotonically_increasing_id()), dim


def integers(col: pa.Array, dim: int) -> np.ndarray:
    return np.floor(SCALE * pc.list_flatten(col).to_numpy(zero_copy_only=False).reshape(-1, dim)).astype(np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def reference_directions(sample: np.ndarray, most: int = DIRECTIONS) -> np.ndarray:
    """Unit vectors far from each other among the sample, then moved to the middles of what is nearest to each."""
    u = unit(sample)
    u = u[np.any(u != 0, axis=1)]
    if not len(u):
        return np.eye(1, sample.shape[1])
    chosen, nearest = [0], u @ u[0]
    while len(chosen) < min(most, len(u)) and nearest.min() < 1 - 1e-9:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, u @ u[chosen[-1]])
    out = u[chosen]
    for _ in range(3):
        own = (u @ out.T).argmax(1)
        sums = np.array([u[own == k].sum(0) for k in range(len(out))])
        out = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 1e-9, unit(sums), out)
    return out


def angles_to(x: np.ndarray, directions: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit(x) @ directions.T, -1, 1))


def coded(rows: DataFrame, dim: int, directions: np.ndarray) -> DataFrame:
    """rows with x and all angles as bytes, the nearest direction and the angle to it."""
    shared = rows.sparkSession.sparkContext.broadcast(directions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(batch.column("v"), dim)
            t = angles_to(x, shared.value)
            cell = t.argmin(1) if len(t) else np.zeros(0, np.int64)
            cols = [batch.column(c) for c in ("row", "vec_id", "label", "anchor")]
            cols += [pa.array(cell.astype(np.int32)), pa.array(t[np.arange(len(t)), cell]), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([v.tobytes() for v in t], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "vec_id", "label", "anchor", "cell", "angle", "x", "angles"])
        release()

    return rows.select("row", "vec_id", "label", "anchor", "v").mapInArrow(run, "row long, vec_id long, label long, anchor boolean, cell int, angle double, x binary, angles binary")


def packed(rows: DataFrame, dim: int, most: int, extra: str = "") -> DataFrame:
    """Sorted rows as windows (PACK): neighbours of one label and cell, at most so many, with what bounds their angles and lengths; extra is a column that is constant in each."""
    keys = ["label", "cell", *([extra] if extra else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            if not len(batch):
                continue
            key = np.array([batch.column(k).to_numpy() for k in keys])
            cut = np.flatnonzero(np.append(True, np.any(key[:, 1:] != key[:, :-1], axis=0)))
            starts = np.concatenate([np.arange(a, b, most) for a, b in zip(cut, np.append(cut[1:], len(batch)))])
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.int64).reshape(-1, dim)
            t = np.frombuffer(b"".join(batch.column("angles").to_pylist())).reshape(len(x), -1)
            size = np.linalg.norm(x.astype(float), axis=1)
            row, ids = batch.column("row").to_numpy(), batch.column("vec_id").to_numpy()
            out = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(x)]):
                own = [int(k[a]) for k in key]
                out.append((*own[:2], number, b - a, row[a:b].tobytes(), ids[a:b].tobytes(), x[a:b].tobytes(), t[a:b].min(0).tobytes(), t[a:b].max(0).tobytes(), size[a:b].min(), size[a:b].max(), *own[2:]))
                number += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        release()

    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5, pa.float64(), pa.float64(), *([pa.int32()] if extra else [])]
    schema = pa.schema(list(zip([*(c.split()[0] for c in PACK.split(", ")), *([extra] if extra else [])], kinds)))
    return rows.mapInArrow(run, PACK + (f", {extra} int" if extra else ""))


def score_bounds(angles: np.ndarray, sizes: np.ndarray, near: np.ndarray, far: np.ndarray, short: float | np.ndarray, long: float | np.ndarray, width: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score that anchors (angles, sizes) can have with a window whose angles lie in [near, far] and lengths in [short, long].

    width: how much larger the anchor's own angles may be, if `angles` are the least of a block; sizes are then its largest."""
    gap = np.maximum(angles - far, near - angles - width).max(-1) - 2 * PAD
    reach = np.minimum(angles + width + far, 2 * np.pi - angles - near).min(-1) + 2 * PAD
    above, below = np.cos(np.clip(gap, 0, np.pi)), np.cos(np.clip(reach, 0, np.pi))
    pad = PAD_SCORE * sizes * long + 1
    return sizes * np.where(below >= 0, short, long) * below - pad, sizes * np.where(above >= 0, long, short) * above + pad


class Block:
    """Anchors of a block, the score windows [low, high] that each looks in, and the best `most` rows of each window so far."""

    def __init__(self, rows: list[dict], most: int, same: bool):
        self.most, self.same = most, same
        cat = lambda c, kind: np.frombuffer(b"".join(r[c] for r in rows), kind)
        self.row, self.ids = cat("rows", np.int64), cat("ids", np.int64)
        n = len(self.row)
        self.x = cat("x", np.int64).reshape(n, -1)
        self.angles = np.repeat(cat("near", float).reshape(len(rows), -1), [r["n"] for r in rows], 0)
        self.label = np.repeat([r["label"] for r in rows], [r["n"] for r in rows])
        self.sizes = np.linalg.norm(self.x.astype(float), axis=1)
        windows = cat("windows", np.int64).reshape(n, -1, 2)
        self.low, self.high = windows[:, :, 0].copy(), windows[:, :, 1].copy()
        self.held: list[np.ndarray] = []  # rows of (anchor, window, score, id)
        self.number = 0

    def cut(self) -> None:
        """Keeps the best rows of each window and raises what is looked for to the last of them."""
        a, w, s, i = np.concatenate(self.held, axis=1) if self.held else np.zeros((4, 0), np.int64)
        order = np.lexsort((i, -s, w, a))
        a, w, s, i = a[order], w[order], s[order], i[order]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (w[1:] != w[:-1]))) if len(a) else np.zeros(0, np.int64)
        rank = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
        last = rank == self.most - 1
        self.low[a[last], w[last]] = np.maximum(self.low[a[last], w[last]], s[last])
        keep = rank < self.most
        self.held, self.number = [np.array([a[keep], w[keep], s[keep], i[keep]])], 0

    def meet(self, pack: dict) -> None:
        low, high = score_bounds(self.angles, self.sizes, np.frombuffer(pack["near"]), np.frombuffer(pack["far"]), pack["short"], pack["long"])
        open_ = ((high[:, None] >= self.low) & (low[:, None] <= self.high) & (self.low <= self.high)).any(1)
        who = np.flatnonzero(open_ & ((self.label == pack["label"]) == self.same))
        if not len(who):
            return
        ids = np.frombuffer(pack["ids"], np.int64)
        y = np.frombuffer(pack["x"], np.int64).reshape(len(ids), -1)
        if self.sizes[who].max() * pack["long"] < 2**53:  # doubles are exact then
            score = (self.x[who].astype(float) @ y.T.astype(float)).astype(np.int64)
        else:
            score = self.x[who] @ y.T
        for w in range(self.low.shape[1]):
            hit = (score >= self.low[who, w, None]) & (score <= self.high[who, w, None])
            if self.same:
                hit &= self.ids[who, None] != ids
            i, j = np.nonzero(hit)
            if len(i):
                self.held.append(np.array([who[i], np.full(len(i), w), score[i, j], ids[j]]))
                self.number += len(i)
        if self.number > HELD:
            self.cut()


def searched(anchors: DataFrame, packs: DataFrame, groups: int, most: int, same: bool) -> DataFrame:
    """anchor (row), w, score, id: the best `most` rows of each window of each anchor, for each group of packs that its block meets.

    anchors: PACK of single rows, block, windows; packs: PACK and block."""
    names = [*(c.split()[0] for c in PACK.split(", ")), "windows"]
    a = anchors.select(*names, "block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(0).alias("kind"))
    p = packs.select(*names[:-1], F.lit(None).cast("binary").alias("windows"), "block", F.pmod(F.xxhash64("pack"), F.lit(groups)).cast("int").alias("group"), F.lit(1).alias("kind"))
    keys = ["block", "group"]
    parts = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = a.unionByName(p).repartition(parts, *keys).sortWithinPartitions(*keys, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, block = None, [], None

        def done() -> pa.RecordBatch:
            block.cut()
            a, w, s, i = block.held[0]
            return pa.RecordBatch.from_arrays([pa.array(block.row[a]), pa.array(w.astype(np.int32)), pa.array(s), pa.array(i)], names=["anchor", "w", "score", "id"])

        for batch in batches:
            for r in batch.to_pylist():
                if (r["block"], r["group"]) != key:
                    if block:
                        yield done()
                    key, rows, block = (r["block"], r["group"]), [], None
                if r["kind"] == 0:
                    rows.append(r)
                elif rows:
                    block = block or Block(rows, most, same)
                    block.meet(r)
        if block:
            yield done()
        release()

    return dealt.mapInArrow(run, "anchor long, w int, score long, id long")


def best(found: DataFrame, most: int) -> DataFrame:
    """The first `most` rows of each window of each anchor, with their rank; groups of packs have cut them to a few before."""
    w = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def summaries(anchors: DataFrame) -> dict[str, np.ndarray]:
    """For each block of anchors: number, least and largest label, angles, length, and the hull of the score windows."""
    found = anchors.select("block", "label", "near", "long", "windows").mapInArrow(hulls, "block int, label_low long, label_high long, near array<double>, far array<double>, long double, low long, high long")
    at = F.posexplode(F.arrays_zip("near", "far")).alias("at", "t")
    wide = found.select("*", at).groupBy("block", "at").agg(
        F.min("label_low").alias("label_low"), F.max("label_high").alias("label_high"), F.min("t.near").alias("near"), F.max("t.far").alias("far"), F.max("long").alias("long"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    got = sorted(wide.collect(), key=lambda r: (r.block, r.at))
    if not got:
        return {"block": np.zeros(0, np.int64)}
    n = len({r.block for r in got})
    out = {c: np.array([r[c] for r in got]).reshape(n, -1) for c in ("near", "far")}
    return out | {c: np.array([r[c] for r in got if r.at == 0]) for c in ("block", "label_low", "label_high", "long", "low", "high")}


def hulls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block of a batch, so that few rows are exploded."""
    for batch in batches:
        block, label, long = (batch.column(c).to_numpy() for c in ("block", "label", "long"))
        if not len(block):
            continue
        t = np.frombuffer(b"".join(batch.column("near").to_pylist())).reshape(len(block), -1)
        lows, highs = zip(*((int(w[::2].min()), int(w[1::2].max())) for w in (np.frombuffer(b, np.int64) for b in batch.column("windows").to_pylist())))
        lows, highs = np.array(lows), np.array(highs)
        rows = []
        for b in np.unique(block):
            own = block == b
            rows.append((int(b), label[own].min(), label[own].max(), t[own].min(0).tolist(), t[own].max(0).tolist(), long[own].max(), lows[own].min(), highs[own].max()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.int64(), pa.int64()))],
            names=["block", "label_low", "label_high", "near", "far", "long", "low", "high"],
        )


def overlapping(packs: DataFrame, anchors: DataFrame, same: bool) -> DataFrame:
    """packs once for each block of anchors that may look for some of their rows."""
    shared = packs.sparkSession.sparkContext.broadcast(summaries(anchors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        for batch in batches:
            lists = []
            for r in batch.select(["label", "near", "far", "short", "long"]).to_pylist():
                if not len(b["block"]):
                    lists.append([])
                    continue
                # the largest length bounds what is positive; a negative bound of shorter anchors is nearer to zero, so zero bounds it
                low, high = score_bounds(b["near"], b["long"], np.frombuffer(r["near"]), np.frombuffer(r["far"]), r["short"], r["long"], b["far"] - b["near"])
                fits = (np.maximum(high, 0) >= b["low"]) & (np.minimum(low, 0) <= b["high"])
                own = (b["label_low"] <= r["label"]) & (r["label"] <= b["label_high"]) if same else (b["label_low"] != r["label"]) | (b["label_high"] != r["label"])
                lists.append(b["block"][fits & own].tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], names=[*batch.schema.names, "blocks"])

    return packs.mapInArrow(run, PACK + ", blocks array<int>").withColumn("block", F.explode("blocks")).drop("blocks")


def window_bytes(rows: DataFrame, least: int, most: int) -> DataFrame:
    """anchor and windows of rows(anchor, scores): for each positive score p, falling, the scores s with least * p <= 100 * s <= most * p."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.array([(-((-least * p) // 100), most * p // 100) for p in scores], np.int64).tobytes() for scores in batch.column("scores").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("anchor"), pa.array(out, pa.binary())], names=["anchor", "windows"])

    return rows.mapInArrow(run, "anchor long, windows binary")


def one_window(low) -> F.Column:
    """Bytes of a window without an upper bound."""

    def little(c) -> F.Column:
        return F.unhex(F.concat(*(F.substring(F.lpad(F.hex(c), 16, "0"), 15 - 2 * i, 2) for i in range(8))))

    return F.concat(little(low), little(F.lit(NO_HIGH)))


def mine(vectors: DataFrame, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows(vec_id, label, embedding, anchor).

    The positives of an anchor are its best other rows of its label; the negatives of a positive with score p the best rows of other labels whose score s has least * p <= 100 * s <= most * p."""
    start, spark = mark(), vectors.sparkSession
    bounded_batches(spark)
    rows, dim = usable(vectors)
    if not dim:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    sample = np.array([r.v for r in smallest_hashes(rows.select("vec_id", "v"), "vec_id", SAMPLE).collect()], float).reshape(-1, dim)
    every = written(coded(rows, dim, reference_directions(np.floor(SCALE * sample))), "coded")
    total, n = every.agg(F.count("*"), F.count_if("anchor")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 200_000))
    packs = written(packed(every.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER), dim, max(1, min(WINDOW, WINDOW_BYTES // (8 * dim)))), "windows")

    dealt, blocks, block = every.where("anchor"), max(1, min(BLOCKS, -(-n // ANCHORS))), F.lit(0)
    if blocks > 1:
        dealt = dealt.repartitionByRange(blocks, *ORDER)
        block = (F.spark_partition_id() * blocks / dealt.rdd.getNumPartitions()).cast("int")
    dealt = dealt.withColumn("block", block)
    anchors = written(packed(dealt, dim, 1, "block"), "anchors").withColumn("anchor", little_long(F.col("rows")))
    groups = max(1, -(-parts // blocks))

    # what positives must reach, from windows of the same label and direction; then all windows that can hold them
    own = anchors.select("label", "cell", "block").distinct()
    first = searched(anchors.withColumn("windows", one_window(F.lit(NO_LOW))), packs.join(own, ["label", "cell"]), groups, positives, True)
    reached = written(best(first, positives).where(F.col("rank") == positives).select("anchor", F.col("score").alias("low")), "reached")
    looking = written(anchors.join(reached, "anchor", "left").withColumn("windows", one_window(F.coalesce("low", F.lit(NO_LOW)))).drop("low"), "looking")
    good = written(best(searched(looking, overlapping(packs, looking, True), groups, positives, True), positives).drop("w"), "positives")

    scores = good.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda s: s.score).alias("scores"))
    looking = written(anchors.join(window_bytes(scores, least, most).select("anchor", F.rpad("windows", 16 * positives, no_window()).alias("windows")), "anchor"), "looking")
    bad = best(searched(looking, overlapping(packs, looking, False), groups, negatives, False), negatives)

    pairs = good.select("anchor", F.col("rank").alias("of"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    hard = bad.select("anchor", (F.col("w") + 1).alias("of"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = anchors.select("anchor", little_long(F.col("ids")).alias("anchor_id")).join(pairs, "anchor").join(hard, ["anchor", "of"])
    return settled(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "hard-negatives", start)


def no_window() -> F.Column:
    """Bytes of a window that holds no score."""
    return F.unhex(F.lit(np.array([1, 0], np.int64).tobytes().hex()))


def little_long(c: F.Column) -> F.Column:
    """The long of eight bytes, the lowest first."""
    turned = F.concat(*(F.substring(c, 8 - i, 1) for i in range(8)))
    high = F.conv(F.hex(F.substring(turned, 1, 4)), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(F.conv(F.hex(F.substring(turned, 5, 4)), 16, 10).cast("long"))
