"""Whitening and hard negatives against brute force: odd rows, ties, equal and few vectors, clusters of eigenvalues, clashing columns."""

import numpy as np
import pytest

SF = "/root/testdata/sf0.01"


# 12 ----------------------------------------------------------------------------------------------
def spread_out(values, seed):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return (q * np.array(values, float)) @ q.T


@pytest.mark.parametrize(
    "values",
    [[5, 4, 3, 2, 1], [3, 3, 3, 1, 0.5, 0.5], [2] * 7, [1e6, 1e6 - 1e-3, 5, 0, 0, 0], [7], [4, 1], list(np.linspace(1, 1.001, 40)), [0, 0, 0], [1e-8, 1e-9, 1e-10, 0, 0]],
)
def test_leading_vectors_of_any_spectrum(values):
    from newsloom.llm import whitening

    a = spread_out(values, len(values))
    k = min(8, len(values))
    e, u = whitening.leading_vectors(a, k)
    size = max(abs(np.array(values)).max(), 1e-290)
    assert np.abs(e - np.sort(values)[::-1][:k]).max() <= 1e-13 * size * len(values)
    assert np.abs(u.T @ u - np.eye(k)).max() < 1e-12
    assert np.abs(a @ u - u * e).max() <= 1e-12 * size


def test_sturm_counts_and_split_matrices():
    from newsloom.llm import whitening

    diag, off = np.array([1.0, 2.0, 3.0, 3.0, 5.0, 1.0]), np.array([0.5, 0.0, 1.0, 0.0, 0.25])
    t = np.diag(diag) + np.diag(off, 1) + np.diag(off, -1)
    all_values = np.linalg.eigvalsh(t)
    at = np.linspace(-1.03, 7.11, 41)  # none of them an eigenvalue
    assert whitening.count_below(diag, off, at).tolist() == [int((all_values < x).sum()) for x in at]
    e, u = whitening.leading_vectors(t, 6)
    assert np.allclose(e, all_values[::-1], atol=1e-13) and np.abs(t @ u - u * e).max() < 1e-13 and np.abs(u.T @ u - np.eye(6)).max() < 1e-12


def whitened_brute(rows, k=8):
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(1024 * float(c))) + 100000 for c in v] for _, v in good], object)
    n, s = len(x), x.sum(0)
    y = (n * x - s).astype(float) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    w = y @ u[:, ::-1][:, :k] / np.sqrt(e[::-1][:k])
    return {i: (n, int(sum(int(n * a - b) ** 2 for a, b in zip(r, s))), w[j], e[::-1][:k] / e.sum()) for j, ((i, _), r) in enumerate(zip(good, x))}


def test_whitening_like_brute_force(spark):
    from newsloom.llm import whitening

    r = np.random.default_rng(5)
    rows = [(i, [float(np.float32(c)) for c in r.standard_normal(12) @ np.diag(np.linspace(2, 0.3, 12))]) for i in range(300)]
    rows += [(400, None), (401, [1.0] * 11 + [None]), (402, [1.0] * 11 + [float("nan")]), (403, [float("inf")] * 12), (404, rows[0][1]), (405, [0.0] * 12), (-6, rows[1][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, n int, whitened string").repartition(5)
    want = whitened_brute(rows)
    got = {}
    for x in whitening.report(df).collect():
        got.setdefault(x.vec_id, {})[x.component] = x
    assert set(got) == set(want) and all(set(g) == set(range(1, 9)) for g in got.values())
    signs = np.sign([got[0][c + 1].whitened * want[0][2][c] for c in range(8)])
    for i, (n, dev, w, share) in want.items():
        for c in range(8):
            x = got[i][c + 1]
            assert (x.n, x.deviation) == (n, dev) and abs(x.whitened - signs[c] * w[c]) < 1e-8 and abs(x.explained - share[c]) < 1e-12 and x.identity_error < 1e-10


def test_whitening_of_few_equal_other_and_no_vectors(spark):
    from newsloom.llm import whitening

    kind = "vec_id long, embedding array<double>"
    make = lambda rows: spark.createDataFrame(rows, kind)
    assert whitening.report(make([])).count() == 0 and whitening.report(make([(1, None), (2, [None])])).count() == 0
    assert whitening.report(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # no direction has a variance
    two = whitening.report(make([(1, [1.0, 2.0, 0.0]), (2, [3.0, 2.0, 0.0]), (2, [3.0, 2.0, 0.0]), (None, [0.0, 1.0, 0.0]), (9, [1.0]), (8, [])])).collect()
    assert {x.component for x in two} == {1, 2} and len(two) == 8 and {x.n for x in two} == {4} and max(x.identity_error for x in two) < 1e-9
    assert whitening.report(make([(i, [float(i)]) for i in range(5)])).select("component").distinct().count() == 1
    wide = make([(i, [1e12 * i, -1e12]) for i in range(4)] + [(9, [1e300, 0.0])])  # the last does not fit 53 bits
    far = whitening.apply(wide, whitening.fit(wide)).collect()
    assert [(x.vec_id, x.deviation) for x in far] == [(i, None) for i in range(4)]  # n * x - S squared needs more than 64 bits


def test_op12_over_the_table(spark):
    from newsloom.llm import queries

    rows = [(x.vec_id, x.embedding) for x in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, got = whitened_brute(rows), {}
    for x in queries.op12_whitening(spark, SF).collect():
        got[x.vec_id, x.component] = x
    assert len(got) == 8 * len(want)
    one = next(iter(want))
    for i, (n, dev, w, share) in want.items():
        for c in range(8):
            x, sign = got[i, c + 1], np.sign(got[one, c + 1].whitened * want[one][2][c])
            assert (x.n, x.deviation) == (n, dev) and abs(x.whitened - sign * w[c]) < 1e-9 and abs(x.explained / share[c] - 1) < 1e-9 and x.identity_error < 1e-9


# 13 ----------------------------------------------------------------------------------------------
def mined_brute(rows, positives=5, negatives=3, least=50, most=95):
    from math import floor, isfinite

    good = [(i, lab, [floor(256 * c) for c in v], anchor) for i, lab, v, anchor in rows if None not in (i, lab, v) and v and all(c is not None and isfinite(c) for c in v)]
    dims = [len(g[2]) for g in good]
    good = [g for g in good if len(g[2]) == max(set(dims), key=lambda d: (dims.count(d), d))]
    out = []
    for a, lab, x, anchor in good:
        if not anchor:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, other == lab) for i, other, y, _ in good)
        for s, i, _ in [t for t in scored if t[2] and t[1] != a][:positives]:
            fits = [t for t in scored if not t[2] and least * -s <= 100 * -t[0] <= most * -s][:negatives]
            out += [(a, i, k + 1, t[1], -s, -t[0]) for k, t in enumerate(fits)]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<double>, anchor boolean, score long, block string"


def mined(spark, rows, **more):
    from newsloom.llm import negatives

    df = spark.createDataFrame([(*r, 0, "x") for r in rows], VECTORS).repartition(5)
    return sorted(tuple(x) for x in negatives.mine(df, **more).collect())


def test_negatives_like_brute_force(spark, monkeypatch):
    from newsloom.llm import negatives

    monkeypatch.setattr(negatives, "WINDOW", 7)
    monkeypatch.setattr(negatives, "ANCHORS", 9)
    monkeypatch.setattr(negatives, "HELD", 20)
    r = np.random.default_rng(2)
    base = r.standard_normal((6, 10))
    rows = [(i, int(r.integers(0, 4)), [float(c) for c in base[i % 6] * r.uniform(0.3, 3) + 0.4 * r.standard_normal(10)], i % 5 == 0) for i in range(240)]
    rows += [(300 + i, i % 3, rows[5][2], i % 2 == 0) for i in range(12)]  # equal vectors of several labels
    rows += [(400, 1, [0.0] * 10, True), (401, 1, [0.0] * 10, False), (402, None, rows[0][2], True), (403, 1, None, True), (404, 1, [1.0] * 9 + [None], True), (None, 1, rows[0][2], True)]
    rows += [(405, 1, [float("nan")] * 10, True), (406, 1, [1.0] * 3, True), (407, 9, rows[1][2], True), (408, 2, [-c for c in rows[0][2]], True), (409, 1, [1e7] * 10, True), (410, 1, rows[2][2], None)]
    want = mined_brute([x for x in rows if x[0] != 409])  # its squared length needs more than 62 bits
    assert len(want) > 400 and mined(spark, rows) == want
    assert mined(spark, rows, positives=2, negatives=6, least=20, most=110) == mined_brute([x for x in rows if x[0] != 409], 2, 6, 20, 110)


def test_negatives_of_few_rows(spark):
    one = [1.0, 2.0]
    assert mined(spark, []) == [] and mined(spark, [(1, 1, one, True)]) == [] and mined(spark, [(1, 1, one, True), (2, 1, one, True)]) == []
    assert mined(spark, [(1, 1, one, False), (2, 1, one, False), (3, 2, [0.5, 1.0], False)]) == []
    rows = [(1, 1, one, True), (1, 1, one, True), (2, 1, one, False), (3, 2, [0.5, 1.0], False), (3, 2, [0.5, 1.0], False)]  # repeated rows
    assert mined(spark, rows) == mined_brute(rows) and len(mined_brute(rows)) == 4


def test_windows_hold_all_scores():
    """Bounds of a window hold the score of each of its rows, with lengths from tiny to large, and those of a block hold its anchors'."""
    from newsloom.llm import negatives

    r = np.random.default_rng(8)
    x = np.floor(r.standard_normal((400, 6)) * 10.0 ** r.integers(0, 7, (400, 1))).astype(np.int64)
    x[:40] = x[40:80]
    directions = negatives.reference_directions(x[:100])
    t, size = negatives.angles_to(x, directions), np.linalg.norm(x.astype(float), axis=1)
    order = np.lexsort((t[:, 0], t.argmin(1)))
    tight = 0
    for at in range(0, 400, 25):
        own = order[at : at + 25]
        low, high = negatives.score_bounds(t, size, t[own].min(0), t[own].max(0), size[own].min(), size[own].max())
        score = x @ x[own].T
        assert (low[:, None] <= score).all() and (score <= high[:, None]).all()
        tight += int((high < size * size[own].max() * 0.9).sum())
        for block in np.split(order, 8):
            wide_low, wide_high = negatives.score_bounds(t[block].min(0), size[block].max(), t[own].min(0), t[own].max(0), size[own].min(), size[own].max(), t[block].max(0) - t[block].min(0))
            assert min(wide_low, 0) <= score[block].min() and score[block].max() <= max(wide_high, 0)
    assert tight > 2000
