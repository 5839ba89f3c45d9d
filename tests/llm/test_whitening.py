import math

import numpy as np
import pytest

from sparkloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, component int, key int"


def brute(rows, wanted=16):
    """(n, trace, eigenvalues, components in rows, {vec_id: deviation}, {vec_id: centred})."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    whole = [(i, tuple(math.floor(float(np.float32(c)) * 64) + 1_000_000 for c in v)) for i, v in good]
    fit = sorted({v for _, v in whole})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    exact = np.array([[n * a - b for a, b in zip(v, s)] for v in fit], dtype=object)
    centred = exact.astype(float) / n
    _, sigma, q = np.linalg.svd(centred, full_matrices=False)  # the covariance's own eigenvectors would lose half the digits
    e = sigma**2 / n
    off = {i: [n * a - b for a, b in zip(v, s)] for i, v in whole}
    return n, e.sum(), e[:wanted], q[:wanted], {i: sum(a * a for a in o) for i, o in off.items()}, {i: np.array(o, float) / n for i, o in off.items()}


def check(rows, found, wanted=16, close=1e-9):
    n, trace, e, q, far, centred = brute(rows, wanted)
    m = int((e > 1e-13 * trace).sum())
    assert sorted((r.vec_id, r.component) for r in found) == sorted((i, k + 1) for i in far for k in range(m))
    by = {(r.vec_id, r.component): r for r in found}
    signs = {}
    for (i, k), r in by.items():
        want = centred[i] @ q[k - 1] / math.sqrt(e[k - 1])
        if abs(want) > 1e-3:
            signs.setdefault(k, np.sign(want * r.whitened))
        assert (r.n, r.deviation) == (n, far[i])
        assert abs(r.whitened * signs.get(k, 1) - want) <= close * max(1, abs(want)) or abs(want) <= 1e-3 and abs(abs(r.whitened) - abs(want)) <= close
        assert abs(r.explained - e[k - 1] / trace) <= 1e-10 and r.identity_error <= 1e-9
    return m


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 3, 4) for r in rows], SCHEMA)


def vectors(n, d, seed, spread=None):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) * (spread if spread is not None else np.linspace(3, 0.5, d)) @ np.linalg.qr(rng.standard_normal((d, d)))[0]
    return [(i, [float(c) for c in row]) for i, row in enumerate(x)]


def test_same_as_brute_force(spark):
    rows = vectors(300, 24, 1)
    odd = [(900, None), (901, []), (902, [float("nan")] * 24), (903, [None] + [1.0] * 23), (904, [float("inf")] * 24), (905, rows[3][1]), (906, rows[3][1]), (907, rows[9][1])]
    assert check(rows + odd, whitening.whiten(table(spark, rows + odd)).collect()) == 16


def test_repeated_rows_and_null_keys(spark):
    rows = vectors(60, 5, 2)
    found = whitening.whiten(table(spark, [*rows, rows[7], rows[7], (None, rows[8][1])])).collect()
    assert check(rows, [r for k, r in enumerate(found) if r.vec_id not in (None, 7)] + list({r.component: r for r in found if r.vec_id == 7}.values())) == 5
    assert sum(r.vec_id == 7 for r in found) == 15 and sum(r.vec_id is None for r in found) == 5 and {r.n for r in found} == {60}


def test_less_rank_than_dimensions(spark):
    rows = [(i, [float(i), float(i * 2), 1.0, float(i % 2)]) for i in range(40)]
    found = whitening.whiten(table(spark, rows)).collect()
    assert {r.component for r in found} == {1, 2} and max(r.identity_error for r in found) < 1e-9
    assert check(rows, found) == 2


def test_equal_eigenvalues_all_come(spark):
    """Corners of a cube: all variances are alike, and the first step's space ends at once."""
    rows = [(i, [4.0 * (i >> b & 1) for b in range(4)]) for i in range(16)]
    found = whitening.whiten(table(spark, rows)).collect()
    assert {r.component for r in found} == {1, 2, 3, 4} and all(abs(r.explained - 0.25) < 1e-12 and r.identity_error < 1e-12 for r in found)


def test_steep_spectrum(spark):
    rows = vectors(200, 12, 5, spread=10.0 ** np.linspace(4, -2, 12))
    check(rows, whitening.whiten(table(spark, rows)).collect(), close=1e-7)


def test_stops_when_converged(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ALL_STEPS", 3)
    rows = vectors(300, 40, 6, spread=np.r_[[60, 40, 25], np.full(37, 0.1)])
    df = table(spark, rows).select(whitening.steps_of("embedding", 64, 1_000_000).alias("x"))
    assert whitening.fit(df, 3).steps < 40
    assert check(rows, whitening.whiten(table(spark, rows), wanted=3).collect(), wanted=3) == 3


def test_many_parts(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MOST_PARTS", 2)
    monkeypatch.setattr(whitening, "BLOCK", 7)
    rows = vectors(100, 6, 7)
    df = table(spark, rows).repartition(5).select(whitening.steps_of("embedding", 64, 1_000_000).alias("x"))
    fitted = whitening.fit(df, 6)
    assert fitted.n == 100 and whitening.identity_error(df, fitted) < 1e-10


def test_odd_tables(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    with pytest.raises(ValueError):
        whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0])]))
