import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import hardneg

SCHEMA = "vec_id long, label int, embedding array<float>, id string, rank int, score int"


def brute(rows, every=5, positives=5, negatives=3, low=50, high=95):
    """Sorted (anchor, positive, rank, negative, scores) of rows (id, label, vector)."""
    lowest = lambda i: -math.inf if i is None else i
    good = [(i, label, [math.floor(float(np.float32(c)) * 256) for c in v]) for i, label, v in rows if label is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, label, v in good:
        if i is None or i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), lowest(j), other) for j, other, w in good if j != i)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            hard = [(n, j) for n, j, other in scored if other != label and low * -s <= 100 * -n <= high * -s][:negatives]
            out += [(i, p, k + 1, j, -s, -n) for k, (n, j) in enumerate(hard)]
    return sorted(out)


def found(spark, rows, every=5, parts=3, **kw):
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA).repartition(parts)
    lowest = lambda i: -math.inf if i is None else i
    return sorted((r.anchor_id, lowest(r.positive_id), r["rank"], lowest(r.negative_id), r.positive_score, r.negative_score) for r in hardneg.mine(df, F.col("vec_id") % every == 0, **kw).collect())


def vectors(n, d, seed, labels=4, spread=1.0):
    rng = np.random.default_rng(seed)
    heart = rng.standard_normal((labels, d))
    out = []
    for i in range(n):
        k = int(rng.integers(labels))
        out.append((i, k, [float(c) for c in (heart[k] + spread * rng.standard_normal(d)) * rng.uniform(0.2, 2)]))
    return out


@pytest.mark.parametrize("spread", [0.1, 0.6, 3.0])
def test_same_as_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(hardneg, "BUCKET", 13)
    monkeypatch.setattr(hardneg, "BLOCK", 4)
    rows = vectors(230, 8, int(spread * 10), spread=spread)
    odd = [(500, None, [1.0] * 8), (505, 1, None), (510, 1, []), (515, 2, [None] * 8), (520, 2, [float("nan")] * 8), (525, 0, [float("-inf")] * 8), (530, 3, [0.0] * 8), (None, 1, rows[4][2]), (None, 2, rows[9][2])]
    copies = [(600 + i, rows[i][1], rows[i][2]) for i in range(0, 40, 3)] + [(700 + i, (rows[i][1] + 1) % 4, rows[i][2]) for i in range(0, 40, 3)]
    want = brute(rows + odd + copies)
    assert found(spark, rows + odd + copies) == want and want


def test_pruning_loses_no_vector():
    """Whatever reaches the bound is a candidate, and close vectors leave few candidates."""
    rng = np.random.default_rng(2)
    heart = hardneg.scaled(rng.standard_normal((6, 10)))[0] * 900
    m = np.rint(heart[rng.integers(6, size=400)] + rng.standard_normal((400, 10)) * 12)
    unit, lengths = hardneg.scaled(m)
    order = np.argsort(unit.T, axis=1).astype("<u2")
    bucket = hardneg.Bucket.of(np.arange(400).tobytes(), np.zeros(400, "<i8").tobytes(), m.astype("<i4").tobytes(), order.tobytes())
    shares = []
    for q in m[:40]:
        s = m @ q
        for least in (s.max(), np.sort(s)[-5], np.median(s), 1.0, 0.0, -5.0, s.max() * 2):
            near = bucket.candidates(q, float(np.sqrt(q @ q)), float(least))
            near = np.arange(400) if near is None else near
            assert set(np.flatnonzero(s >= least)) <= set(near)
            assert (bucket.scores(q, near) == s[near]).all()
        near = bucket.candidates(q, float(np.sqrt(q @ q)), float(np.sort(s)[-5]))
        shares.append(1.0 if near is None else len(near) / 400)
    assert np.mean(shares) < 0.4
    assert len(bucket.candidates(m[0] * 0, 0.0, 1.0)) == 0


def test_groups_that_are_too_short_see_no_anchor(spark):
    """Rows of length 1 and of length 100: those that ask for much are sent to the long ones only."""
    rows = vectors(60, 4, 3)
    df = spark.createDataFrame([(*r, "", 1, 2) for r in rows], SCHEMA)
    blocks = hardneg.blocks_of(hardneg.rows_of(df, "vec_id", "label", "embedding", 256, F.col("vec_id") % 5 == 0).where("anchor"), 12)
    bounds = blocks.select(F.posexplode(hardneg.ids_of("ids")).alias("at", "i"), "block").select((F.col("block") * hardneg.BLOCK + F.col("at")).alias("anchor"), F.lit(0).alias("place"), F.lit(10**9).alias("low"), F.lit(0).cast("long").alias("high"))
    need = [r.need for r in hardneg.bounded(blocks, bounds).collect()]
    assert all(n > 0 for n in need) and [r.need for r in hardneg.bounded(blocks, bounds.where("anchor % 2 = 0")).collect()] == [None] * len(need)


def test_equal_lengths_fill_several_groups(spark):
    """A third of the rows is one vector: they fall to more than one group."""
    rows = vectors(60, 4, 5) + [(1000 + i, 1, [1.0, 2.0, 0.5, 0.25]) for i in range(40)]
    df = hardneg.rows_of(spark.createDataFrame([(*r, "", 1, 2) for r in rows], SCHEMA), "vec_id", "label", "embedding", 256, F.lit(False))
    of = {}
    for r in hardneg.buckets_of(df, 5).collect():
        of.setdefault(r.group, []).extend(np.frombuffer(r.ids, "<i8").tolist())
    assert sum(any(i >= 1000 for i in ids) for ids in of.values()) >= 2 and sorted(i for ids in of.values() for i in ids) == sorted(r[0] for r in rows)
    assert found(spark, rows) == brute(rows)


def test_odd_tables(spark):
    assert found(spark, []) == [] and found(spark, [(1, 1, [1.0])]) == []
    assert found(spark, [(0, 1, [1.0]), (5, 2, [1.0])]) == []
    with pytest.raises(ValueError):
        found(spark, [(0, 1, [1.0, 2.0]), (5, 1, [1.0])])
