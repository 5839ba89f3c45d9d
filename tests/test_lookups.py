import hashlib
import math
import random

from pyspark.sql import functions as F

from sparkloom.operators import lookups


def points(n, seed):
    rng = random.Random(seed)
    dense = [(rng.uniform(0, 1), rng.uniform(0, 1)) for _ in range(n)]
    wide = [(rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(n)]
    return [(i, *p) for i, p in enumerate(dense + wide + dense[:3])] + [(10**6, None, 1.0)]


def pairs(spark, one, two, radius):
    a = spark.createDataFrame(one, "a long, x double, y double")
    b = spark.createDataFrame(two, "b long, x double, y double")
    return lookups.within_distance(a, b, radius)


def test_pairs_in_crowded_cells(spark, monkeypatch):
    one, two = points(40, 1), points(60, 2)
    near = sorted((i, j) for i, x, y in one for j, u, v in two if x is not None and u is not None and math.hypot(x - u, y - v) <= 1.5)
    for rows in (10_000, 7):
        monkeypatch.setattr(lookups, "CELL_ROWS", rows)
        got = pairs(spark, one, two, 1.5)
        assert got.columns == ["a", "ax", "ay", "b", "bx", "by", "distance"]
        assert sorted((r.a, r.b) for r in got.collect()) == near, rows


def test_parts_of_crowded_cells_are_small(spark, monkeypatch):
    monkeypatch.setattr(lookups, "CELL_ROWS", 20)
    cell = lambda n, name: spark.range(n).select(F.col("id").alias(name), F.lit(0).alias("__i"), F.when(F.col("id") < 5, 1).otherwise(0).alias("__j"))
    left, right = lookups._parts(cell(400, "a"), cell(90, "b"))
    for side, most in ((left, 60), (right, 60)):
        assert side.groupBy("__i", "__j", "__a", "__b").count().agg(F.max("count")).first()[0] <= most
    met = left.join(right, ["__i", "__j", "__a", "__b"]).groupBy("a", "b").count()
    assert met.count() == 395 * 85 + 25 and met.where("count > 1").isEmpty()


def test_no_points(spark):
    assert pairs(spark, [], points(3, 4), 1.0).count() == 0


def test_strata_of_either_size(spark):
    rows = [(i, "ab"[i % 7 == 0]) for i in range(6000)] + [(6000, None), (6000, None)]
    df = spark.createDataFrame(rows, "id long, kind string").repartition(5)
    hashed = lambda i: hashlib.md5(f"3:{i}".encode()).hexdigest()
    for n in (4, 1500):
        want = [r for k in ("a", "b", None) for r in sorted((r for r in rows if r[1] == k), key=lambda r: hashed(r[0]))[:n]]
        got = lookups.stratified(df, ["kind"], "id", n, 3)
        assert got.columns == df.columns
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr), n
    plan = lookups.stratified(df, ["kind"], "id", 4, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # before the exchange and after it
