import math
import os

import pytest
from pyspark.sql import functions as F

from sparkloom import scratch
from sparkloom.operators import lookups, profiling, reports, sequences


def test_first_rows_and_numbers(spark):
    df = spark.createDataFrame([(i * 7 % 50, i) for i in range(50)], "k int, v int").repartition(6)
    got = reports.first_rows(df, ["k"], 5).orderBy("place").collect()
    assert [(r.k, r.place, r.truncated) for r in got] == [(i, i + 1, True) for i in range(5)]
    assert {r.truncated for r in reports.first_rows(df, ["k"], 50).collect()} == {False} and reports.first_rows(df.where("k < 0"), ["k"], 5).count() == 0
    assert sorted((r.k, r.place) for r in reports.numbered(df, [F.desc("k")]).collect()) == [(k, 50 - k) for k in range(50)]
    assert reports.numbered(df.where("k < 0"), ["k"]).count() == 0


def test_flow_filter(spark):
    rows = spark.createDataFrame([("udp", "a", 1, "b", 2, b"x"), ("udp", "b", 1, "a", 2, b""), ("tcp", "b", 1, "a", 3, b"y"), ("udp", "b", 1, "c", 2, b"z")], "proto string, src string, sport int, dst string, dport int, payload binary")
    n = lambda **given: rows.where(reports.of_flow(**given)).count()
    assert (n(), n(proto="udp"), n(host="a"), n(src="b", dport=2), n(sport=9)) == (3, 2, 2, 1, 0)


def test_gap_audit(spark):
    rows = {"whole": range(5), "late": range(3, 9), "single": [0, 2, 3, 5], "burst": [0, 1, 9, 10], "both": [2, 3, 7]}
    df = spark.createDataFrame([(k, n) for k, of in rows.items() for n in (*of, of[0])], "key string, n long")
    got = {r.key: (r.missing, r.gaps, r.longest, r.cause) for r in sequences.gap_audit(df, ["key"], "n", first=0).collect()}
    assert got == {"whole": (0, 0, 0, "none"), "late": (3, 1, 3, "late start"), "single": (2, 2, 1, "single losses"), "burst": (7, 1, 7, "bursts"), "both": (5, 2, 3, "bursts")}
    assert {r.key: r.missing for r in sequences.gap_audit(df, ["key"], "n").collect()}["late"] == 0
    assert spark.range(1).select(sequences.numbers_in(F.lit("SEQ=007 x SEQ=12 seq=3"))).first()[0] == [7, 12]


def test_upper_median(spark):
    rows = {"a": [3.0, 1.0, 2.0, 10.0], "b": [5.0] * 9, "c": [-1e9, 0.0, 1e-9, 2e-9, 1e9], "d": [1.0], None: [2.0, 4.0]}
    df = spark.createDataFrame([(k, v) for k, of in rows.items() for v in of] + [("a", None)], "k string, v double")
    for parts in (2, 1024):
        got = {r.k: (r.n, r.low, r.median, r.high) for r in profiling.upper_median(df, ["k"], "v", parts).collect()}
        assert got == {k: (len(of), min(of), sorted(of)[len(of) // 2], max(of)) for k, of in rows.items()}
    assert [tuple(r) for r in profiling.upper_median(df.where("k = 'a'"), [], "v").collect()] == [(4, 1.0, 3.0, 10.0)]
    assert profiling.upper_median(df.where("k = 'z'"), ["k"], "v").count() == 0 and math.isfinite(got["c"][2])


def test_routes(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1)], "kind string, day int")
    rules = spark.createDataFrame([("a", "*", "x"), ("*", "1", "y"), ("a", "1", "z"), ("*", "7", "w")], "kind string, day string, target string")
    got = sorted((repr(r.kind), r.day, r.target) for r in lookups.routed(rows, ["kind", "day"], rules, "target", "none").collect())
    assert got == sorted([("'a'", 1, "x"), ("'a'", 1, "y"), ("'a'", 1, "z"), ("'a'", 2, "x"), ("'b'", 1, "y"), ("None", 1, "y")])


def test_layers_fail_alone(spark):
    rows, failures = lookups.layers_of({"good": lambda: spark.range(3), "gone": lambda: spark.read.parquet("/no/such/place"), "odd": lambda: spark.range(1).select("nothing")})
    assert rows.count() == 3 and set(failures) == {"gone", "odd"} and failures["gone"] == "PATH_NOT_FOUND"


def test_markup_inventory(spark):
    df = spark.createDataFrame([('<?xml version="1.0"?><a b="1" c="é"><r/><r d="x"/></a>',), ("<a><r/></a>",), (None,), ("plain",)], "m string")
    got = {(r.family, r.name): r.n for r in profiling.markup_inventory(df, "m", "r").collect()}
    assert got == {("framing", "prolog"): 1, ("framing", "several"): 1, ("framing", "none"): 2, ("encoding", "utf-8"): 1, ("encoding", "ascii"): 3, ("records", "2"): 1, ("records", "1"): 1, ("records", "0"): 2, ("element", "a"): 2, ("element", "r"): 3, ("attribute", "a@b"): 1, ("attribute", "a@c"): 1, ("attribute", "r@d"): 1}


def test_tables_on_the_way_are_deleted(spark):
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(base))
    out = scratch.settled(spark, lambda: scratch.written(scratch.written(spark.range(5)).where("id > 1")))
    left = set(os.listdir(base)) - before
    assert out.count() == 3 and len(left) == 1 and os.path.dirname(out.inputFiles()[0]).removeprefix("file://") == f"{base}/{left.pop()}"


def test_scratch_folder(spark, monkeypatch):
    assert scratch.scratch_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))

    class Conf(dict):
        def get(self, name, default=None):
            return dict.get(self, name, default)

    class Session:
        conf = Conf({"spark.master": "local[2]"})

    assert scratch.scratch_dir(Session).startswith("file:///")
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        Session.conf = Conf({"spark.master": master})
        with pytest.raises(ValueError):
            scratch.scratch_dir(Session)


def test_upper_median_of_any_values(spark):
    """NaN, infinities, a range wider than a double, subnormals, decimals and texts: the element that sorting gives."""
    nan, inf = float("nan"), float("inf")
    cases = {
        "nan": [nan, nan, 1.0], "inf": [-inf, 3.0, inf, inf], "wide": [-1.5e308, 1.5e308, 0.0, 7.0, -2.0], "tiny": [5e-324, 0.0, 1e-323, 2.0], "one": [inf], "copies": [2.0] * 50 + [1.0] * 49, "all": [nan, -inf, inf, -1.5e308, 1.5e308, 5e-324],
    }
    order = lambda x: (math.isnan(x), x)
    df = spark.createDataFrame([(k, v) for k, vs in cases.items() for v in vs] + [("nan", None), (None, 4.0)], "k string, v double")
    for parts in (1, 3, 50):
        got = {r.k: (r.n, r.low, r.median, r.high) for r in profiling.upper_median(df, ["k"], "v", parts).collect()}
        for k, vs in cases.items():
            s = sorted(vs, key=order)
            assert repr(got[k]) == repr((len(s), s[0], s[len(s) // 2], s[-1])), k
        assert got[None] == (1, 4.0, 4.0, 4.0)
    decimals = df.where("k = 'copies'").select(F.lit("x").alias("k"), (F.col("v").cast("decimal(20,10)") + F.expr("CAST('0.0000000001' AS DECIMAL(20,10))")).alias("v"))
    assert str(profiling.upper_median(decimals, ["k"], "v").first().median) == "2.0000000001"
    assert profiling.upper_median(df.select(F.col("k").alias("v")).where("v > 'nan'"), [], "v").first().median == "tiny"
