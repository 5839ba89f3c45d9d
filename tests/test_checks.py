from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from sparkloom.operators import checks


def test_reasons(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "k int, v int")
    out = checks.with_reasons(df, {"positive": F.col("v") > 0, "odd": F.col("v") % 2 != 0})
    assert {r.k: r.reasons for r in out.collect()} == {1: [], 2: ["positive", "odd"], 3: ["positive"]}
    assert [r.k for r in checks.accepted(out).collect()] == [1] and checks.rejected(out).count() == 2


def test_schemas(spark):
    a, b = (_parse_datatype_string(x) for x in ("k int, s struct<a: int, b: string>, only string", "k long, s struct<a: int, c: double>, more int"))
    assert checks.schema_differences(a, b) == [("k", "type"), ("s.b", "left"), ("s.c", "right"), ("only", "left"), ("more", "right")]
    assert checks.merged_schema(a, b).simpleString() == "struct<k:int,s:struct<a:int,b:string,c:double>,only:string,more:int>"
