import datetime
import json
import os
import shutil

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import framing, tags
from sparkloom.operators import checks, schemas, sketches
from sparkloom.sources import features, files
from sparkloom.streaming import late


def counted(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**40), st.binary(max_size=300)), min_size=1, max_size=6))
def test_frames_of_messages(items):
    messages = [b"\x10" + counted(n) + b"\x1a" + counted(len(b)) + b for n, b in items]
    stream = b"".join(counted(len(m)) + m for m in messages)
    assert framing.delimited(stream) == messages
    assert framing.delimited(stream[:-1]) is None and framing.delimited(stream + b"\x05") is None


def test_framings(spark):
    message = b"\x05\x10\x01\x1a\x01a"
    values = [b"", b"\x1f\x8b\x08", b" <a/>", b"[1]", b"plain\ttext", message, message * 3, message[:-1], b"\xff\xfe", None, b"\x04\x10\x81\x00\x00", b"\x00" * 3]
    df = spark.createDataFrame([(v,) for v in values], "d binary").select(framing.framing_of(F.col("d")).alias("f"))
    assert [r.f for r in df.collect()] == ["empty", "gzip", "xml", "json", "text", "framed", "framed", "binary", "binary", None, "binary", "framed"]


def test_two_tables_of_tags(spark):
    spark.createDataFrame([(1, bytes.fromhex("0102FFFF" + "02026869" + "0701AA" + "0101FF")), (2, None), (3, b""), (4, bytes.fromhex("010280"))], "id int, r binary").createOrReplaceTempView("recs")
    tags.register(spark, "one_table", {1: tags.Tag("full", 2, 0.0, 360.0), 2: tags.Tag("word")})
    tags.register(spark, "other_table", {1: tags.Tag("raw", 2), 7: tags.Tag("low", 1, -1.0, 1.0, signed=True)})
    one = spark.sql("SELECT id, x.* FROM recs, LATERAL one_table(r) x ORDER BY id, place").collect()
    assert [(r.id, r.place, r.name, r.number, r.text) for r in one] == [(1, 0, "full", 360.0, None), (1, 1, "word", None, "hi"), (1, 2, None, None, None), (1, 3, "full", None, None)]
    other = spark.sql("SELECT id, x.* FROM recs, LATERAL other_table(r) x ORDER BY id, place").collect()
    assert [(r.name, r.number) for r in other] == [("raw", 65535.0), (None, None), ("low", -86 / 127), ("raw", None)]
    assert bytes(other[2].octets) == b"\xaa" and tags.Tag("low", 1, -1.0, 1.0, signed=True).number(b"\x80") is None


def test_paths_of_records(spark):
    texts = ['{"a": {"b": [1, {"c": 2}]}}', '{"a": "x", "d.e": true}', "3", "nope", None, "{}", '{"a": null}']
    df = spark.createDataFrame([(t, "clash") for t in texts], "j string, path string")
    got = {(r.path, r.type): (r.n, r.percent and round(r.percent, 3)) for r in schemas.json_paths(df, "j").collect()}
    assert got == {
        ("", "OBJECT"): (4, None), ("", "BIGINT"): (1, None), ("", "INVALID"): (1, None), (".a", "OBJECT"): (1, 75.0), (".a", "STRING"): (1, 75.0), (".a", "VOID"): (1, 75.0),
        (".d.e", "BOOLEAN"): (1, 25.0), (".a.b", "ARRAY"): (1, 100.0), (".a.b[]", "BIGINT"): (1, None), (".a.b[]", "OBJECT"): (1, None), (".a.b[].c", "BIGINT"): (1, 100.0),
    }
    assert schemas.json_paths(df.where("false"), "j").count() == 0


def test_schemas_of_records(spark):
    df = spark.createDataFrame([('{"a": {"OBJECT<": 1}, "odd name": [1]}',), ('{"a": {"y": "s"}, "b": 1}',), ("7",), ("bad",), (None,)], "j string")
    found = schemas.json_schema(df, "j")
    assert sorted(found["a"].dataType.names) == ["OBJECT<", "y"] and sorted(found.names) == ["a", "b", "odd name"]
    assert schemas.json_schema(df.where("j = '7'"), "j").names == [] and schemas.json_schema(df.where("false"), "j").names == []
    assert checks.schema_differences(found, schemas.json_schema(spark.createDataFrame([('{"b": "x"}',)], "j string"), "j"))[-1][0] != ""


def test_sketches_of_days(spark, tmp_path):
    day = datetime.date(2024, 1, 1)
    rows = [(day + datetime.timedelta(d), "k", float(v)) for d in range(3) for v in range(d * 500, d * 500 + 1000)] + [(day, "k", None), (day, "none", None), (day, "k", -0.0)]
    df = spark.createDataFrame(rows, "day date, key string, v double")
    for part in (df, df.where("day >= '2024-01-02'"), df):  # days done anew count once
        sketches.refresh(sketches.sketched(part, F.col("day"), ["key"], "v", 12), str(tmp_path / "s"))
    got = {r.key: r for r in sketches.united(spark.read.parquet(str(tmp_path / "s")), ["key"]).collect()}
    assert (got["k"].days, got["k"].n, got["none"].estimate) == (3, 3002, 0)
    assert abs(got["k"].estimate - 2000) <= sketches.error_of(12) * 2000


def test_one_document_of_many_tasks(spark, tmp_path):
    path = f"file://{tmp_path}/out.geojson"
    points = F.transform(F.sequence(F.lit(1), (F.col("id") % 3).cast("int")), lambda i: F.struct(i.cast("double").alias("lon"), F.col("id").cast("double").alias("lat")))
    df = spark.range(0, 500, 1, 7).select(F.when(F.col("id") % 3 > 0, files.line_feature(points, F.struct("id"))).alias("f"))
    features.write_collection(df, path)
    document = json.loads((tmp_path / "out.geojson").read_text())
    assert document["type"] == "FeatureCollection" and sorted(f["properties"]["id"] for f in document["features"]) == [i for i in range(500) if i % 3]
    assert features.read_collection(spark, path).count() == len(document["features"])
    with pytest.raises(Exception, match="FileExists"):
        features.write_collection(df, path)
    features.write_collection(df.where("false"), path, overwrite=True)
    assert json.loads((tmp_path / "out.geojson").read_text())["features"] == [] and os.listdir(tmp_path) == ["out.geojson"]


def test_nothing_is_left_of_a_document_that_fails(spark, tmp_path):
    @F.udf("string")
    def failing(i):
        if i == 77:
            raise ValueError("no such feature")
        return "{}"

    with pytest.raises(Exception, match="no such feature"):
        features.write_collection(spark.range(0, 100, 1, 4).select(failing("id").alias("f")), f"file://{tmp_path}/out.geojson")
    assert os.listdir(tmp_path) == []
    with pytest.raises(Exception, match="one column"):
        features.write_collection(spark.range(3), f"file://{tmp_path}/out.geojson")


def test_the_first_of_a_dictionary(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<e k="1" v="z"/><e k="2" v="b"/>\n<e k="1" v="a"/><e k="" v="q"/>\n')
    (tmp_path / "b.xml").write_text('<e k="2" v="a"/><e k="3" v="c"/>')
    assert {tuple(r) for r in files.dictionary(spark, f"file://{tmp_path}", "e", "k", "v").collect()} == {("1", "z"), ("2", "b"), ("3", "c")}


def test_late_rows_over_a_restart_and_a_repeated_batch(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    schema = "ts timestamp_ntz, id int"
    base = f"file://{tmp_path}"

    def run(*batches):
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        late.account(stream, "ts", 600, f"{base}/out", f"{base}/state")

    def found():
        return {r.id: (r.batch, r.late) for r in late.accounted(spark, f"{base}/out", spark.createDataFrame([], schema).schema).collect()}

    run([(at(20), 1), (at(0), 2), (None, 3)], [(at(10), 4), (at(9), 5), (at(50), 6)])
    want = {1: (0, False), 2: (0, False), 3: (0, True), 4: (1, False), 5: (1, True), 6: (1, False)}
    assert found() == want
    run([(at(39), 7), (at(40), 8)])
    want |= {7: (2, True), 8: (2, False)}
    assert found() == want
    for name in ("2", ".2.crc"):  # as if the last run had failed before its commit
        if os.path.exists(tmp_path / "state" / "commits" / name):
            os.remove(tmp_path / "state" / "commits" / name)
    run()
    assert found() == want
    shutil.rmtree(tmp_path / "out")
