import os
import struct
import tempfile

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import capture, files


def frame(payload, tag=False, proto=17, pad=b"", sport=1000, dport=5000):
    if proto == 17:
        l4 = struct.pack(">4H", sport, dport, 8 + len(payload), 0)
    else:
        l4 = struct.pack(">2H2I2B3H", sport, dport, 1, 1, 5 << 4, 0x18, 100, 0, 0)
    ip = struct.pack(">2B3H2BH4s4s", 0x45, 0, 20 + len(l4) + len(payload), 1, 0, 64, proto, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2]))
    return b"\0" * 12 + (b"\x81\x00\x00\x05" if tag else b"") + b"\x08\x00" + ip + l4 + payload + pad


def pcap(frames, order="<", nano=False):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    out = struct.pack(order + "IHHIIII", magic, 2, 4, 0, 0, 65535, 1)
    for i, f in enumerate(frames):
        out += struct.pack(order + "4I", 100 + i, 500_000_000 if nano else 500_000, len(f), len(f)) + f
    return out


def block(kind, body):
    body += b"\0" * (-len(body) % 4)
    return struct.pack("<2I", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)


def pcapng(frames):
    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    out += block(1, struct.pack("<HHI", 1, 0, 0) + struct.pack("<2HB3x", 9, 1, 9) + struct.pack("<2H", 0, 0))
    for i, f in enumerate(frames):
        at = (100 + i) * 10**9
        out += block(6, struct.pack("<5I", 0, at >> 32, at & 0xFFFFFFFF, len(f), len(f)) + f)
    return out + block(3, struct.pack("<I", len(frames[0])) + frames[0])


def test_capture_files():
    frames = [frame(b"one"), frame(b"two")]
    for order in "<>":
        assert list(capture.frames_of(pcap(frames, order))) == [(100.5, 1, frames[0]), (101.5, 1, frames[1])]
    assert list(capture.frames_of(pcap(frames, nano=True)))[0][0] == 100.5
    assert list(capture.frames_of(pcap(frames)[:-1])) == [(100.5, 1, frames[0])]  # the last record is cut short
    assert list(capture.frames_of(pcapng(frames))) == [(100.0, 1, frames[0]), (101.0, 1, frames[1]), (0.0, 1, frames[0])]
    with pytest.raises(ValueError):
        list(capture.frames_of(b"neither"))


def test_frames_to_inventory(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    frames = [frame(b"<a/>", pad=b"\0" * 9), frame(b"{}", tag=True), frame(b"abc", proto=6), frame(b"<b/>", dport=7), b"\0" * 20, frame(b"x")[:30]]
    for name, data in (("a.pcap", pcap(frames)), ("b.pcapng", pcapng(frames))):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    read = capture.read_frames(spark, folder)
    assert read.count() == 13
    found = capture.datagrams(read)
    assert sorted(bytes(r.payload) for r in found.where("path LIKE '%a.pcap'").collect()) == [b"<a/>", b"<b/>", b"abc", b"{}"]
    by = {(r.proto, r.dport): r for r in capture.inventory(found).collect()}
    assert by["udp", 5000].packets == 5 and by["udp", 5000].kind == "xml" and by["udp", 5000].begin == 100.0
    assert by["tcp", 5000].kind == "text" and by["udp", 7].destinations == ["10.0.0.2"]
    streams = {(r.dport, bytes(r.stream)) for r in capture.flow_streams(found.where("path LIKE '%a.pcap'")).collect()}
    assert streams == {(5000, b"<a/>{}"), (5000, b"abc"), (7, b"<b/>")}


def test_files_as_streams_and_files_that_are_no_captures(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    frames = [frame(b"<a/>"), frame(b"{}")]
    for name, data in (("a.pcap", pcap(frames)), ("b.pcapng", pcapng(frames)), ("c.txt", b"no capture"), ("d.pcap", pcap([]))):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    streamed, whole = capture.stream_frames(spark, folder), capture.read_frames(spark, folder)
    assert sorted(map(repr, streamed.drop("path").collect())) == sorted(map(repr, whole.drop("path").collect()))
    bad = {r.path[-5:]: r.error for r in streamed.where("error IS NOT NULL").collect()}
    assert set(bad) == {"c.txt"} and streamed.where("error IS NULL").count() == 5
    assert capture.datagrams(streamed).count() == 5
    blocks = capture.flow_blocks(capture.datagrams(whole.where("path LIKE '%a.pcap'")), packets=1).collect()
    assert sorted((r.block, bytes(r.stream)) for r in blocks) == [(0, b"<a/>"), (1, b"{}")]


def test_sinks(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    rows = spark.createDataFrame([(1, "é", None), (2, 'a,"b"', 0.5)], "k int, name string, v double")
    files.write_comma_csv(rows.coalesce(1), f"{folder}/csv")
    part = next(f for f in os.listdir(f"{folder}/csv") if f.startswith("part"))
    with open(f"{folder}/csv/{part}", "rb") as f:
        assert f.read().startswith(b"\xef\xbb\xbfk,name,v")
    assert sorted(files.read_comma_csv(spark, f"{folder}/csv", "k int, name string, v double").collect()) == sorted(rows.collect())
    files.write_json_lines(rows, f"{folder}/json")
    assert files.read_json_lines(spark, f"{folder}/json", "k int, name string, v double", f"{folder}/bad").count() == 2
    assert spark.read.text(f"{folder}/bad").count() == 0
    files.write_xml(rows.selectExpr("k AS _k", "name", "v").coalesce(1), f"{folder}/xml", "rows", "row")
    part = next(f for f in os.listdir(f"{folder}/xml") if f.startswith("part"))
    with open(f"{folder}/xml/{part}", encoding="utf-8") as f:
        assert "<rows>" in (text := f.read()) and '<row k="1">' in text
    assert sorted((r._k, r.name) for r in files.read_xml(spark, f"{folder}/xml", "row", "_k int, name string, v double").collect()) == [(1, "é"), (2, 'a,"b"')]


def test_text_formats(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    files.write_semicolon_csv(spark.createDataFrame([(1, 0.5), (2, None)], "k int, v double"), f"{folder}/csv")
    assert sorted(r.value for r in spark.read.text(f"{folder}/csv").collect())[:2] == ["1;0.5000000", "2;"]
    assert {(r.k, r.v) for r in files.read_semicolon_csv(spark, f"{folder}/csv", "k int, v double").collect()} == {(1, 0.5), (2, None)}
    with open(f"{folder}/log.jsonl", "w") as f:
        f.write('{"t": 1.5, "raw": "a"}\nnot json\n{"t": 2.5, "raw": "b"}\n')
    assert files.read_json_lines(spark, f"{folder}/log.jsonl", "t double, raw string").count() == 2
    with open(f"{folder}/types.xml", "w") as f:
        f.write('<types>\n<kind code="a" text="one"/><kind text="two" code="b"/>\n<kind code="a" text="zwei"/>\n</types>')
    assert {tuple(r) for r in files.dictionary(spark, f"{folder}/types.xml", "kind", "code", "text").collect()} == {("a", "one"), ("b", "two")}
    lines = spark.createDataFrame([("t", [(1.0, 2.0), (3.123456789, 4.0)]), ("p", [(1.0, 2.0)]), ("n", [])], "name string, p array<struct<lon: double, lat: double>>")
    got = {r.name: r.g for r in lines.select("name", files.line_feature(F.col("p"), F.struct("name")).alias("g")).collect()}
    assert '"LineString","coordinates":[[1.0,2.0],[3.1234568,4.0]]' in got["t"] and '"Point"' in got["p"] and got["n"] is None
