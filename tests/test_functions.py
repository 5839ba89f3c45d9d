import math

from pyspark.sql import functions as F

from sparkloom.functions import geo, packets, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_grid_references(spark):
    # civil landmarks, with grid references as published
    places = [(48.85824, 2.29451, "31UDQ"), (40.6892, -74.0445, "18TWL"), (-33.8568, 151.2153, "56HLH"), (0.0, 0.0, "31NAA")]
    for lat, lon, square in places:
        assert one(spark, geo.grid_reference(F.lit(lat), F.lit(lon))).startswith(square), (lat, lon)
    assert one(spark, geo.grid_reference(F.lit(48.85824), F.lit(2.29451), 3))[:5] == "31UDQ"
    assert one(spark, geo.grid_reference(F.lit(85.0), F.lit(0.0))) is None
    assert one(spark, geo.grid_reference(F.lit(10.0), F.lit(180.0))).startswith("1P")


def test_direct_geodesic(spark):
    # a quarter of the equator, and a meridian quadrant
    east = one(spark, geo.direct(F.lit(0.0), F.lit(0.0), F.lit(90.0), F.lit(math.pi * geo.A / 2)))
    assert abs(east.lat) < 1e-9 and abs(east.lon - 90) < 1e-9
    north = one(spark, geo.direct(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(10001965.729)))
    assert abs(north.lat - 90) < 1e-6
    back = one(spark, geo.direct(F.lit(50.0), F.lit(179.9), F.lit(90.0), F.lit(20_000.0)))
    assert -180 <= back.lon < -179.8


def test_plane_round_trip(spark):
    at = geo.to_plane(F.lit(48.1), F.lit(2.2), 48.0, 2.0)
    back = one(spark, geo.from_plane(at["x"], at["y"], 48.0, 2.0))
    assert abs(back.lat - 48.1) < 1e-12 and abs(back.lon - 2.2) < 1e-12


def test_text(spark):
    assert one(spark, text.printable(F.lit("a\x00\x1fb\tc"))) == "a b c"
    assert one(spark, text.one_line(F.lit("a|b"), F.lit(None), F.lit(3))) == "a b||3"
    assert one(spark, text.wildcard_key(F.lit("a-b-c"))) == "a-.-c"
    assert one(spark, text.weighted_labels(F.lit("f=2, h=1,x=?"))) == ["f", "f", "h"]
    points = text.vertices(F.lit("1,2 3,4 x,1 5"))
    assert [(v.x, v.y) for v in one(spark, points)] == [(1, 2), (3, 4)]
    mean = one(spark, text.centroid(points))
    assert (mean.x, mean.y) == (2, 3)
    assert one(spark, text.without_prolog(F.lit('<?xml version="1.0"?>\n<!DOCTYPE a>\n<a/>'))) == "<a/>"


def test_payload_kinds(spark):
    for data, kind in ((b"", "empty"), (b"<a/>", "xml"), (b"{}", "json"), (b"\x1f\x8b\x08", "gzip"), (b"plain", "text"), (b"\xff\x00\x01", "binary"), (bytes.fromhex("060e2b34"), "klv")):
        assert one(spark, text.payload_kind(F.lit(bytearray(data)))) == kind


def test_fixed_point(spark):
    data = F.lit(bytearray.fromhex("ffffffff80000000"))
    assert one(spark, text.big_endian(data, 1, 4)) == 2**32 - 1 and one(spark, text.big_endian(data, 1, 4, True)) == -1
    assert one(spark, text.fixed_angle(data, 5, 4)) == 180.0 and one(spark, text.fixed_angle(data, 5, 4, 180.0, True)) == -90.0


def test_tagged_records(spark):
    record = bytes.fromhex("0102000a") + b"\x02\x82\x00\x03abc" + b"\x03\x05ab"
    assert packets.tlv_items(record) == [(1, b"\x00\x0a"), (2, b"abc")]
    assert packets.tlv_items(None) == [] and packets.tlv_items(b"\x01") == []
    assert one(spark, packets.scaled(F.lit(bytearray(b"\x80\x00")), 2, -90.0, 90.0, True)) is None
    assert one(spark, packets.scaled(F.lit(bytearray(b"\xff\xff")), 2, 0.0, 360.0)) == 360.0


def test_utf8_faults(spark):
    for data, want in {
        b"plain": [], "é漢😀".encode(): [], b"": [], b"\xabn\xe9": [(0, "AB", "«"), (2, "E9", "é")], b"\xe9\xc3\xa9\x80": [(0, "E9", "é"), (3, "80", "€")],
        b"\xc0\xafx": [(0, "C0", "À"), (1, "AF", "¯")], b"\xed\xa0\x80": [(0, "ED", "í"), (1, "A0", "\xa0"), (2, "80", "€")], b"\xf0\x9f\x98": [(0, "F0", "ð"), (1, "9F", "Ÿ"), (2, "98", "˜")],
    }.items():
        assert [tuple(x) for x in one(spark, text.utf8_faults(F.lit(bytearray(data))))] == want, data
        assert bool(want) != one(spark, F.is_valid_utf8(F.lit(bytearray(data)).cast("string")))
    assert len(one(spark, text.utf8_faults(F.lit(bytearray(b"x" * 200_000 + b"\xff"))))) == 1


def test_shapes(spark):
    for xml, vertices, closed in (
        ('<shape><line closed="true"><vertex x="1" y="2"/><vertex x="3" y="no"/><vertex x="5" y="6"/></line></shape>', [(1, 2), (5, 6)], True),
        ('<shape><line closed="no"><vertex x="1" y="2"/></line><link point="9,9"/></shape>', [(1, 2)], False),
        ('<shape><link point="1,2,0"/><link point="3,4"/><link point="1,2"/></shape>', [(1, 2), (3, 4), (1, 2)], True),
        ('<shape><link point="1,2"/><link point="x"/><link point="3,4"/></shape>', [(1, 2), (3, 4)], False),
        ("<shape/>", [], False),
    ):
        got = one(spark, text.shape(F.lit(xml)))
        assert ([tuple(v) for v in got.vertices], got.closed) == (vertices, closed), xml
    assert len(one(spark, text.ring(text.vertices(F.lit("1,2 3,4"))))) == 3 and len(one(spark, text.ring(text.vertices(F.lit("1,2 3,4 1,2"))))) == 3


def test_transport_packets(spark):
    packet = lambda pid, flags: bytes([0x47, pid >> 8 | 0x40, pid & 255, flags]) + b"x" * 184
    stream = packet(0x1234, 0x13) + packet(17, 0x2F) + b"y" * 188 + b"G"
    found = one(spark, packets.transport_packets(F.lit(bytearray(stream))))
    assert [tuple(x) for x in found] == [(0x1234, True, True, 3), (17, True, False, 15)]
    assert one(spark, packets.transport_packets(F.lit(bytearray(b"")))) == []
    rtp = bytes([0x81]) + b"h" * 15 + b"body"
    assert bytes(one(spark, packets.rtp_payload(F.lit(bytearray(rtp))))) == b"body"
    assert one(spark, packets.rtp_payload(F.lit(bytearray(b"\x47abc")))) is None
