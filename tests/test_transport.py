import random
import time

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import transport


def packet(pid, counter, fill=b"\xff", start=False, carries=True):
    return bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, (0x10 if carries else 0) | counter]) + fill * 184


def association(*maps):
    return transport.with_check(bytes([0, 0xB0, 0, 0, 1, 0xC1, 0, 0]) + b"".join(bytes([p >> 8, p & 255, 0xE0 | pid >> 8, pid & 255]) for p, pid in maps))


def program(number, *streams):
    head = bytes([2, 0xB0, 0, number >> 8, number & 255, 0xC1, 0, 0, 0xE1, 0, 0xF0, 0])
    return transport.with_check(head + b"".join(bytes([kind, 0xE0 | pid >> 8, pid & 255, 0xF0, 3]) + b"\x52\x01\x01" for kind, pid in streams))


@pytest.mark.parametrize("size", [1, 2, 7, 187, 188, 189, 1000, 10**6])
def test_packets_are_the_same_however_a_stream_is_cut(size):
    rng = random.Random(1)
    stream, want = b"", b""
    for k in range(40):
        if k % 9 == 0:
            stream += bytes(rng.choice([0x47, 0, 1, 2]) for _ in range(rng.randrange(1, 400)))
        body = packet(k % 5, k % 16, bytes([k]))
        stream, want = stream + body, want + body
    stream += packet(1, 1)[:100]
    whole = list(transport.whole_packets([stream]))
    parts = list(transport.whole_packets([stream[i : i + size] for i in range(0, len(stream), size)]))
    for rows in (whole, parts):
        assert sum(j for j, _ in rows) + sum(len(p) for _, p in rows) == len(stream)
    assert b"".join(p for _, p in parts) == b"".join(p for _, p in whole)
    found = b"".join(p for _, p in whole)
    missing = [k for k in range(0, len(want), 188) if want[k : k + 188] not in found]
    assert not missing


def test_streams_without_packets():
    for data in (b"", b"\x47", b"\x47" * 187, b"abc" * 500):
        assert b"".join(p for _, p in transport.whole_packets([data])) == b""
    assert b"".join(p for _, p in transport.whole_packets([packet(1, 1)])) == packet(1, 1)


def test_check_of_sections():
    assert transport.crc(b"123456789") == 0x0376E6E7  # the published value of this check
    assert transport.crc(association((1, 32))) == 0


def feed(packets):
    state = transport.Sections()
    return [s for p in packets for s in state.feed(p)]


def test_sections_over_packets_sent_twice_lost_and_broken():
    table = program(7, *[(k % 30, 300 + k) for k in range(60)])
    sent = transport.packed(table, 32)
    assert len(sent) == 3 and feed(sent) == [table]
    assert feed([sent[0], sent[0], sent[1], sent[2]]) == [table]
    assert feed([sent[0], sent[2]]) == [None]
    assert feed(sent[1:]) == []
    bad = bytearray(sent[1])
    bad[90] ^= 1
    assert feed([sent[0], bytes(bad), sent[2]]) == [None]
    # two sections one behind the other, the second begun in the first's last packet
    small, data = association((1, 32)), table + association((1, 32)) + association((2, 33))
    first = data[:183]
    second = data[183:]
    rest = len(table) - 183
    out = [packet(0, 0, start=True)[:4] + b"\0" + first]
    chunk = second[:rest]
    while len(chunk) > 184:
        out.append(packet(0, len(out))[:4] + chunk[:184])
        chunk = chunk[184:]
    out.append((packet(0, len(out), start=True)[:4] + bytes([len(chunk)]) + chunk + small + association((2, 33))).ljust(188, b"\xff"))
    assert feed(out) == [table, small, association((2, 33))]


def rows(spark, blocks):
    return transport.blocks_of(spark.createDataFrame(blocks, "s string, b long, d binary"), "s", "b", "d")


def test_identifiers_and_programs_over_blocks(spark):
    table = transport.packed(program(7, (27, 256), (3, 257)), 32)
    later = transport.packed(program(7, (27, 256), (4, 257)), 32, 1)
    a = transport.packed(association((0, 16), (7, 32)), 0)
    blocks = [
        ("x", 2, b"".join(packet(256, c) for c in (3, 4, 6)) + b"\0\0"),
        ("x", 1, b"\x47\0" + b"".join(a + table + [packet(256, 1), packet(257, 5, carries=False)])),
        ("x", 3, None),
        ("x", 4, b"".join(later + [packet(256, 7), packet(257, 9)])),
        ("y", 1, packet(256, 0) + packet(256, 0)),
    ]
    blocks = rows(spark, blocks)
    assert blocks.agg(F.sum("junk")).first()[0] == 4
    found = {(r.stream, r.pid): (r.packets, r.carrying, r.faults) for r in transport.identifiers(blocks).collect()}
    # 1 then 3 over the blocks' joint and 4 then 6 within one; 6 then 7 over an empty block is none
    assert found == {("x", 0): (1, 1, 0), ("x", 32): (2, 2, 0), ("x", 256): (5, 5, 2), ("x", 257): (2, 1, 0), ("y", 256): (2, 2, 1)}
    assert {tuple(r) for r in transport.programs(blocks).collect()} == {("x", 256, 7, 27), ("x", 257, 7, 4)}


def test_no_blocks(spark):
    none = rows(spark, [])
    assert transport.identifiers(none).count() == 0 and transport.programs(none).count() == 0


def test_files_as_streams(spark, tmp_path):
    data = b"xx" + b"".join(transport.packed(association((7, 32)), 0) + transport.packed(program(7, (27, 256)), 32) + [packet(256, c % 16) for c in range(200)])
    (tmp_path / "one.ts").write_bytes(data)
    (tmp_path / "none.ts").write_bytes(b"")
    blocks = transport.read_blocks(spark, f"file://{tmp_path}", 5000)
    assert blocks.count() > 3
    assert {(r.pid, r.packets, r.faults) for r in transport.identifiers(blocks).collect()} == {(0, 1, 0), (32, 1, 0), (256, 200, 0)}
    assert [(r.pid, r.stream_type) for r in transport.programs(blocks).collect()] == [(256, 27)]


def test_blocks_are_counted_as_packet_by_packet(spark):
    """Blocks without packets, without payloads and of one number, many streams in a task."""
    rng = random.Random(3)
    blocks, want, last = [], {}, {}
    for stream in "abc":
        for block in range(40):
            packets = [(rng.choice([0, 7, 256, 8191]), rng.randrange(3), rng.random() < 0.7) for _ in range(rng.choice([0, 0, 1, 9, 30]))]
            blocks.append((stream, block, b"\x00\x47" * (len(packets) > 8) + b"".join(packet(*x[:2], carries=x[2]) for x in packets) or None))
            for pid, counter, carries in packets:
                n = want.setdefault((stream, pid), [0, 0, 0])
                before = last.get((stream, pid))
                n[0], n[1], n[2] = n[0] + 1, n[1] + carries, n[2] + (carries and before is not None and (before + 1) % 16 != counter)
                if carries:
                    last[stream, pid] = counter
    found = transport.identifiers(rows(spark, blocks).coalesce(1)).collect()
    assert {(r.stream, r.pid): [r.packets, r.carrying, r.faults] for r in found} == want


def test_pitch_is_found_without_going_over_what_follows():
    body = b"".join(packet(1, c, b"\x01") for c in range(3))
    data = (b"\0\1" + body) * 15_000
    began = time.process_time()
    found = list(transport.whole_packets([data]))
    assert b"".join(p for _, p in found) == body * 15_000 and sum(j for j, _ in found) == 30_000
    assert time.process_time() - began < 6
