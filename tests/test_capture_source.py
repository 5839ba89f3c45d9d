import os
import random
import struct
import tempfile

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import capture, capture_source, capture_splits
from tests.test_sources import block, frame, pcap, pcapng


def headers(n, order="<"):
    """Octets like records of a capture and blocks of another, so many, which follow each other."""
    one = struct.pack(order + "4I", 1700000000, 5, 8, 8) + b"payload!"
    two = struct.pack(order + "2I", 6, 40) + bytes(28) + struct.pack(order + "I", 40)
    return one * n + two * n


def tricky(n=60, seed=1):
    rng = random.Random(seed)
    return [frame(rng.choice([headers(12), headers(12, ">"), bytes(rng.randint(1, 300)), os.urandom(rng.randint(1, 200)), headers(2)])[: rng.randint(1, 900)], tag=k % 5 == 0, dport=5000 + k % 3) for k in range(n)]


def sections(frames):
    """Two sections of pcapng in one file, the second with another interface and big-endian."""
    big = lambda kind, body: struct.pack(">2I", kind, len(body) + 12) + body + struct.pack(">I", len(body) + 12)
    out = pcapng(frames[:20])
    out += big(0x0A0D0D0A, struct.pack(">IHHq", 0x1A2B3C4D, 1, 0, -1)) + big(1, struct.pack(">HHI", 1, 0, 0))
    for i, f in enumerate(frames[20:]):
        padded = f + b"\0" * (-len(f) % 4)
        out += big(6, struct.pack(">5I", 0, 0, 77 + i, len(f), len(f)) + padded)
    return out


FILES = {"classic": pcap, "big": lambda f: pcap(f, ">"), "nano": lambda f: pcap(f, nano=True), "blocks": pcapng, "sections": sections, "cut": lambda f: pcap(f)[:-7], "cut blocks": lambda f: pcapng(f)[:-9]}


def folder_of(**files):
    folder = tempfile.mkdtemp(prefix="spark-")
    for name, data in files.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    return folder


def test_any_number_of_ranges_gives_the_rows_of_one_pass(spark):
    frames = tricky()
    whole = {name: make(frames) for name, make in FILES.items()}
    folder = folder_of(**whole)
    longest = max(map(len, whole.values()))
    want = {name: [(i, *x) for i, x in enumerate(capture.frames_of(data))] for name, data in whole.items()}
    for k in (1, 3, 50):
        got = {}
        for r in capture_splits.read_splits(capture_splits.splits(spark, folder, -(-longest // k))).collect():
            got.setdefault(os.path.basename(r.path).replace("%20", " "), []).append((r.seq, r.ts, r.linktype, bytes(r.frame)))
        assert {n: sorted(x) for n, x in got.items()} == want, k


def test_joints_that_do_not_fit_are_mended():
    """For every number of ranges: ranges from guesses alone would go wrong, ranges whose joints fit do not."""
    import io

    wrong = 0
    for make in (pcap, pcapng, sections):
        data = make([frame(headers(40)) for _ in range(30)])
        f, head = io.BytesIO(data), data[:24]
        for k in range(1, 51):
            size = -(-len(data) // k)
            lows = list(range(0, len(data), size))
            begins = [24 if make is pcap else 0] + [capture_splits.guessed(f, low, len(data), head) for low in lows[1:]]
            at, before = begins[0], b""
            for low, guess in zip(lows, begins):
                wrong += guess != at
                at, _, found = capture_splits.walked(f, at, min(low + size, len(data)), len(data), head, before)
                before = found if found[:4] == b"\x0a\x0d\x0d\x0a" else before + found
            assert at == len(data)
    assert wrong > 20


def test_odd_files_have_no_ranges(spark):
    folder = folder_of(text=b"no capture", short=b"\xd4\xc3\xb2\xa1", empty=b"")
    assert capture_splits.read_splits(capture_splits.splits(spark, folder, 10)).collect() == []


def test_source_reads_what_datagrams_has(spark):
    frames = tricky() + [b"\0" * 20, frame(b"abc", proto=6), frame(b"x")[:30]]
    folder = folder_of(a=pcap(frames), b=pcapng(frames))
    capture_source.register(spark)
    got = spark.read.format("capture").load(folder)
    columns = ["seq", "ts", "proto", "src", "sport", "dst", "dport", "payload"]
    want = capture.datagrams(capture.read_frames(spark, folder))
    rows = lambda df: sorted(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.select(*columns).collect())
    assert rows(got) == rows(want) and got.rdd.getNumPartitions() == 2
    assert spark.read.format("capture").load(f"{folder}/a").count() * 2 == got.count() - 1  # the second has one simple block more


def test_filters_reach_the_source(spark):
    frames = [frame(b"%d" % k, dport=5000 + k % 3) for k in range(30)]
    folder = folder_of(a=pcap(frames), c=b"no capture")
    capture_source.register(spark)
    read = spark.read.format("capture").load(folder)
    assert [r.error for r in read.where("error IS NOT NULL").collect()] == ["neither pcap nor pcapng"]
    some = read.where((F.col("dport") == 5001) & (F.col("ts") >= 110.5) & F.col("proto").isin("udp", "tcp") & (F.octet_length("payload") > 0))
    assert sorted(bytes(r.payload) for r in some.collect()) == sorted(b"%d" % k for k in range(30) if k % 3 == 1 and k >= 10)
    plan = some._jdf.queryExecution().executedPlan().toString()
    filtered = "".join(line for line in plan.splitlines() if "Filter" in line.split("(")[0])
    assert "dport" not in filtered and "ts#" not in filtered, plan


@pytest.mark.parametrize("cut", range(0, 60, 7))
def test_short_frames(cut):
    whole = frame(b"payload", tag=True)
    assert capture_source.parsed(whole)[5] == b"payload" and (capture_source.parsed(whole[:cut]) is None or cut >= 46)
