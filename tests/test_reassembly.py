import random

from sparkloom.operators import reassembly

SCHEMA = "src string, sport int, dst string, dport int, path string, seq long, tcp_seq long, tcp_flags int, payload binary"


def brute(segments):
    """{flow: {position: octet}}, unwrapped one segment after the other."""
    last, first, syn, held = {}, {}, {}, {}
    for *flow, _, _, number, flags, payload in sorted(segments, key=lambda s: (s[4], s[5])):
        flow = tuple(flow)
        before = last.get(flow)
        position = 0 if before is None else before[0] + (number - before[1] + 2**31) % 2**32 - 2**31
        last[flow] = position, number
        if flags & 2:
            position += 1
            syn.setdefault(flow, position)
        if payload:
            first[flow] = min(first.get(flow, position), position)
            of = held.setdefault(flow, {})
            for i, octet in enumerate(payload):
                of.setdefault(position + i, octet)
    return {f: {p - syn.get(f, first[f]): o for p, o in of.items() if p >= syn.get(f, first[f])} for f, of in held.items()}


def pieces_of(spark, segments, **kw):
    df = spark.createDataFrame([(*s[:-1], bytearray(s[-1]) if s[-1] is not None else None) for s in segments], SCHEMA)
    rows = reassembly.stream_pieces(df.repartition(3), **kw)
    out = {}
    for r in rows.collect():
        of = out.setdefault((r.src, r.sport, r.dst, r.dport), {})
        for i, octet in enumerate(bytes(r.data)):
            assert r.begin + i not in of
            of[r.begin + i] = octet
    return rows, out


def segments_of(seed, flows=5, syn=True):
    """Streams over the wrap, cut, shuffled a little, sent again, overlapped with other octets, and some lost."""
    rng, rows = random.Random(seed), []
    for k in range(flows):
        flow = ("10.0.0.1", 1000 + k, "10.0.0.2", 80)
        stream = bytes(rng.randrange(256) for _ in range(rng.randint(1, 900)))
        start, at, sent = 2**32 - rng.randint(1, 400), 0, []
        while at < len(stream):
            n = rng.randint(1, 60)
            sent.append((at, stream[at : at + n]))
            at += n
        sent = [s for s in sent if rng.random() > 0.1]
        sent += [(a, bytes(rng.randrange(256) for _ in d)) for a, d in sent if rng.random() < 0.2]  # not what was sent first
        sent += [(max(0, a - 7), stream[max(0, a - 7) : a + 20]) for a, _ in sent if rng.random() < 0.3]
        sent.sort(key=lambda s: s[0] + rng.randint(-150, 150))
        if syn:
            rows.append((*flow, "a", 0, start - 1, 2, None))
        rows += [(*flow, "a" if i < len(sent) // 2 else "b", 10 + i * 3, (start + a) % 2**32, 0x18, d) for i, (a, d) in enumerate(sent)]
    return rows


def test_same_as_brute_force(spark):
    for seed, block, chain, syn in ((1, 64, 10, True), (2, 65_536, 65_536, True), (3, 17, 4, False)):
        segments = segments_of(seed, syn=syn)
        _, got = pieces_of(spark, segments, block=block, chain=chain)
        assert got == brute(segments)


def test_holes(spark):
    flow = ("a", 1, "b", 2)
    segments = [(*flow, "x", 0, 99, 2, None), (*flow, "x", 1, 105, 16, b"late"), (*flow, "x", 2, 100, 16, b"ab"), (*flow, "x", 3, 120, 16, b""), (*flow, "x", 4, 98, 16, b"before")]
    rows, got = pieces_of(spark, segments)
    assert bytes(got[flow][i] for i in sorted(got[flow])) == bytes(brute(segments)[flow][i] for i in sorted(brute(segments)[flow]))
    assert [(r.begin, r.end) for r in reassembly.holes(rows).collect()] == [(4, 5)]
    assert pieces_of(spark, [(*flow, "x", 0, 5, 2, None)])[1] == {} and pieces_of(spark, [])[1] == {}


def test_a_stream_of_more_than_all_numbers(spark):
    """Positions go on beyond 2^32: segments far apart, each less than half of all numbers from the last."""
    flow, at = ("a", 1, "b", 2), [0, 2**30, 2**31, 3 * 2**30, 2**32 + 5, 2**32 + 2**30]
    segments = [(*flow, "x", i, (77 + a) % 2**32, 16, b"z") for i, a in enumerate(at)]
    rows, got = pieces_of(spark, segments, chain=2)
    assert sorted(got[flow]) == at and len(reassembly.holes(rows).collect()) == len(at) - 1
