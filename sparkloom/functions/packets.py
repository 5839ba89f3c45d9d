"""Datagrams and tagged records in binary columns."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(data: Column, start: Column | int, width: int) -> Column:
    """The unsigned big-endian integer of width bytes at a 1-based place."""
    return F.conv(F.hex(F.substring(data, start, width)), 16, 10).cast("bigint")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Octets that Ethernet with one tag and the longest IPv4 and TCP headers take.
HEADERS = 138


def datagram(frame: Column) -> Column:
    """proto, src, sport, dst, dport, payload of an Ethernet frame (one 802.1Q tag at most) with IPv4 and UDP or TCP; null for any other.

    A payload ends where the IP packet does, and a UDP one where its own length says: padding
    is no payload. Later fragments, which have no ports, are null.
    """

    def at(hexed: Column, place: Column | int, width: int) -> Column:
        begin = place * 2 - 1 if isinstance(place, Column) else F.lit(place * 2 - 1)
        return F.conv(F.substring(hexed, begin, F.lit(width * 2)), 16, 10).cast("int")

    def dotted(hexed: Column, place: Column) -> Column:
        return F.concat_ws(".", *[at(hexed, place + i, 1).cast("string") for i in range(4)])

    def link(h: Column) -> Column:
        tagged = at(h, 13, 2) == 0x8100
        return F.struct(h.alias("h"), F.when(tagged, 19).otherwise(15).alias("ip"), F.when(tagged, at(h, 17, 2)).otherwise(at(h, 13, 2)).alias("kind"))

    def network(x: Column) -> Column:
        h, ip = x["h"], x["ip"]
        first = at(h, ip, 1)
        good = (x["kind"] == 0x0800) & (F.shiftright(first, 4) == 4) & (at(h, ip + 6, 2) % 0x2000 == 0)
        return F.struct(h.alias("h"), ip.alias("ip"), (ip + first % 16 * 4).alias("l4"), (ip + at(h, ip + 2, 2)).alias("end"), at(h, ip + 9, 1).alias("proto"), good.alias("good"))

    def transport(x: Column) -> Column:
        h, l4, udp = x["h"], x["l4"], x["proto"] == 17
        head = F.when(udp, F.lit(8)).otherwise(F.shiftright(at(h, l4 + 12, 1), 4) * 4)
        stop = F.when(udp, F.least(x["end"], l4 + at(h, l4 + 4, 2))).otherwise(x["end"])
        return F.struct(h.alias("h"), x["ip"].alias("ip"), l4.alias("l4"), udp.alias("udp"), (l4 + head).alias("begin"), stop.alias("stop"), (x["good"] & x["proto"].isin(6, 17)).alias("good"))

    def fields(x: Column) -> Column:
        h, ip, l4 = x["h"], x["ip"], x["l4"]
        payload = F.substring(frame, x["begin"], F.greatest(x["stop"] - x["begin"], F.lit(0)))
        out = F.struct(F.when(x["udp"], "udp").otherwise("tcp").alias("proto"), dotted(h, ip + 12).alias("src"), at(h, l4, 2).alias("sport"), dotted(h, ip + 16).alias("dst"), at(h, l4 + 2, 2).alias("dport"), payload.alias("payload"))
        return F.when(x["good"] & (F.octet_length(frame) >= x["begin"] - 1), out)

    # each step is worked out once and handed on
    return let(F.hex(F.substring(frame, 1, HEADERS)), lambda h: let(link(h), lambda a: let(network(a), lambda b: let(transport(b), fields))))


def with_datagrams(frames: DataFrame, frame: str = "frame") -> DataFrame:
    """frames with proto, src, sport, dst, dport, payload of those that datagram() reads, and for TCP tcp_seq and tcp_flags; the rest are left out.

    The fields of datagram(), a column a step, so that all of it is generated code.
    """

    def at(place: Column | int, width: int) -> Column:
        return number(F.col("__f"), place if isinstance(place, Column) else F.lit(place), width)

    ip, l4, end = F.col("__ip"), F.col("__l4"), F.col("__end")
    # An explode is a row's barrier: without it each filter below would be moved in front of what makes
    # the frame, and make it anew for each octet that it looks at.
    rest = [c for c in frames.columns if c != frame]
    out = frames.select(*rest, F.explode(F.array(F.struct(F.col(frame).alias("f")))).alias("__x")).select(*rest, F.col("__x.f").alias("__f"))
    out = out.withColumn("__ip", F.when(F.substring("__f", 13, 2) == F.unhex(F.lit("8100")), 19).otherwise(15))
    out = out.where((F.substring("__f", ip - 2, F.lit(2)) == F.unhex(F.lit("0800"))) & (F.shiftright(at(ip, 1), 4) == 4))
    out = out.withColumns({"__l4": (ip + at(ip, 1) % 16 * 4).cast("int"), "__end": (ip + at(ip + 2, 2)).cast("int"), "__proto": at(ip + 9, 1)})
    out = out.where(((at(ip + 6, 2) % 0x2000) == 0) & F.col("__proto").isin(6, 17)).withColumn("__udp", F.col("__proto") == 17)
    head = F.when(F.col("__udp"), 8).otherwise(F.shiftright(at(l4 + 12, 1), 4) * 4)
    out = out.withColumns({"__begin": (l4 + head).cast("int"), "__stop": F.when(F.col("__udp"), F.least(end, l4 + at(l4 + 4, 2))).otherwise(end).cast("int")})
    out = out.where(F.octet_length("__f") >= F.col("__begin") - 1)
    dotted = lambda place: F.concat_ws(".", *[at(place + i, 1).cast("string") for i in range(4)])
    fields = {
        "proto": F.when(F.col("__udp"), "udp").otherwise("tcp"), "src": dotted(ip + 12), "sport": at(l4, 2).cast("int"), "dst": dotted(ip + 16), "dport": at(l4 + 2, 2).cast("int"),
        "payload": F.substring("__f", F.col("__begin"), F.greatest(F.col("__stop") - F.col("__begin"), F.lit(0))),
        "tcp_seq": F.when(~F.col("__udp"), at(l4 + 4, 4)), "tcp_flags": F.when(~F.col("__udp"), at(l4 + 13, 1)).cast("int"),
    }
    return out.select(*[F.col("__f").alias(frame) if c == frame else c for c in frames.columns], *[v.alias(k) for k, v in fields.items()])


def tcp_frame(src: Column, sport: Column, dst: Column, dport: Column, seq: Column, flags: Column, payload: Column, tag: Column, options: int = 0, padding: int = 0) -> Column:
    """An Ethernet frame with IPv4 and TCP around a payload (checksums 0): with a VLAN tag where ``tag`` is true, so many words of TCP options and octets of padding."""
    packed = lambda value, width: F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * width, "0"))
    fixed = lambda h: F.unhex(F.lit(h))
    ip = F.concat(fixed("4500"), packed(F.octet_length(payload) + 40 + 4 * options, 2), fixed("0000000040060000"), packed(src, 4), packed(dst, 4))
    tcp = F.concat(packed(sport, 2), packed(dport, 2), packed(seq, 4), fixed("00000000"), fixed(f"{5 + options:x}0"), packed(flags, 1), fixed("FFFF00000000"), fixed("01" * 4 * options))
    link = F.concat(fixed("020000000001020000000002"), F.when(tag, fixed("81000005")).otherwise(fixed("")), fixed("0800"))
    return F.concat(link, ip, tcp, payload, fixed("00" * padding))


def udp_frame(src: Column, sport: Column, dst: Column, dport: Column, payload: Column) -> Column:
    """An Ethernet frame with IPv4 and UDP around a payload (checksums 0); addresses as integers."""
    packed = lambda value, width: F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * width, "0"))
    n = F.octet_length(payload)
    ip = F.concat(F.unhex(F.lit("4500")), packed(n + 28, 2), F.unhex(F.lit("0000000040110000")), packed(src, 4), packed(dst, 4))
    udp = F.concat(packed(sport, 2), packed(dport, 2), packed(n + 8, 2), F.unhex(F.lit("0000")))
    return F.concat(F.unhex(F.lit("0200000000010200000000020800")), ip, udp, payload)


def rtp_payload(payload: Column) -> Column:
    """What follows an RTP header of version 2 and its list of sources; null for anything else."""
    first = number(payload, 1, 1)
    begin = (13 + first % 16 * 4).cast("int")
    return F.when((F.shiftright(first, 6) == 2) & (F.octet_length(payload) >= begin), F.substring(payload, begin, F.octet_length(payload)))


def transport_packets(stream: Column, size: int = 188) -> Column:
    """pid, starts, carries, counter of each whole packet of a transport stream that begins at its first octet; those without the sync octet are left out."""
    at = lambda i: F.substring(stream, i * size + 1, F.lit(4))
    heads = F.transform(F.when(F.octet_length(stream) >= size, F.sequence(F.lit(0), F.floor(F.octet_length(stream) / size).cast("int") - 1)).otherwise(F.array().cast("array<int>")), at)
    fields = lambda h: F.struct((number(h, 2, 2) % 8192).cast("int").alias("pid"), (F.shiftright(number(h, 2, 1), 6) % 2 == 1).alias("starts"), (F.shiftright(number(h, 4, 1), 4) % 2 == 1).alias("carries"), (number(h, 4, 1) % 16).cast("int").alias("counter"))
    return F.transform(F.filter(heads, lambda h: number(h, 1, 1) == 0x47), fields)


def tlv_items(data: bytes | None) -> list[tuple[int, bytes]]:
    """(tag, value) of one-byte tags with BER lengths; a record that ends early ends the list."""
    out, at = [], 0
    while data is not None and at + 2 <= len(data):
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            width = n & 0x7F
            if at + width > len(data):
                break
            n, at = int.from_bytes(data[at : at + width], "big"), at + width
        if at + n > len(data):
            break
        out.append((tag, data[at : at + n]))
        at += n
    return out


def tlv(data: Column) -> Column:
    """tlv_items of a binary column, as an array of (tag, value)."""

    @F.pandas_udf("array<struct<tag: int, value: binary>>")
    def items(records: pd.Series) -> pd.Series:
        return pd.Series([[{"tag": t, "value": v} for t, v in tlv_items(None if d is None else bytes(d))] for d in records.array])

    return items(data)


def scaled(value: Column, width: int, low: float, high: float, signed: bool = False) -> Column:
    """An integer of width bytes mapped onto low to high; the signed form leaves its lowest value out."""
    raw = number(value, 1, width)
    top = 2 ** (8 * width) - 1
    if not signed:
        return raw * F.lit((high - low) / top) + low
    number_ = F.when(raw > top // 2, raw - (top + 1)).otherwise(raw)
    return F.when(raw != top // 2 + 1, number_ * F.lit((high - low) / (top - 1)) + (high + low) / 2)
