"""Byte streams out of TCP segments, by sequence number: retransmits, overlaps, reordering and holes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What tells the two directions of a connection apart.
FLOW = ("src", "sport", "dst", "dport")
#: Segments of a flow that are unwrapped one after the other by a task; octets of a stream that a task puts together.
CHAIN, BLOCK = 65_536, 65_536
SYN = 0x02


def signed32(difference: Column) -> Column:
    """The difference of two sequence numbers, which wrap at 2^32, taken the shorter way."""
    return F.pmod(difference + 2**31, F.lit(2**32)) - 2**31


def unwrapped(segments: DataFrame, flow: Sequence[str] = FLOW, order: Sequence[str] = ("path", "seq"), number: str = "tcp_seq", chain: int = CHAIN) -> DataFrame:
    """segments with position: their number less that of the flow's first segment in capture order, beyond 2^32 too.

    A segment is taken to be less than 2^31 octets from the one captured before it. Flows are
    followed in chains of so many places of a file, and the chains, one row each, after another:
    so a flow with most of all segments is many tasks' work. order: a file, and a place in it.
    """
    path, seq = order
    links = segments.withColumn("__chain", F.floor(F.col(seq) / chain))
    within = Window.partitionBy(*flow, path, "__chain").orderBy(seq)
    step = F.coalesce(signed32(F.col(number) - F.lag(number).over(within)), F.lit(0))
    links = links.withColumn("__step", step).withColumn("__along", F.sum("__step").over(within))
    ends = links.groupBy(*flow, path, "__chain").agg(F.min_by(number, seq).alias("__first"), F.max_by(F.struct(number, "__along"), seq).alias("__last"))
    chains = Window.partitionBy(*flow).orderBy(path, "__chain")
    jump = F.coalesce(F.lag("__last.__along").over(chains) + signed32(F.col("__first") - F.lag(f"__last.{number}").over(chains)), F.lit(0))
    starts = ends.withColumn("__jump", jump).withColumn("__start", F.sum("__jump").over(chains)).select(*flow, path, "__chain", "__start")
    return links.join(starts, [*flow, path, "__chain"]).withColumn("position", F.col("__start") + F.col("__along")).drop("__chain", "__step", "__along", "__start")


def stream_pieces(segments: DataFrame, flow: Sequence[str] = FLOW, order: Sequence[str] = ("path", "seq"), block: int = BLOCK, chain: int = CHAIN) -> DataFrame:
    """flow, begin, data: each flow's stream as the runs of octets that were captured, cut at multiples of ``block``.

    segments: flow, order, tcp_seq, tcp_flags, payload. A stream begins (begin 0) behind the first
    SYN of its flow, or, without one, at its least position; what lies before that is left out. Of
    octets that came more than once the first in capture order counts. A run ends where octets
    are missing: holes() lists those. Flows without payload have no rows. A flow's blocks are put
    together apart from each other, so a task holds one block and what was sent for it.
    """
    path, seq = order
    known = unwrapped(segments.select(*flow, path, seq, "tcp_seq", "tcp_flags", "payload"), flow, order, chain=chain)
    syn = (F.col("tcp_flags").bitwiseAND(SYN) != 0)
    # a SYN takes one number, and data in the same segment follow it
    known = known.withColumn("position", F.col("position") + syn.cast("int"))
    data = F.octet_length("payload") > 0
    origin = known.groupBy(*flow).agg(F.min_by("position", F.when(syn, F.struct(path, seq))).alias("__syn"), F.min(F.when(data, F.col("position"))).alias("__least"))
    placed = known.where(data).join(origin.select(*flow, F.coalesce("__syn", "__least").alias("__origin")), list(flow)).withColumn("begin", F.col("position") - F.col("__origin"))
    # equal segments once, the first; then each cut at the blocks that it reaches
    placed = placed.groupBy(*flow, "begin", "payload").agg(F.min(F.struct(path, seq)).alias("came"))
    first, last = F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.octet_length("payload") - 1) / block)
    cut = placed.where(last >= 0).withColumn("block", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    low = F.greatest(F.col("begin"), F.col("block") * block)
    high = F.least(F.col("begin") + F.octet_length("payload"), (F.col("block") + 1) * block)
    parts = cut.select(*flow, "block", "came", (low - F.col("block") * block).cast("int").alias("at"), F.substring("payload", (low - F.col("begin") + 1).cast("int"), (high - low).cast("int")).alias("data"))

    def put(group: pd.DataFrame) -> pd.DataFrame:
        held, have = np.zeros(block, np.uint8), np.zeros(block + 1, bool)
        for _, at, octets in sorted(zip(((c["path"], c["seq"]) for c in group["came"]), group["at"], group["data"])):
            new = np.frombuffer(octets, np.uint8)
            free = ~have[at : at + len(new)]
            held[at : at + len(new)][free] = new[free]
            have[at : at + len(new)] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], have]).astype(np.int8)))
        runs = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
        start = int(group["block"].iloc[0]) * block
        return pd.DataFrame({**{k: [group[k].iloc[0]] * len(runs) for k in flow}, "begin": [start + a for a, _ in runs], "data": [held[a:b].tobytes() for a, b in runs]})

    kinds = dict(segments.dtypes)
    came = F.struct(F.col(f"came.{path}").alias("path"), F.col(f"came.{seq}").alias("seq"))
    return parts.withColumn("came", came).groupBy(*flow, "block").applyInPandas(put, ", ".join(f"{k} {kinds[k]}" for k in flow) + ", begin long, data binary")


def holes(pieces: DataFrame, flow: Sequence[str] = FLOW) -> DataFrame:
    """flow, begin, end of the octets between a flow's pieces that nobody captured, from 0 on."""
    order = Window.partitionBy(*flow).orderBy("begin")
    before = F.coalesce(F.lag(F.col("begin") + F.octet_length("data")).over(order), F.lit(0))
    ends = pieces.select(*flow, "begin", "data", before.alias("__before"))
    return ends.where(F.col("begin") > F.col("__before")).select(*flow, F.col("__before").alias("begin"), F.col("begin").alias("end"))
