import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sparkloom.llm import packing

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", " ", "a  b", "a \n b\n\n c", "tab\tand  two ", "x" * 3000, "word " * 5000, "<|endoftext|> said", "ça été ñandú 漢字 🙂", "  x  y", "same", "same"]


def test_ids_are_the_tokenizers_ids():
    full, own = Tokenizer.from_file(PATHS[0]), packing.encoder(*PATHS)
    for text in TEXTS[1:]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == full.encode(text, add_special_tokens=False).ids, text


def test_pack_round_trip(spark):
    rows = [(i, t, "x", 7) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", 7), (None, "no id", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, bucket int")
    out = packing.pack(docs, *PATHS, capacity=64, keep_ids=True).collect()
    full = Tokenizer.from_file(PATHS[0])
    want = {}
    for i, t, *_ in rows:
        ids = full.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.setdefault((i, k), []).append((a, ids[a:b]))
    got = {}
    for r in out:
        got.setdefault((r.doc_id, r.piece), []).append((r.start, r.ids))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
    assert got == want
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in out)
    assert len(sequences) <= total / 64 + 2


def test_fullest_is_exact():
    import itertools
    import random

    rng = random.Random(3)
    for _ in range(200):
        items = [rng.randint(1, 12) for _ in range(rng.randint(0, 9))]
        counts = [0] * 13
        for x in items:
            counts[x] += 1
        room = rng.randint(0, 30)
        best = max(sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= room)
        got = packing.fullest(counts, room)
        assert sum(got) == best and all(got.count(x) <= counts[x] for x in got)


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), *PATHS).count() == 0
