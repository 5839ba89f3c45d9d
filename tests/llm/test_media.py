import hashlib
import random
import zlib

import numpy as np

from sparkloom.llm import media


def test_cuts_follow_content():
    rng = np.random.default_rng(3)
    data = rng.integers(32, 127, 300_000, dtype=np.uint8).tobytes()
    parts = media.chunks(data)
    assert b"".join(parts) == data and all(media.LEAST <= len(p) <= media.LARGEST for p in parts[:-1])
    moved = set(media.chunks(b"some bytes before" + data))
    assert sum(p in moved for p in parts) > 0.9 * len(parts)
    # the rolling hash, a byte at a time
    h, slow = 0, []
    for i, b in enumerate(data[:50_000]):
        h = ((h << 1) + int(media._GEAR[b])) & 0xFFFFFFFF
        if h >> (32 - media.MASK_BITS) == 0 and i >= media.WINDOW:
            slow.append(i + 1)
    fast = media.candidates(np.frombuffer(data[:50_000], np.uint8))
    assert [x for x in fast.tolist() if x > media.WINDOW] == slow


def test_media(spark):
    rng = random.Random(9)
    prose = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    long = prose(60_000)
    texts = [None, "", "x", "y" * 192, "z" * 193, long, "before " + long, long[:30_000] + "!" + long[30_000:], prose(2000), prose(100_000), "q" * 20_000]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(50, long, "c", 2), (None, long, "c", 2), (5, long, "c", 2), (5, texts[6], "c", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, blob string, n_bytes int")
    out = media.media(docs).collect()
    assert len(out) == len(rows)
    want = []
    for i, t, *_ in rows:
        data = (t or "").encode()
        payload = data + b" " * (-len(data) % 192) if data else b" " * 192
        want.append((i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    assert sorted((repr((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32)) for r in out)) == sorted(map(repr, want))
    by_text = {}
    for r in out:
        by_text.setdefault(r.payload_sha256, set()).add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 and None not in next(iter(v)) for v in by_text.values())


def test_empty(spark):
    assert media.media(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_damage_is_found():
    import pytest
    import zstandard

    frame = zstandard.ZstdCompressor().compress(b"other")
    with pytest.raises(ValueError):
        media.opened([frame], [hashlib.sha256(b"said").digest()])


def test_payloads_come_back_from_what_is_stored(spark, tmp_path):
    import pytest

    rng = random.Random(3)
    prose = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    long = prose(40_000)
    texts = [None, "x", long, "before " + long, prose(9000), "q" * 30_000, long[:20_000] + "!" + long[20_000:], "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = str(tmp_path / "media")
    values = {r.payload_sha256: r for r in media.media(docs, path=path).collect()}
    table = spark.read.parquet(path)
    frames = {bytes(r.digest): bytes(r.frame) for r in media.chunk_table(table).collect()}
    lists = {}
    for r in sorted(media.payload_lists(table).collect(), key=lambda r: r.place):
        lists.setdefault(bytes(r.blob), []).append((bytes(r.digest), r.length))
    for t in texts:
        listed = lists[hashlib.sha256((t or "").encode()).digest()[: media.KEY]]
        payload = media.opened([frames[d] for d, _ in listed], [d for d, _ in listed])
        assert payload == media.payload_of(t or "") and [len(c) for c in media.chunks(payload)] == [n for _, n in listed]
        stored = media.manifest(*zip(*listed)) + b"".join(frames[d] for d, _ in listed)
        assert values[hashlib.sha256(payload).hexdigest()].media_sha256 == hashlib.sha256(stored).hexdigest()
    # a frame that is lost in storage is noticed, though its payload has no chunk of another
    alone = hashlib.sha256(texts[4].encode()).digest()[: media.KEY]
    other = media.zstandard.ZstdCompressor().compress(b"other")
    damaged = table.rdd.map(lambda r: (*r[:3], [other] * len(r[3]) if bytes(r[0]) == alone else r[3], *r[4:])).toDF(table.schema)
    with pytest.raises(Exception, match="not what its digest says"):
        media.read(damaged).collect()
