import random

from sparkloom.llm import suffixdedup

NULL = -(2**63)


def brute(rows, span=100):
    first = {}
    for i, t in sorted(rows, key=lambda r: NULL if r[0] is None else r[0]):
        data = (t or "").encode()
        for p in range(len(data) - span + 1):
            at = (NULL if i is None else i, p)
            s = data[p : p + span]
            first[s] = min(first.get(s, at), at)
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - span + 1):
            if first[data[p : p + span]] < (NULL if i is None else i, p):
                gone[p : p + span] = b"\1" * span
        runs = sum(1 for p in range(len(data)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(data), sum(gone), runs, bytes(b for b, g in zip(data, gone) if not g)))
    return sorted(out, key=repr)


def got(spark, rows):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, kept string, doc int")
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixdedup.remove_repeats(docs).collect()), key=repr)


def texts():
    rng = random.Random(11)
    prose = lambda n: "".join(rng.choice("ab é\n漢") for _ in range(n))
    passages = [prose(k) for k in (60, 99, 100, 101, 130, 200, 400)]
    rows = [(i, prose(rng.randint(0, 150)) + rng.choice(passages) + prose(rng.randint(0, 40)) + rng.choice(passages)) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "a" * 99), (53, "a" * 100), (54, "a" * 700), (55, "ab" * 300 + "x" + "ab" * 300), (56, "abc" * 200), (57, "xabc" + "abc" * 60)]
    rows += [(None, passages[-1]), (3, rows[3][1]), (3, rows[3][1]), (3, "other " + passages[5]), (58, prose(5000)), (59, passages[6] * 5)]
    near = passages[6]
    rows += [(60 + k, near[: 37 * k] + "#" + near[37 * k :]) for k in range(10)]
    rng.shuffle(rows)
    return rows


def test_same_as_brute_force(spark):
    rows = texts()
    assert got(spark, rows) == brute(rows)


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "BLOCK", 150)
    monkeypatch.setattr(suffixdedup, "ROWS_HELD", 20)
    monkeypatch.setattr(suffixdedup, "KINDS_TOGETHER", 3)
    rows = texts()
    assert got(spark, rows) == brute(rows)


def test_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = texts()
        assert got(spark, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty(spark):
    assert got(spark, []) == []


def test_a_phrase_amid_ever_other_text(spark, monkeypatch):
    """An anchor with a kind for each document, found beforehand, is dealt to many tasks."""
    monkeypatch.setattr(suffixdedup, "SAMPLED", 2)
    monkeypatch.setattr(suffixdedup, "HOT_KINDS", 5)
    rng = random.Random(12)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    phrase = prose(64)
    rows = [(i, prose(120) + phrase + prose(120)) for i in range(150)] + [(200 + i, prose(20) + prose(60) + phrase + "the same behind it as in others " * 3) for i in range(20)]
    rows += [(300, rows[3][1]), (301, rows[4][1][50:250]), (302, phrase * 3)]
    docs = spark.createDataFrame(rows, "doc long, text string").selectExpr("doc", "xxhash64(text) AS twin", "text")
    assert len(suffixdedup.hot_anchors(docs, 100)) > 0
    assert got(spark, rows) == brute(rows)
