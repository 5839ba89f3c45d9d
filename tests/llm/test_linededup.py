
import numpy as np

from sparkloom.llm import linededup


def brute(rows, min_docs=3, min_chars=20):
    """kept text, lines and drops of each row."""
    lower = {c: c + 32 for c in range(65, 91)}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lower)
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(-(2**63) if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(h := holders.get(key(x), ())) >= min_docs and max(h) != (-(2**63) if i is None else i))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_drop_repeated_lines(spark):
    long, other = "A line that is long ENOUGH to count", "é" * 20
    rows = [(1, f"{long}\nx\n{long}"), (2, f"  {long.lower()}\t\nown"), (3, long), (4, f"{other}\n{long}\n{long}"), (5, other), (6, other), (7, "é" * 19), (8, "é" * 19), (9, "é" * 19)]
    rows += [(10, None), (11, ""), (None, f"{other}\nkept"), (5, other), (5, "a different text\n" + other), (12, "\n".join([long.upper()] * 3 + ["z"] * 5000))]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, line string, n_lines int")
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in linededup.drop_repeated_lines(docs).collect()), key=repr)
    assert got == brute(rows)


def test_nothing_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, "alone and long enough to count")], "doc_id long, text string")
    assert [(r.n_lines, r.n_dropped) for r in linededup.drop_repeated_lines(docs).collect()] == [(1, 0)]
    assert linededup.drop_repeated_lines(docs.limit(0)).count() == 0


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 100, 20_000):
        keys = np.arange(n, dtype=np.uint64) * np.uint64(rng.integers(1, 2**62) * 2 + 1)
        assert sorted(linededup.slots(keys, linededup.perfect_hash(keys), n)) == list(range(n))


def test_many_shards_and_copies(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SHARD_KEYS", 5)
    monkeypatch.setattr(linededup, "PROBES_A_COPY", 7)
    rows = [(i, "\n".join(f"line number {k} of some length" for k in range(40) if (i + k) % 5 < 3 or k == 7)) for i in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in linededup.drop_repeated_lines(docs).collect()), key=repr)
    assert got == brute(rows)
