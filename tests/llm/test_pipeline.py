import os
import tempfile

import numpy as np
import pytest

import corpus_pipeline
from sparkloom.llm import toxicity
from tests.llm import test_decontaminate, test_linededup, test_neardup, test_queries

PROSE = "ab c de fgh ij klm no pq rst uv wxy za".split()


@pytest.fixture(scope="module")
def sf_dir(spark):
    import random

    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(PROSE) + rng.choice(PROSE) for _ in range(n))
    item = prose(25)
    line = prose(8)
    rows = []
    for i in range(160):
        text = prose(rng.randint(15, 80))
        if i % 5 == 0:
            text += " worthless idiot"
        if i % 6 == 1:
            text = f"{text}\n{line}\n{prose(3)}"
        if i % 11 == 2:
            text = f"{text} {item} {prose(4)}"
        rows.append((i, text, "en", "s", len(text)))
    rows += [(200 + k, rows[3][1] + " end", "en", "s", 9) for k in range(4)] + [(300, None, None, None, None), (301, "", "en", "s", 0), (302, rows[4][1], "en", "s", 1)]
    base = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, item), (2, prose(40))], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "out")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        held[name] = rows = docs.collect()
        if name == "packing":
            bins = test_queries.packed(dict(before), rows)
            assert bins <= -(-sum(r.length for r in rows) // 1024) + 2
            continue
        assert docs.columns == columns
        after = sorted(((r.doc_id, r.text) for r in rows), key=repr)
        if name == "toxicity":
            gone = {i for i, _ in before} - {i for i, _ in after}
            assert gone == set(range(0, 160, 5))
        elif name == "line dedup":
            assert after == sorted(((i, t) for i, _, _, t in test_linededup.brute(before)), key=repr)
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "near duplicates":
            classes = test_neardup.brute(before)
            assert {i for i, _ in after} == {c for _, c in classes} and len(after) == len({c for _, c in classes})
        elif name == "decontamination":
            assert {i for i, _ in after} == {i for i, _, n, _ in test_decontaminate.brute(before, items) if not n}
    ran = sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert ran == sorted(tuple(r)[:5] for r in held["packing"])


def test_threshold_is_the_queries():
    assert corpus_pipeline.TOXIC == 0.3 and np.isfinite(toxicity.SUBSTITUTE)


def test_odd_and_empty_tables(spark, sf_dir):
    """Columns of any name stay, nulls and repeated rows crash nothing, empty tables stay empty."""
    names = "doc_id long, text string, score double, label int, blob string, keys int, words int, hub long, n_lines int, other int"
    odd = [(None, None), (None, "no id"), (1, None), (1, ""), (2, "x" * 50_000), (2, "x" * 50_000), (3, "one line of text that is long\none line of text that is long"), (4, "漢字 " * 30)]
    docs = spark.createDataFrame([(*r, *[1.0, *[None] * 7]) for r in odd], names)
    for rows in (docs, docs.limit(0)):
        kept = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, sf_dir)
            assert kept.columns == docs.columns
        pieces = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir).collect()
        assert {r.doc_id for r in pieces} == (set() if not rows.count() else {None, 1, 2, 3, 4})


def test_other_columns_keep_their_values(spark, sf_dir):
    names = ["n_lines", "n_dropped", "__score", "__doc", "twin", "class_id", "a.b"]
    rows = [(i, f"{i} words of no other text\nthis line is in all of them", "en", *[100 * i + k for k in range(len(names))]) for i in range(6)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", *names])
    want = {r[0]: r[2:] for r in rows}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        got = {r[0]: tuple(r)[2:] for r in docs.collect()}
        assert got and got == {i: want[i] for i in got}
    assert len(got) == 6


def test_two_runs_at_once(spark, sf_dir):
    import threading

    want, found = sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "ids_crc32").collect())), {}
    run = lambda k: found.update({k: sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "ids_crc32").collect()))})
    threads = [threading.Thread(target=run, args=(k,)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(300)
    assert found == {0: want, 1: want}
