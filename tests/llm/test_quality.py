import random
import zlib

import numpy as np

from sparkloom.llm import quality


def documents(n=700, seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 9)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 120))]
        good = i % 3 != 0
        if not good:
            words = rng.choice([[w.upper() + "!!" for w in words], [w + "$$$" for w in words], [words[0]] * len(words)])
        rows.append((i, " ".join(words)))
        labels.append((i, int(good)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = documents()
    docs = spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, text string, statistics double")
    trees = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    truth = dict(labels)
    held = [r for r in quality.score(docs, trees).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([(r.score >= 0.5) == bool(truth[r.doc_id]) for r in held]) > 0.97


def test_traversal_is_the_trees():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    trees = quality.grow(x, y)

    def slow(row):
        total = trees.base
        for node in trees.roots:
            while trees.low[node] != node:
                node = trees.low[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.high[node]
            total += trees.value[node]
        return 1 / (1 + np.exp(-total))

    fast = trees.score(x)
    assert np.allclose(fast, [slow(r) for r in x]) and ((fast >= 0.5) == y).mean() > 0.9


def test_one_split_is_the_best_one():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 20, size=(300, 3)).astype(float)
    y = (x[:, 2] > 7).astype(float)
    trees = quality.grow(x, y, trees=1, depth=1)
    assert trees.feature[trees.roots[0]] == 2 and 7 <= trees.threshold[trees.roots[0]] < 8


def test_odd_texts(spark):
    empty = quality.fit(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int"))
    odd = [(1, None), (2, ""), (None, "\n\n"), (3, "x" * 300_000), (4, "🙂 é"), (1, None)]
    docs = spark.createDataFrame(odd, "doc_id long, text string")
    assert [r.score for r in quality.score(docs, empty).collect()] == [0.5] * len(odd)
    rows, labels = documents(300)
    one_label = quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, 1) for i, _ in labels] + [(None, 0), (5, None)], "doc_id long, quality int"))
    assert all(r.score > 0.9 for r in quality.score(docs, one_label).collect())
    assert quality.score(docs.limit(0), one_label).count() == 0
