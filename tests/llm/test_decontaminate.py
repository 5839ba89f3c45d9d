import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, span=10):
    out = []
    for i, text in docs:
        w, hit, of = words(text), set(), set()
        for item, body in items:
            b = words(body)
            n = min(span, len(b))
            for j in range(len(b) - n + 1 if b else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == b[j : j + n]:
                        hit.update(range(p, p + n))
                        of.add(item)
        out.append((i, len(w), len(hit), sorted(str(x) for x in of if x is not None)))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(7)
    prose = lambda n: " ".join(rng.choice("ab c de é fgh 漢 i1 j".split()) for _ in range(n))
    items = [(k, prose(rng.choice([3, 9, 10, 11, 40]))) for k in range(12)] + [(12, None), (13, ""), (14, "!?"), (15, "Zq"), (None, prose(30)), (3, prose(20))]
    docs = [(i, prose(rng.randint(0, 60)) + " " + (rng.choice(items)[1] or "").upper() + "\n" + prose(5)) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "..."), (103, "zq"), (None, items[5][1]), (3, docs[3][1]), (3, "other text of doc 3 " + items[4][1]), (104, " ".join([prose(900), items[7][1]]))]
    docs += [(105, "ÉCOLE Zq"), (106, "x" * 50_000)]
    return docs, items


def run(spark, docs, items):
    d = spark.createDataFrame([(*x, "clash", 1) for x in docs], "doc_id long, text string, words string, n_hit int")
    b = spark.createDataFrame(items, "item_id long, text string")
    return d, b, sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.contamination(d, b).collect()), key=repr)


def test_same_as_brute_force(spark):
    docs, items = cases()
    d, b, got = run(spark, docs, items)
    assert got == brute(docs, items)
    clean = {r.doc_id for r in decontaminate.decontaminate(d, b).collect()}
    assert clean == {i for i, _, n, _ in brute(docs, items) if not n}


def test_shuffled_benchmark(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_GRAMS", 1)
    docs, items = cases()
    assert run(spark, docs, items)[2] == brute(docs, items)


def test_empty(spark):
    docs, items = cases()
    assert run(spark, docs, [])[2] == brute(docs, [])
    assert run(spark, [], items)[2] == []


def periodic(seed):
    """Texts and items of words that repeat with periods of 1 to 7, with other words between and around."""
    rng = random.Random(seed)

    def stretch():
        unit = [rng.choice("ab") if rng.random() < 0.7 else rng.choice("cd") for _ in range(rng.randint(1, 7))]
        n = rng.choice([4, 9, 10, 11, 13, 25, 60])
        return (unit * 60)[:n]

    def text():
        out = []
        for _ in range(rng.randint(1, 4)):
            out += [rng.choice("xyzab") for _ in range(rng.randint(0, 4))] + stretch() + [rng.choice("xyzab") for _ in range(rng.randint(0, 4))]
        return out

    items = [text() for _ in range(14)] + [[rng.choice("ab") for _ in range(n)] for n in range(1, 10)] + [["a"] * n for n in (1, 3, 5, 9, 10, 30)]
    docs = [text() for _ in range(50)]
    for _ in range(50):  # pieces of items between others
        item = rng.choice(items)
        i = rng.randrange(len(item))
        docs.append(text() + item[i : i + rng.randint(5, 30)] + text())
    join = lambda rows: [(i, " ".join(x)) for i, x in enumerate(rows)]
    return join(docs), join(items)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_periodic_texts(spark, seed):
    docs, items = periodic(seed)
    assert run(spark, docs, items)[2] == brute(docs, items)


@pytest.mark.parametrize("unit", ["again", "to and", "one two three four five"])
def test_repeated_words_take_time_in_proportion(spark, unit):
    n = len(unit.split())
    items = spark.createDataFrame([(1, " ".join([unit] * (60 // n))), (2, f"lead {' '.join([unit] * 6)} tail of it")], "item_id long, text string")

    def seconds(times):
        docs = spark.createDataFrame([(1, " ".join([unit] * (times // n)))], "doc_id long, text string")
        began = time.time()
        row = decontaminate.contamination(docs, items).first()
        assert (row.n_words, row.n_hit, "1" in row["items"]) == (times // n * n, times // n * n, True)
        return time.time() - began

    seconds(5000)
    short, long = seconds(50_000), seconds(500_000)
    assert long < 15 * short + 5


def test_a_gram_takes_no_words_with_it(spark):
    """Above the generator of grams there is neither a text nor an array of words or hashes."""
    docs = spark.createDataFrame(cases()[0], "doc_id long, text string")
    plan = decontaminate.document_grams(docs, [3, 10])._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "Generate explode" in line)
    carried = plan[at].rpartition("explode(")[2].rpartition("), [")[2]
    assert carried.count("#") == 4 and all(x in carried for x in ("doc_id", "twin", "n_words", "gram")), plan[at][-300:]
    assert not any(re.search(r"\b(words|hashes|text)#", line) for line in plan[:at])


def test_time_in_proportion_to_length(spark):
    rng = random.Random(3)
    some = [f"w{k}" for k in range(5000)]
    item = " ".join(rng.choice(some) for _ in range(60))
    parts = [" ".join(rng.choice(some) for _ in range(400)) for _ in range(100)]

    def seconds(n):
        text = " ".join(rng.choice(parts) + " " + item for _ in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        row = decontaminate.contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).first()
        assert (row.n_words, row.n_hit) == (460 * n, 60 * n)
        return time.time() - began

    seconds(10)
    short, long = seconds(100), seconds(1100)  # 46,000 and 506,000 words
    assert long < 15 * short + 5
