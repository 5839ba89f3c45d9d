import random
from collections import Counter

import numpy as np

from sparkloom.llm import neardup


def bag(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def alike(a, b):
    if (a or "") == (b or ""):
        return True
    x, y = bag(a), bag(b)
    both, all_of = sum((x & y).values()), sum((x | y).values())
    return bool(all_of) and both / all_of >= 0.8


def brute(rows):
    """Classes by document."""
    texts = sorted({t or "" for i, t in rows if i is None})
    ids = [10**9 + texts.index(t or "") if i is None else i for i, t in rows]  # a document for each text without id
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for p in range(len(rows)):
        for q in range(p):
            if ids[p] != ids[q] and alike(rows[p][1], rows[q][1]):
                a, b = sorted((root(ids[p]), root(ids[q])))
                label[b] = a
    none = lambda i: None if i >= 10**9 else i
    return sorted(((none(i), none(root(i))) for i in ids), key=repr)


def corpus():
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, i = [], 0
    for _ in range(25):
        base = prose(rng.randint(40, 150))
        for _ in range(rng.randint(1, 6)):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((i, " ".join(words)))
            i += 1
    chain = prose(120)
    for k in range(8):  # each like the next one, the ends unlike
        rows.append((200 + k, " ".join(chain[6 * k : 6 * k + 78])))
    shared = prose(70)
    rows += [(300 + k, " ".join(prose(10) + shared + prose(10))) for k in range(30)]
    rows += [(400, None), (401, ""), (402, " \n"), (403, "one two"), (404, "One  two"), (405, "a " * 400), (406, "a " * 380), (407, "a " * 100), (None, " ".join(chain[:78])), (408, "x" * 20_000), (409, "alone here"), (None, "no id and alone"), (None, "neither has this"), (None, "no id and alone"), (None, "alone here")]
    rows += [(3, rows[3][1]), (410, "two texts of one id that are unlike"), (410, "one two")]
    rng.shuffle(rows)
    return rows


def test_classes(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, label string, class_id int")
    got = sorted(((r.doc_id, r.class_id) for r in neardup.classes(docs).collect()), key=repr)
    assert got == brute(rows)
    kept = [r.doc_id for r in neardup.one_of_each(docs).collect()]
    assert sorted(kept, key=repr) == sorted([*{c for _, c in got} - {None}, None, None], key=repr)


def test_empty(spark):
    assert neardup.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_registers_are_unbiased():
    rng = np.random.default_rng(2)
    a = np.concatenate([np.repeat(rng.integers(0, 2**63, 60, dtype=np.uint64), rng.integers(1, 9, 60)) for _ in range(5)])
    b = np.concatenate([a[: len(a) * 2 // 3], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    agree = []
    for k in range(60):
        s = neardup.signatures([neardup.mixed(a + np.uint64(k)), neardup.mixed(b + np.uint64(k))])
        agree.append((s[0] == s[1]).mean())
    true = neardup.weighted_jaccard(a, b)
    assert abs(np.mean(agree) - true) < 5 * (true * (1 - true) / (60 * 128)) ** 0.5


def test_signatures_are_the_same_in_any_block():
    rng = np.random.default_rng(6)
    some = [np.repeat(rng.integers(0, 2**63, n, dtype=np.uint64), rng.integers(1, 9, n)) for n in (1, 3, 10, 40, 200)]
    alone = np.concatenate([neardup.signatures([b]) for b in some])
    others = [rng.integers(0, 2**63, 1000, dtype=np.uint64) for _ in range(100)]
    amid = neardup.signatures([*others[:50], *some, *others[50:]])[50:55]
    assert (alone.view(np.uint64) == amid.view(np.uint64)).all()
    assert (neardup.bands(alone) == neardup.bands(amid)).all()


def test_no_register_is_in_two_bands():
    assert sorted(neardup._BANDS.ravel().tolist()) == list(range(neardup.REGISTERS))


def test_large_groups_in_runs_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "RUN", 3)
    monkeypatch.setattr(neardup, "SIDE", 400)
    rng = random.Random(9)
    base = [f"v{rng.randrange(400)}" for _ in range(90)]
    rows = []
    for i in range(60):  # some alike, most of them not quite
        words = list(base)
        for _ in range(rng.randint(1, 5)):
            words[rng.randrange(len(words))] = rng.choice("xyz") + str(i)
        rows.append((i, " ".join(words)))
    got = sorted(((r.doc_id, r.class_id) for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == brute(rows) and 5 < len({c for _, c in got}) < 55


def test_groups_of_many_sizes_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SIDE", 300)
    rng = random.Random(12)
    base, rows = [f"v{rng.randrange(900)}" for _ in range(700)], []
    for i in range(50):  # prefixes of one text, each with words of its own
        words = base[: int(60 * 1.05**i)]
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice("xyz") + str(i)
        rows.append((i, " ".join(words)))
    rows += [(i, t) for i, t in enumerate(["", None, "a b"], 100)]
    got = sorted(((r.doc_id, r.class_id) for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == brute(rows)


def test_blocks_hold_each_pair_of_near_sizes_once(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SIDE", 500)
    rng = random.Random(5)
    given = [(hub, 1000 * hub + i, max(0, int(4 * 1.25 ** (i % 17)) + rng.randint(-1, 1)), i, i % 3 > 0) for hub, size in ((1, 120), (2, 3)) for i in range(size)]
    given += [(3, 3000, 0, 0, False), (3, 3001, 0, 1, True)]
    sums = Counter()
    for hub, _, n, _, _ in given:
        sums[hub] += n
    loose = spark.createDataFrame([(*r, sums[r[0]]) for r in given], "hub long, doc long, n long, label long, loose boolean, all_n long")
    known = spark.createDataFrame([(r[1], str(r[1])) for r in given], "doc long, text string")
    held = {}
    for r in neardup.blocks(loose, known, 0.8).collect():
        held.setdefault(tuple(r[c] for c in neardup.BLOCK_OF), {True: [], False: []})[r.loose].append(int(r.text))
    met = Counter((a, b) for block in held.values() for a in block[True] for b in block[False])
    assert set(met.values()) == {1}
    size = {r[1]: r[2] for r in given}
    near = {(a[1], b[1]) for a in given if a[4] for b in given if a[0] == b[0] and 5 * min(a[2], b[2]) >= 4 * max(a[2], b[2])}
    assert near <= set(met)
    assert all(max(size[a], 1) < 2 * max(size[b], 1) for a, b in met if a // 1000 == 1)
    assert len([1 for a, _ in met if a // 1000 == 1]) < 0.4 * 120 * 80
    assert max(sum(size[x] for x in block[False]) for block in held.values()) < 3 * 500


def test_ids_of_any_height(spark):
    text = "the quick brown fox jumps over the lazy dog and runs far away from all of them"
    rows = [(2**62 + 5, text), (2**63 - 1, text), (2**62 + 9, "another text that stands alone"), (-(2**63), "the least id of all alone"), (None, text), (None, "alone and without id"), (7, "a third one"), (2**62, "a third one"), (2**62 + 9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.class_id) for r in neardup.classes(docs).collect()}
    assert got == {(2**62 + 5, 2**62 + 5), (2**63 - 1, 2**62 + 5), (2**62 + 9, 2**62 + 9), (-(2**63), -(2**63)), (None, 2**62 + 5), (None, None), (7, 7), (2**62, 7)}
    kept = [(r.doc_id, r.text) for r in neardup.one_of_each(docs).collect()]
    assert len(kept) == 5 and {(2**62 + 5, text), (-(2**63), "the least id of all alone"), (None, "alone and without id"), (7, "a third one")} <= set(kept)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    names = rng.sample(range(10**6), 400)
    links = [(names[i], names[i + 1]) for i in range(199)] + [(names[200], names[i]) for i in range(201, 300)] + [(x, x) for x in names[300:]]
    got = {r.node: r.label for r in neardup.components(spark.createDataFrame(links, "a long, c long").repartition(7)).collect()}
    want = {x: min(part) for part in (names[:200], names[200:300]) for x in part}
    assert got == {x: c for x, c in want.items() if x != c}
