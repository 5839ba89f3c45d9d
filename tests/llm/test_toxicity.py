import itertools
import random
import zlib
from collections import Counter

import numpy as np

from sparkloom.llm import labelled, toxicity

BAD = ["idiot", "moron", "worthless", "pathetic", "stupid"]


def corpus(n=900, seed=5):
    """Documents of invented words; half of the bad ones are spelled plainly in training rows, all are disguised in held-out ones."""
    rng = random.Random(seed)
    syllables = ["the", "an", "re", "ing", "ed", "tion", "on", "er", "es", "at", "is", "or", "ou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    disguise = [
        lambda w: w.replace("i", "1").replace("o", "0"), lambda w: " ".join(w), lambda w: w[0] + w[1] * 4 + w[2:], lambda w: w.replace("s", "$").replace("a", "@").replace("t", "7"),
        lambda w: ".".join(w), lambda w: w.upper() + "!!",
    ]
    rows, labels = [], []
    for i in range(n):
        words, toxic = [word() for _ in range(rng.randint(5, 60))], i % 4 == 0
        held = zlib.crc32(str(i).encode()) % 4 == 2
        if toxic:
            bad = rng.choice(BAD)
            words.insert(rng.randrange(len(words)), rng.choice(disguise)(bad) if held else bad)
        elif i % 7 == 0:
            words.insert(2, "a1b2c3 100 v2.0 3x $5 e.g. b7db7aa4a5fcc783")
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_fold(spark):
    got = {r.id: r.f for r in spark.range(300).select("id", labelled.fold("id", 4).alias("f")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 for i in range(300)}


def test_disguised_words_are_restored(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, score string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    truth = dict(labels)
    held = [r for r in toxicity.score(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    right = [(r.score >= 0.3) == bool(truth[r.doc_id]) for r in held]
    assert len(held) > 150 and np.mean(right) > 0.97
    assert all(0 <= r.score <= 1 for r in held)


def test_viterbi_beats_no_other_path():
    """Against all paths of the lattice of short tokens."""
    rng = np.random.default_rng(1)
    letters = " abdegilopstuz_é"
    language = toxicity.Language({a + b + c: int(n) for (a, b, c), n in zip(itertools.product(letters, letters, letters), rng.integers(0, 50, len(letters) ** 3)) if n})
    decoder = toxicity.Decoder(language)

    def paths(token, i, a, b, cost, said):
        if i == len(token):
            yield cost + language.cost(a, b, " "), said
            return
        c, rest = token[i], i + 1
        run = len(token[:i]) - len(token[:i].rstrip(c)) + len(token[i:]) - len(token[i:].lstrip(c))
        repeat = toxicity.REPEAT if run > 2 else toxicity.TWICE
        options = [(x, toxicity.SUBSTITUTE) for x in toxicity.LEET.get(c, "")] + ([(c, 0.0)] if c.isalpha() else [])
        if c in toxicity.APART or not options:
            yield from paths(token, rest, a, b, cost + toxicity.SKIP, said)
        for x, price in options:
            yield from paths(token, rest, b, x, cost + price + language.cost(a, b, x), said + x)
            if x == b:
                yield from paths(token, rest, a, b, cost + price + repeat, said)

    for token in ("1d10t", "i.d-i0t", "looool", "loose", "$7up1d", "a__b", "661", "ll|", "1é3"):
        assert decoder.viterbi(token) == min(paths(token, 0, " ", " ", 0.0, ""))[1], token


def test_trigrams_by_code_point(spark):
    texts = ["Über 1 Käse", "漢字 und 漢字", None, "", "a", "\U0001d400x é" * 3, "".join(map(chr, range(0x4E00, 0x4F00)))]
    want = Counter()
    low = ("  " + "  ".join(t or "" for t in texts).lower() + "  ")
    said = "".join(c if c.isalpha() else " " for c in low)
    want.update(said[i : i + 3] for i in range(len(said) - 2))
    got = toxicity.trigrams(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)).collect()
    assert {"".join(chr(r.gram >> k & (2**21 - 1)) for k in (42, 21, 0)): r.n for r in got} == want


def test_odd_texts(spark):
    rows, labels = corpus(300)
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (3, None), (4, 1), (9999, 1)], "doc_id long, toxic int"))
    odd = [(1, None), (2, ""), (None, "the an"), (3, "x" * 300_000), (4, "1" * 5000), (5, "a " * 5000), (1, None)]
    got = toxicity.score(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if not r.text}) == 1


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, model).count() == 0
    assert [r.score for r in toxicity.score(spark.createDataFrame([(1, "a")], "doc_id long, text string"), model).collect()] == [0.5]


def weighing(spark):
    rows, _ = corpus()
    model = toxicity.language_model(toxicity.trigrams(spark.createDataFrame(rows, "doc_id long, text string")))
    return toxicity.Model(model, dict.fromkeys(BAD, 1.0), (0.0, 1.0, 0.0))


def test_letters_apart(spark):
    w = weighing(spark)
    for text, n in {
        "s t u p i d i d i o t": 2, "a m o r o n": 1, "y o u i d i o t": 1, "it is i d i o t, and": 1, "(i d i o t)": 1, "y o u a r e a m o r o n.": 1, "i d i o t": 1,
        "w o r t h l e s s p a t h e t i c m o r o n s t u p i d i d i o t": 5, "s t u p 1 d m 0 r o n": 2, " ".join("theanisaton" * 4 + "idiot" + "theredon" * 4): 1, "on i d or a b c": 0,
    }.items():
        assert round(np.expm1(w.weigh([text])[0, 0])) == n, text


def test_no_disguise_is_kept_from_the_decoder(spark):
    w = weighing(spark)
    for text, n in {
        "st" + "u" * 40 + "pid": 1, "stupid.1d10t.m0r0n.w0rthless-path3tic-stup1d": 6, "1d107": 1, "!d!07": 1, "1d1ot!": 1, "1d1ot!!": 1, "!!1d1ot": 1, "1d107!!": 1, "1d1ot99": 1,
        "iiddiioott": 1, "mmoorroonn!": 1, "idiot!!": 1, "b7db7aa4a5fcc783": 0, "the!!": 0, "100": 0,
    }.items():
        assert round(np.expm1(w.weigh([text])[0, 0])) == n, text


def test_what_needs_no_decoder_weighs_nothing(spark):
    w = weighing(spark)
    weigher = w.weigher()
    rng = random.Random(8)
    tokens = ["".join(rng.choice("abcdeghiklmnopqrstuvwxyz0123457@$!|+.-_*é²Ⅷ") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    for word in BAD:
        for _ in range(60):
            c = list(word)
            for k in range(len(c)):
                c[k] = rng.choice([c[k], c[k] * rng.randint(1, 5), c[k] + rng.choice(".-_²Ⅷ*"), {"i": "1", "o": "0", "s": "$", "t": "7", "a": "@", "e": "3"}.get(c[k], c[k])])
            tokens.append(rng.choice(["", "x", "!!"]) + "".join(c) + rng.choice(["", "!", "!!", "e"]))
    for token in tokens:
        weight = sum(toxicity.weight_of(x, w.weights) for x in weigher.decoder.words(token))
        assert weigher[token] == weight, token


def test_labelled_texts_without_words(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, " \n"), (4, "...")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, toxic int"))
    assert not model.weights and len({r.score for r in toxicity.score(docs, model).collect()}) <= 2


def test_unrelated_documents_change_counts_only(spark):
    """Many documents of other letters, of far more trigrams than a fixed share would keep: every count of the old ones stays, and their scores."""
    rows, labels = corpus(600)
    rng = random.Random(9)
    other = "".join(map(chr, [*range(0x4E00, 0x6E00), *range(0xAC00, 0xC000)]))
    more = [(10_000 + i, " ".join("".join(rng.choices(other, k=30)) for _ in range(4))) for i in range(10_000)]
    truth = spark.createDataFrame(labels, "doc_id long, toxic int")
    table = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    few, many = toxicity.fit(table(rows), truth), toxicity.fit(table(rows + more), truth)
    plain = lambda model: {g: n for g, n in model.grams.three.items() if not set(g) & {toxicity.OTHER, " "}}
    assert plain(few) == plain(many) and min(plain(many).values()) == 1
    assert len(many.grams.three) <= (len(many.grams.alphabet) + 1) ** 3 and few.weights == many.weights
    a, b = (few.score(few.weigh([t for _, t in rows])), many.score(many.weigh([t for _, t in rows])))
    assert np.abs(a - b).max() < 0.02 and ((a >= 0.3) == (b >= 0.3)).all()


def test_letters_of_learned_words(spark):
    rows = [(f"漢字 {'é' * (i < 8)} W0RD", 1) for i in range(20)] + [("ñ only in clean ones", 0)] * 20 + [("ß", 1)] * 3 + [(None, 1)]
    sample = spark.createDataFrame([(t or "", y) for t, y in rows], "text string, label int")
    assert toxicity.letters_of_words(sample) == frozenset("漢字éwrd") | frozenset("".join(toxicity.LEET.values())) | {" "}
