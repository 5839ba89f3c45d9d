"""Toxicity scores of deobfuscated text, by a noisy channel.

Spark counts the character trigrams of all documents, each letter of any script as itself. The
language model is these counts, with the letters that no learned word can have taken together
as one: a word is learned only if enough labelled documents of label 1 hold it, so its letters
are among those that as many of them hold, or are stood for by a sign. What is broadcast is so
bounded by the labelled sample's letters, and no count is left out. A token that looks
disguised (digits or signs for letters, letters apart, letters repeated) is a lattice of what
each character can stand for, and the Viterbi path under language model and channel is what it
says. Letters apart are put together and the same model places the breaks between their words.
What a token can say in several ways counts in each of them. Words that mark label 1 are
learned on a bounded sample of labelled rows, on restored words and their stems, and only if
they stand after enough different tokens, so that what copies of one passage have in common
isn't learned. A document's score is a logistic function of what its restored words weigh and
of how many tokens it has.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import labelled
from sparkloom.llm.common import text_of, written

#: What a character can stand for besides itself.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i",
}
#: What can stand between letters for nothing.
APART = set(".-_*~'’·")
EDGES = ".,;:?\"'()[]{}<>#%&*~`^=/\\-_…«»“”‘’"
_edges = frozenset(EDGES)
#: Costs of the channel, in nats.
SUBSTITUTE, SKIP, REPEAT = 1.0, 0.5, 0.5
#: Of leaving out a letter that stands twice only, as many words have it.
TWICE = 6.0
#: Of reading a sign as a sign, between words.
SIGN = 2.0
#: Bytes of plain tokens and of others that a task remembers, about.
PLAIN_BYTES, MEMO_BYTES = 16_000_000, 8_000_000
#: Stands for all letters that no learned word can have.
OTHER = "\x01"
#: Of trigrams never seen in a context, as if so many had been.
SMOOTH = 5.0
#: A word is learned if so many labelled documents of label 1 hold it, and they are so large a share of all that do,
#: and it stands there after at least so many different tokens.
LEAST_DOCS, LEAST_SHARE, LEAST_CONTEXTS = 8, 0.5, 6
#: Characters of the stems that are learned like words, longest first; a stem is written with a star.
STEMS = (7, 6, 5)

_letter = re.compile(r"[^\W\d_]")
_sign = re.compile(r"[0-9@$!|+€£¡.\-_*~'’·]")
_repeated = re.compile(r"(.)\1\1|(.)\2.*?(.)\3", re.DOTALL)  # a letter thrice, or two twice
_all_twice = re.compile(r"(?:(.)\1+)+", re.DOTALL)
_stretched = re.compile(r"(.)\1{3,}", re.DOTALL)
_split = re.compile(r"[\W\d_]+")
_apart = re.compile(f"[{re.escape(EDGES + ''.join(sorted(APART)))}]+")
#: What an end of a token can lose before it is read: nothing, its signs, its signs and digits.
_heads = (re.compile(""), re.compile(r"[$!|+@€£¡]*"), re.compile(r"[\W\d_]*"))
_tails = (re.compile(r"\Z"), re.compile(r"(?<![$!|+@€£¡])[$!|+@€£¡]*\Z"), re.compile(r"(?<![\W\d_])[\W\d_]*\Z"))


def disguised(token: str) -> bool:
    """Letters and signs in one, or letters repeated as few words have them."""
    return len(token) > 2 and bool(_letter.search(token) and _sign.search(token) or _repeated.search(token))


@cache
def _letters() -> np.ndarray:
    """Each code point, or a space for those that are no letters."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(sys.maxunicode + 1)], dtype=np.uint32)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of text's letters and spaces as numbers of three times 21 bits, and their counts."""
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    alphabet = np.flatnonzero(np.bincount(codes))
    wide = lambda x: (x[:-2] << 42) | (x[1:-1] << 21) | x[2:]
    k = len(alphabet)
    if k > 160:
        return np.unique(wide(codes.astype(np.int64)), return_counts=True)
    place = np.zeros(alphabet[-1] + 1, dtype=np.int64)
    place[alphabet] = np.arange(k)
    c = place[codes]
    n = np.bincount((c[:-2] * k + c[1:-1]) * k + c[2:], minlength=1)
    seen = np.flatnonzero(n)
    return (alphabet[seen // k // k] << 42) | (alphabet[seen // k % k] << 21) | alphabet[seen % k], n[seen]


def trigrams(docs: DataFrame, text: str = "text") -> DataFrame:
    """gram (see counted), n: trigrams over all of docs, of which spaces and other signs are one letter."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            texts, at = batch["text"].array, 0
            while at < len(texts):
                block, size = [], 0
                while at < len(texts) and size < 2**20:
                    block.append(texts[at])
                    size += len(texts[at])
                    at += 1
                held.append(counted("  " + "  ".join(block).lower() + "  "))
            grams, where = np.unique(np.concatenate([g for g, _ in held]), return_inverse=True)
            held = [(grams, np.bincount(where, np.concatenate([n for _, n in held])).astype(np.int64))]
        for grams, n in held:
            yield pd.DataFrame({"gram": grams, "n": n})

    return docs.select(text_of(text).alias("text")).mapInPandas(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class Language:
    """Probability of a character after two others, from counts of trigrams; smoothed by what follows one and none.

    With an alphabet, in which grams are, any other character counts as OTHER.
    """

    def __init__(self, grams: dict[str, int], alphabet: frozenset[str] | None = None) -> None:
        self.alphabet = alphabet
        self.three, self.two, self.one, self.pairs, self.singles = dict(grams), Counter(), Counter(), Counter(), Counter()
        for g, n in grams.items():
            self.two[g[1:]] += n
            self.one[g[2]] += n
            self.pairs[g[:2]] += n
            self.singles[g[1]] += n
        self.total = sum(grams.values())
        self.rows: dict[str, _Costs] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rows": {}}

    def letter(self, c: str) -> str:
        return c if self.alphabet is None or c in self.alphabet else OTHER

    def cost(self, a: str, b: str, c: str) -> float:
        """In nats, of c after a and b."""
        a, b, c = self.letter(a), self.letter(b), self.letter(c)
        p1 = (self.one[c] + 1) / (self.total + len(self.one) + 1)
        p2 = (self.two[b + c] + SMOOTH * p1) / (self.singles[b] + SMOOTH)
        return -math.log((self.three.get(a + b + c, 0) + SMOOTH * p2) / (self.pairs[a + b] + SMOOTH))

    def after(self, a: str, b: str) -> _Costs:
        a, b = self.letter(a), self.letter(b)
        if a + b not in self.rows:
            self.rows[a + b] = _Costs(self, a, b)
        return self.rows[a + b]


class _Costs(dict):
    """Costs after two characters, by the third."""

    def __init__(self, language: Language, a: str, b: str) -> None:
        self.of = language, a, b

    def __missing__(self, c: str) -> float:
        language, a, b = self.of
        self[c] = cost = language.cost(a, b, c)
        return cost


def letters_of_words(sample: DataFrame) -> frozenset[str]:
    """The letters that a learned word can have: those in at least LEAST_DOCS rows with label 1 of a bounded sample (text, label), those that signs stand for, and the space."""

    def letters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for batch in batches:
            for text in batch["text"].array:
                n.update({c for c in set(text.lower()) if c.isalpha()})
        yield pd.DataFrame({"letter": pd.Series(list(n), dtype=object), "n": pd.Series(list(n.values()), dtype="int64")})

    held = sample.where("label = 1").select("text").mapInPandas(letters, "letter string, n long").groupBy("letter").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCS).collect()
    return frozenset(r.letter for r in held) | frozenset("".join(LEET.values())) | {" "}


def language_model(counts: DataFrame, alphabet: frozenset[str] | None = None) -> Language:
    """Of all trigrams' counts, with letters outside the alphabet as one: at most as many numbers as there are triples of an alphabet, whatever the corpus. Without an alphabet all letters are themselves, for small corpora."""
    known = [ord(c) for c in alphabet or ()]
    part = lambda shift: F.shiftright("gram", shift).bitwiseAND(2**21 - 1)
    kept = lambda shift: part(shift) if alphabet is None else F.when(part(shift).isin(known), part(shift)).otherwise(ord(OTHER))
    grams = counts.groupBy(kept(42).alias("a"), kept(21).alias("b"), kept(0).alias("c")).agg(F.sum("n").alias("n")).toPandas()
    triples = map("".join, zip(*(map(chr, grams[x].tolist()) for x in "abc")))
    return Language(dict(zip(triples, grams["n"].tolist())), alphabet)


class Decoder:
    """Restores tokens under a language model, to which learned words are one more, uniform model of a word between breaks."""

    def __init__(self, language: Language, learned: Iterable[str] = ()) -> None:
        self.after = language.after
        self.trie: dict = {}
        for word in learned:
            node = self.trie
            for x in word:
                node = node.setdefault(x, {})
            node[""] = word
        self.price = math.log(max(1, len(list(learned))))

    def learned(self, token: str, i: int) -> Iterator[tuple[int, float, str]]:
        """End, cost and letters of each learned word that token can say from place i on."""
        at = [(self.trie, self.price)]
        while at and i < len(token):
            c, i, after = token[i], i + 1, []
            for node, cost in at:
                if c in APART and node is not self.trie:
                    after.append((node, cost + SKIP))
                for x, price in [(x, SUBSTITUTE) for x in LEET.get(c, "")] + [(c, 0.0)]:
                    if x in node:
                        after.append((node[x], cost + price))
                        if "" in node[x]:
                            yield i, cost + price, node[x][""]
            at = after

    def path(self, token: str, signs: bool = False, breaks: bool = False, cheap: bool = False) -> list[str]:
        """The words of the likeliest path: with ``signs`` any sign may part words, with ``breaks`` they may part anywhere; ``cheap`` repeats cost REPEAT all."""
        paths = {(" ", " "): (0.0, None)}  # last two letters, a space for none: cost, letters as a chain
        ahead: dict[int, dict] = {}  # the same where learned words end
        rows = self.after

        def offer(key: tuple[str, str], cost: float, chain: tuple | None, into: dict) -> None:
            if key not in into or cost < into[key][0]:
                into[key] = (cost, chain)

        for i, c in enumerate(token):
            repeat = REPEAT if cheap or c * 3 in token[max(0, i - 2) : i + 3] else TWICE
            after: dict[tuple[str, str], tuple[float, tuple | None]] = ahead.pop(i + 1, {})
            options = [(x, SUBSTITUTE) for x in LEET.get(c, "")] + ([(c, 0.0)] if c.isalpha() else [])
            if breaks:
                for (a, b), (cost, chain) in list(paths.items()):
                    if b != " ":
                        offer((b, " "), cost + rows(a, b)[" "], (chain, " "), paths)
            if self.trie and (signs or breaks) and (new := [paths[key] for key in paths if key[1] == " "]):
                begin, chain = min(new, key=lambda x: x[0])
                for end, cost, word in self.learned(token, i):
                    k = " " + word
                    offer((k[-2], k[-1]), begin + cost, (chain, word), after if end == i + 1 else ahead.setdefault(end, {}))
            for (a, b), (cost, chain) in paths.items():
                if c in APART or not options:
                    offer((a, b), cost + SKIP, chain, after)
                if signs and not c.isalpha():
                    if b != " ":
                        offer((b, " "), cost + SIGN + rows(a, b)[" "], (chain, " "), after)
                    else:
                        offer((a, b), cost + SKIP, chain, after)
                if options:
                    row = rows(a, b)
                    for x, price in options:
                        offer((b, x), cost + price + row[x], (chain, x), after)
                        if x == b:  # or the same letter goes on
                            offer((a, b), cost + price + repeat, chain, after)
            paths = after
        ends = [(cost if (signs or breaks) and b == " " else cost + rows(a, b)[" "], chain) for (a, b), (cost, chain) in paths.items()]
        chain, letters = min(ends, key=lambda end: end[0])[1], []
        while chain:
            chain, x = chain
            letters.append(x)
        return "".join(reversed(letters)).split()

    def viterbi(self, token: str) -> str:
        """The likeliest letters that token stands for."""
        return "".join(self.path(token))

    def readings(self, core: str) -> Counter:
        """The words of a disguised token in each of its readings: whole, without signs at its ends, and with signs between words."""
        core = _stretched.sub(r"\1\1\1", core)
        ways = {core[h:t] for h in {x.match(core).end() for x in _heads} for t in {x.search(core).start() for x in _tails} if t - h > 1}
        out = Counter(self.path(core, signs=True))
        parts = [x for x in _apart.split(core) if x]
        if len(parts) > 1:
            said = Counter()
            for part in parts:
                said += self.readings(part) if disguised(part) else Counter()
            out |= said
        for way in ways:
            out |= Counter(self.path(way)) if disguised(way) else Counter([way] if way.isalpha() else [])
            if _repeated.search(way):
                out |= Counter(self.path(way, cheap=True))
                if _all_twice.fullmatch(way):
                    out |= Counter(["".join(g for g, n in runs(way) for _ in range(n // 2))])
        return out

    def words(self, token: str) -> list[str]:
        """What a lower-case token says: its words as they stand, and as restored if it looks disguised."""
        core = token.strip(EDGES)
        if core.isalpha() and not disguised(core):
            return [core]
        core = re.sub(r"[$!|+@]{3,}$", "", core).strip(EDGES)
        plain = Counter(w for w in _split.split(core) if w)
        return list((plain | self.readings(core) if disguised(core) else plain).elements())

    def apart(self, run: str) -> list[str]:
        """What letters that stood apart say: one word, one beside a one-letter word at either end, or words parted where the language model has it."""
        out = Counter(self.path(_stretched.sub(r"\1\1\1", run), breaks=True))
        for one in {run, run[1:], run[:-1], run[1:-1]}:
            if len(one) > 2:
                out |= Counter(self.words(one))
        return list(out.elements())


def runs(token: str) -> list[tuple[str, int]]:
    """The characters of token in order and how often each stands in a row."""
    return [(g, len(list(same))) for g, same in groupby(token)]


def spelled(tokens: list[str]) -> list[str]:
    """Letters apart, three and more in a row, put together; signs at their edges don't count."""
    out, run = [], []
    single = [i for i, t in enumerate(tokens) if len(t) == 1 or (t[-1] in _edges or t[0] in _edges) and len(t.strip(EDGES)) == 1]
    if len(single) < 3:
        return out
    for i in [*single, -9]:
        if run and i != run[-1] + 1:
            if len(run) > 2:
                out.append("".join(tokens[k].strip(EDGES) or tokens[k] for k in run))
            run = []
        run.append(i)
    return out


def plain(token: str) -> str | None:
    """What a lower-case token says if it is a word as it stands."""
    core = token.strip(EDGES)
    return core if core.isalpha() and (len(core) < 3 or not _repeated.search(core)) else None


class Known(dict):
    """Words of tokens that aren't plain, remembered by token."""

    def __init__(self, decoder: Decoder) -> None:
        self.decoder, self.room = decoder, MEMO_BYTES

    def __missing__(self, token: str) -> list[str]:
        words = self.decoder.apart(token[1:]) if token[0] == " " else self.decoder.words(token)
        if self.room > 0:
            self[token] = words
            self.room -= 300 + 4 * len(token) + sum(60 + len(w) for w in words)
        return words


class _Gaps(dict):
    """For str.translate: what can be left out within a word, whatever it is, as a dot."""

    def __missing__(self, code: int) -> int:
        self[code] = code if chr(code).isalpha() or chr(code) in LEET else ord(".")
        return self[code]


def spellings(features: Iterable[str]) -> Callable[[str], bool]:
    """Whether the channel could have made some of the words, or words of the stems, into a part of a token. It says yes to more than that, but no to nothing less."""
    trie: dict = {}
    for feature in features:
        node = trie
        for x in feature.rstrip("*"):
            node = node.setdefault(x, {})
        node[""] = {}
    of: dict[str, str] = {}
    for c, letters in LEET.items():
        for x in letters:
            of[x] = of.get(x, "") + c

    def pattern(node: dict) -> str:
        if "" in node:
            return ""
        return f"(?:{'|'.join(f'[{re.escape(x + of.get(x, str()))}]+[.]*{pattern(more)}' for x, more in sorted(node.items()))})"

    search, gaps = re.compile(pattern(trie) if trie else r"(?!)").search, _Gaps()
    return lambda token: search(_stretched.sub(r"\1\1\1", token).translate(gaps)) is not None


def stems(word: str) -> list[str]:
    return [word[:n] + "*" for n in STEMS if len(word) > n]


def weight_of(word: str, weights: dict[str, float]) -> float:
    """A word's own weight, else that of its longest stem that has one, else 0."""
    return next((weights[x] for x in (word, *stems(word)) if x in weights), 0.0)


def document_words(text: str, known: Known) -> dict[str, int]:
    """The words of a text and their stems, each with the set of hashes (0 to 63, as bits) of the tokens that it stands after."""
    tokens, out = text.lower().split(), {}
    before = dict(zip(reversed(tokens), reversed(["", *tokens[:-1]])))  # of a token the first one it stands after
    for token in {*tokens, *(" " + run for run in spelled(tokens))}:  # no token begins with a space
        context = 1 << (xxhash.xxh32_intdigest(before.get(token, "")) & 63)
        for word in [word] if (word := plain(token)) else known[token]:
            for feature in (word, *stems(word)):
                out[feature] = out.get(feature, 0) | context
    return out


class Weigher(dict):
    """What a token's words weigh, remembered by token. Only tokens that may hold a learned word need the decoder."""

    def __init__(self, decoder: Decoder, weights: dict[str, float]) -> None:
        self.decoder, self.weights = decoder, weights
        self.plain_room, self.room = PLAIN_BYTES, MEMO_BYTES
        self.may_hold = spellings(weights)

    def __missing__(self, token: str) -> float:
        if word := plain(token):
            weight = weight_of(word, self.weights)
            if self.plain_room > 0:
                self[token] = weight
                self.plain_room -= 150 + len(token)
            return weight
        if self.may_hold(token):
            words = self.decoder.apart(token[1:]) if token[0] == " " else self.decoder.words(token)
            weight = sum((weight_of(w, self.weights) for w in words), 0.0)
        else:
            weight = 0.0
        if self.room > 0:
            self[token] = weight
            self.room -= 200 + 4 * len(token)
        return weight

    def weigh(self, text: str) -> tuple[float, int]:
        """What all tokens of a text weigh, and how many there are."""
        tokens = text.lower().split()
        return sum(map(self.__getitem__, tokens)) + sum(self[" " + run] for run in spelled(tokens)), len(tokens)


class Model:
    """Language model, word weights and the logistic function of a document's weight."""

    def __init__(self, grams: Language, weights: dict[str, float], curve: tuple[float, ...]) -> None:
        self.grams, self.weights, self.curve = grams, weights, curve

    def weigher(self) -> Weigher:
        return Weigher(Decoder(self.grams, [w for w in self.weights if w[-1] != "*"]), self.weights)

    def weigh(self, texts: list[str], weigher: Weigher | None = None) -> np.ndarray:
        """A row for each text: the weight of its tokens and their number, both as log1p."""
        weigher = self.weigher() if weigher is None else weigher
        return np.log1p(np.array([weigher.weigh(t) for t in texts], dtype=float).reshape(-1, 2))

    def score(self, weighed: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1 / (1 + np.exp(-(a + b * weighed[:, 0] + c * weighed[:, 1])))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Intercept and slopes by Newton's method with a small ridge; without rows even odds."""
    if not len(x):
        return (0.0,) * (x.shape[1] + 1)
    design = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(len(w)), design.T @ (y - p) - 0.1 * w)
        w += step
        if abs(step).max() < 1e-9:
            break
    return tuple(map(float, w))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held_out: int = 2, rows: int = labelled.SAMPLE_ROWS) -> Model:
    """The language model from all of docs, the rest from at most ``rows`` labelled documents outside the held-out fold.

    Without labels nothing is learned and every score is 0.5.
    """
    spark = docs.sparkSession
    sample = written(labelled.sample(docs, labels, label, folds, held_out, rows))
    grams = language_model(trigrams(docs), letters_of_words(sample))
    shared = spark.sparkContext.broadcast(grams)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Known(Decoder(shared.value))
        for batch in batches:
            n, n1, contexts = Counter(), Counter(), {}
            for text, y in zip(batch["text"].array, batch["label"].array):
                words = document_words(text, known)
                n.update(words.keys())
                if y:
                    n1.update(words.keys())
                    for word, bits in words.items():
                        contexts[word] = contexts.get(word, 0) | bits
            if not n:  # pandas would take the columns of no words for numbers
                continue
            signed = np.array([contexts.get(w, 0) for w in n], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"word": list(n), "n": list(n.values()), "n1": [n1[w] for w in n], "contexts": signed})

    counts = sample.mapInPandas(count, "word string, n long, n1 long, contexts long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"), F.bit_or("contexts").alias("contexts"))
    enough = (F.col("n1") >= LEAST_DOCS) & (F.col("n1") >= LEAST_SHARE * F.col("n")) & (F.bit_count("contexts") >= LEAST_CONTEXTS)
    learned = counts.where(enough).orderBy(F.desc("n1"), "word").collect()  # of a bounded sample
    weights = {r["word"]: math.log((r["n1"] + 1) / (r["n"] - r["n1"] + 1)) + 1 for r in learned}
    model = Model(grams, weights, (0.0, 0.0, 0.0))
    held = spark.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weigher = held.value.weigher()
        for batch in batches:
            yield pd.DataFrame(held.value.weigh(batch["text"].tolist(), weigher), columns=["weight", "tokens"]).assign(label=batch["label"].to_numpy())

    known = sample.mapInPandas(weigh, "weight double, tokens double, label int").toPandas().sort_values(["weight", "tokens", "label"])
    model.curve = logistic(known[["weight", "tokens"]].to_numpy(float), known["label"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """docs with a score column: the probability of label 1 of its whole text; null and empty texts weigh nothing and have no tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weigher = shared.value.weigher()
        for texts in batches:
            yield pd.Series(shared.value.score(shared.value.weigh(texts.tolist(), weigher)))

    return docs.withColumn(into, scored(text_of(text)))
