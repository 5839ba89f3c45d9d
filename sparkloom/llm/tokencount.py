"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton finds every piece that ends at each character; a dynamic programme
carries the best score up to there and how many pieces that path has, and no path is ever
walked back. Rules as in the public unigram tokenizers: a path replaces another only for a
strictly better score, tried from the leftmost start, so of equal paths the one with the
longest last piece stays; a character that is no piece is unknown, costs the worst score less
10, and counts as its UTF-8 bytes where the vocabulary has byte pieces.

No piece goes on past a word into the next word's space, so a text's count is the sum over its
space-led words, and each worker remembers the counts of words it has met.
"""

from __future__ import annotations

import re
from functools import cache
from math import inf

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import text_of

SPACE = "▁"
UNKNOWN_COST = 10.0
#: Bytes of words that a worker remembers, about.
MEMO_BYTES = 32_000_000
_words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Vocabulary(dict):
    """Counts of words without their leading space, as a dict that fills itself."""

    def __init__(self, pieces: list[tuple[str, float]], byte_pieces: bool) -> None:
        self.trie = ahocorasick.Automaton()
        for piece, score in pieces:
            self.trie.add_word(piece, (len(piece), score))
        self.trie.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_COST
        self.byte_pieces, self.room = byte_pieces, MEMO_BYTES
        self.known = {piece for piece, _ in pieces if len(piece) == 1}
        self.apart = not any(SPACE in piece.lstrip(SPACE) for piece, _ in pieces)

    def viterbi(self, text: str) -> int:
        """Pieces of the best path through text, in which spaces are SPACE already."""
        n = len(text)
        if self.known.issuperset(text):  # nothing unknown; the automaton gives what ends at a place longest first
            best, count = [0.0] + [-inf] * n, [0] * (n + 1)
            for end, (length, score) in self.trie.iter(text):
                start = end + 1 - length
                if (value := best[start] + score) > best[end + 1]:
                    best[end + 1], count[end + 1] = value, count[start] + 1
            return count[n]
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, match in self.trie.iter(text):
            ending[end + 1].append(match)
        best, count, open_unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            top = None
            for length, score in sorted(ending[end], reverse=True):  # leftmost start first
                if top is None or best[end - length] + score > top:
                    top, count[end] = best[end - length] + score, count[end - length] + 1
            if not any(length == 1 for length, _ in ending[end]):
                score = best[end - 1] + self.unknown
                if top is None or score > top:
                    # unknown characters in a row are one unknown piece, or their bytes
                    more = len(text[end - 1].encode()) if self.byte_pieces else int(not open_unknown[end - 1])
                    top, count[end], open_unknown[end] = score, count[end - 1] + more, True
            best[end] = top
        return count[n]

    def __missing__(self, word: str) -> int:
        value = self.viterbi(SPACE + word)
        if self.room > 0:
            self[word] = value
            self.room -= 150 + len(word)
        return value

    def count(self, text: str) -> int:
        """Tokens of a whole text, to which one leading space is added; of an empty text none."""
        if not text:
            return 0
        if self.apart and "  " not in text and SPACE not in text and text[0] != " " and text[-1] != " ":
            return sum(map(self.__getitem__, text.split(" ")))
        whole = SPACE + text.replace(" ", SPACE)
        return sum(map(self.viterbi, _words.findall(whole))) if self.apart else self.viterbi(whole)


@cache
def vocabulary(model_path: str) -> Vocabulary:
    """Pieces and scores of a sentencepiece file, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = range(model.get_piece_size())
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return Vocabulary(pieces, any(model.is_byte(i) for i in ids))


def n_tokens(text: str | Column, model_path: str) -> Column:
    """How many tokens a text column's whole texts have; a null text has none."""

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        count = vocabulary(model_path).count
        return pd.Series([count(t) for t in texts.array], dtype="int64")

    return counted(text_of(text) if isinstance(text, str) else text)


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """docs with a count of tokens, row by row: repeated rows, null ids and an empty table need nothing special."""
    return docs.withColumn(into, n_tokens(text, model_path))
