import random

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer, models

from sparkloom.llm import tokencount

PATH = public_tokenizers.path("piece_bpe_32k.model")


def tokenizer():
    """The public unigram implementation over the same pieces and scores."""
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    ids = range(sp.get_piece_size())
    vocabulary = [(sp.id_to_piece(i), sp.get_score(i)) for i in ids]
    worst = min(s for i, (_, s) in zip(ids, vocabulary) if not sp.is_byte(i))
    # byte and control pieces are no matches: their texts are spelled so that no input has them
    pieces = [(p if not sp.is_control(i) and not sp.is_unknown(i) else f"\0{i}", s if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) else worst) for i, (p, s) in zip(ids, vocabulary)]
    return Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))


def texts():
    rng = random.Random(1)
    out = ["", " ", "a", "hello world", "  two  spaces ", "line\nline\n\n", "漢字 🙂 ñandú", "▁odd▁ ", "x" * 300, "aaaa bbbb " * 50, "the " * 200, "tab\there", "\u0001\u0002é"]
    return out + ["".join(rng.choice("abcdefghi étn  .,0123\n漢") for _ in range(rng.randint(1, 200))) for _ in range(300)]


def test_counts_are_the_tokenizers_counts():
    own, public = tokencount.vocabulary(PATH), tokenizer()
    for text in texts():
        want = len(public.encode(tokencount.SPACE + text.replace(" ", tokencount.SPACE), add_special_tokens=False).ids) if text else 0
        assert own.count(text) == want, text


def test_ties_and_unknown_runs():
    toy = tokencount.Vocabulary([("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), (tokencount.SPACE, -1.0)], False)
    assert toy.viterbi("ab") == 1 and toy.viterbi("aba") == 2 and toy.viterbi("abab") == 2
    assert toy.viterbi("axxb") == 3 and toy.viterbi("x") == 1


def test_spark(spark):
    rows = [(i, t, 5) for i, t in enumerate(texts())] + [(None, "null id", 1), (7, None, 2), (3, "hello world", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    own = tokencount.vocabulary(PATH)
    got = sorted((repr((r.doc_id, r.n_tokens)) for r in tokencount.count_tokens(docs, PATH).collect()))
    assert got == sorted(repr((i, own.count(t or ""))) for i, t, _ in rows)
    assert tokencount.count_tokens(docs.limit(0), PATH).count() == 0
