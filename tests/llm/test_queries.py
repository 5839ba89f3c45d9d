"""Each registered query over the whole tables of the smallest scale, against SQL or brute force."""

import hashlib
import math
import os
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import media, quality, queries, toxicity
from tests.llm import test_secretscan, test_whitening

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for n in ("documents", "benchmark", "labels", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {n} AS SELECT * FROM '{DATA}/{n}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rel = con.sql(queries.ORACLES[name])
    assert columns == sorted(rel.columns)
    got = sorted(map(tuple, df.select(*[F.col(c) for c in columns]).collect()), key=repr)
    assert got == sorted(rel.select(*columns).fetchall(), key=repr)


def test_op1(spark, texts):
    sha = lambda spans: hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
    want = set()
    for i, t in texts.items():
        spans = test_secretscan.brute(t)
        want.add((i, *[sum(k == kind for _, k, _ in spans) for kind in ("assign", "access", "hex")], sha(spans)))
    got = {(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in queries.QUERIES["op1_secret_ledger"](spark, DATA).collect()}
    assert got == want


def test_op2_loses_no_link(spark):
    """Every link of 0.8 or more at sf0.01, by SQL over all pairs."""
    folder = DATA.replace("sf0.001", "sf0.01")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = dict(con.sql(queries.ORACLES["op2_near_duplicates"]).fetchall())
    got = {r.doc_id: r.class_id for r in queries.QUERIES["op2_near_duplicates"](spark, folder).collect()}
    assert got == want and sum(a != b for a, b in want.items()) > 50


def labelled_rows(spark, texts, label, folds, held):
    known = {r.doc_id: r[label] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    return [(i, texts[i], known[i]) for i in sorted(known) if zlib.crc32(str(i).encode()) % folds != held and i in texts]


def test_op3_scores(spark, texts):
    """Scores worked out row by row: words of every token by the decoder alone, weights from counted words, without memos and shortcuts."""
    con = duckdb.connect()
    grams = Counter()
    for t in texts.values():
        said = "".join(c if c.isalpha() else " " for c in "  " + (t or "").lower() + "  ")
        grams.update(said[i : i + 3] for i in range(len(said) - 2))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    counted = toxicity.trigrams(docs)
    total = sum(r.n for r in counted.collect())
    language = toxicity.language_model(counted)
    assert sum(grams.values()) >= total - 4 * len(texts) and sum(language.three.values()) == total
    plain, n, n1, contexts = toxicity.Decoder(language), Counter(), Counter(), {}
    for _, text, y in labelled_rows(spark, texts, "toxic", 4, 2):
        tokens = (text or "").lower().split()
        of = {}
        for token in {*tokens, *(" " + run for run in toxicity.spelled(tokens))}:
            before = tokens[tokens.index(token) - 1] if token in tokens and tokens.index(token) else ""
            for word in plain.apart(token[1:]) if token[0] == " " else plain.words(token):
                for feature in (word, *toxicity.stems(word)):
                    of.setdefault(feature, set()).add(toxicity.xxhash.xxh32_intdigest(before) % 64)
        n.update(of.keys())
        if y:
            n1.update(of.keys())
            for feature, places in of.items():
                contexts.setdefault(feature, set()).update(places)
    weights = {w: math.log((n1[w] + 1) / (n[w] - n1[w] + 1)) + 1 for w in n1 if n1[w] >= 8 and n1[w] >= n[w] / 2 and len(contexts[w]) >= 6}
    model = toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert model.weights.keys() == weights.keys() and all(abs(model.weights[w] - v) < 1e-12 for w, v in weights.items())
    decoder = toxicity.Decoder(language, [w for w in weights if w[-1] != "*"])
    a, b, c = model.curve
    for r in queries.QUERIES["op3_toxicity"](spark, DATA).collect():
        tokens = (texts[r.doc_id] or "").lower().split()
        weight = sum(toxicity.weight_of(w, weights) for t in tokens for w in decoder.words(t)) + sum(toxicity.weight_of(w, weights) for run in toxicity.spelled(tokens) for w in decoder.apart(run))
        score = 1 / (1 + math.exp(-(a + b * math.log1p(weight) + c * math.log1p(len(tokens)))))
        assert abs(r.score - score) < 1e-9 and r.predicted == int(r.score >= 0.3), r.doc_id
    con.close()


def test_op5_scores(spark, texts):
    """Scores of trees walked node by node, grown on the same rows in another order."""
    rows = labelled_rows(spark, texts, "quality", 3, 1)
    x, y = np.array([quality.statistics(t or "") for _, t, _ in rows]), np.array([float(q) for _, _, q in rows])
    order = np.lexsort((*x.T, y))
    trees = quality.grow(x[order], y[order])
    for r in queries.QUERIES["op5_quality"](spark, DATA).collect():
        row, total = quality.statistics(texts[r.doc_id] or ""), trees.base
        for node in trees.roots:
            while trees.low[node] != node:
                node = trees.low[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.high[node]
            total += trees.value[node]
        assert abs(r.score - 1 / (1 + math.exp(-total))) < 1e-9, r.doc_id


@pytest.mark.parametrize(("name", "folds", "held"), [("op3_toxicity", 4, 2), ("op5_quality", 3, 1)])
def test_scores(spark, texts, name, folds, held):
    rows = queries.QUERIES[name](spark, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= (0.3 if name == "op3_toxicity" else 0.5))


def packed(texts, rows):
    """Checks pieces of whole documents, in sequences without gaps; returns how many sequences there are."""
    from tokenizers import Tokenizer

    full, by_doc, bins = Tokenizer.from_file(queries.byte_bpe()[0]), {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by_doc.keys() == texts.keys()
    for i, text in texts.items():
        ids = [*full.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want = [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[i]) == want, i
    for parts in bins.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:])) and min(parts)[0] == 0 and sum(n for _, n in parts) <= 1024
    return len(bins)


def test_op6(spark, texts):
    rows = queries.QUERIES["op6_best_fit_packing"](spark, DATA).collect()
    bins = packed(texts, rows)
    assert bins <= -(-sum(r.length for r in rows) // 1024) + max(2, bins // 100)


def test_op7(spark, texts):
    """The stored form made again, chunk by chunk, from each text alone."""
    compress = media.zstandard.ZstdCompressor(level=media.LEVEL, write_content_size=True).compress
    for r in queries.QUERIES["op7_media_chunks"](spark, DATA).collect():
        data = (texts[r.doc_id] or "").encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        ends, h, last = [], 0, 0
        for i, x in enumerate(payload, 1):
            h = ((h << 1) + int(media._GEAR[x])) & 0xFFFFFFFF
            if i - last >= media.LARGEST or i - last >= media.LEAST and h >> (32 - media.MASK_BITS) == 0 and len(payload) - last > media.LEAST:
                ends.append(i)
                last = i
        parts = [payload[a:b] for a, b in zip([0, *ends], [*ends, len(payload)]) if b > a]
        stored = media.MAGIC + struct.pack("<I", len(parts)) + b"".join(hashlib.sha256(p).digest() + struct.pack("<I", len(p)) for p in parts) + b"".join(map(compress, parts))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest()), r.doc_id
        x = np.frombuffer(payload, np.uint8)
        high = [v > x.mean() for v in x.tolist()]
        assert r.feature == f"chunks={len(parts)};longest={max(map(len, parts))};mean={x.mean():.6f};std={x.std():.6f};min={min(payload)};max={max(payload)};crossings={sum(a != b for a, b in zip(high, high[1:]))}"


def test_op8(spark, texts):
    from tests.llm import test_tokencount as t

    public = t.tokenizer()
    for r in queries.QUERIES["op8_token_counts"](spark, DATA).collect():
        text = texts[r.doc_id] or ""
        assert r.n_tokens == (len(public.encode(t.tokencount.SPACE + text.replace(" ", t.tokencount.SPACE), add_special_tokens=False).ids) if text else 0)


def test_op12(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    assert test_whitening.check(rows, queries.QUERIES["op12_embedding_whitening"](spark, DATA).collect(), close=1e-8) == 16
