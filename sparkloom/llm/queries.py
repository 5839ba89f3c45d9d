"""The text operators as registered queries: thin layers that read whole tables and return each contract's columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, hardneg, labelled, linededup, media, neardup, packing, quality, secretscan, suffixdedup, tokencount, toxicity, warc, whitening
from sparkloom.llm.common import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt to all cores if its files give fewer partitions than there are cores."""
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def byte_bpe() -> tuple[str, str]:
    """The public byte-level BPE, as tokenizer file and as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), *byte_bpe(), capacity=1024, end_id=2)


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.drop_repeated_lines(table(spark, sf_dir, "documents"), min_docs=3, min_chars=20)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op9_line_dedup"] = r"""
    WITH whole AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    lines AS (
      SELECT doc_id, line, pos, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM whole)
    ),
    common AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    marked AS (SELECT lines.*, common.keeper IS NOT NULL AND common.keeper <> doc_id AS gone FROM lines LEFT JOIN common USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
"""


@query
def op1_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ledger = table(spark, sf_dir, "documents"), scratch_dir(spark)
    secretscan.scan(docs.where("lang = 'de'"), ledger)  # an earlier crawl, so that the whole table meets a ledger with blobs seen
    found = secretscan.scan(docs, ledger)
    base = F.filter("found", lambda x: x["kind"].isin([r.kind for r in secretscan.BASE_RULES]))
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda kind: F.filter("found", lambda x: x["kind"] == kind)
    counts = [F.size(of(rule.kind)).cast("long").alias(f"n_{rule.kind}") for rule in secretscan.BASE_RULES]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


# Kind, its place in the list, pattern, the group that is measured, and its least length.
_SECRETS = (
    ("assign", 0, r"""((?:PASSWORD|PASSWD|SECRET|TOKEN|API_?KEY))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", 1, "AKIA[A-Z0-9]+", 0, 18),
    ("hex", 2, "[0-9a-f]+", 0, 16),
    ("pem", 3, "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1),
    ("forge", 4, "gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("jwt", 5, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)


def _spans(kind: str, nth: int, pattern: str, group: int, least: int) -> str:
    """A kind's matches and, from the lengths of what lies between them, where they begin."""
    return f"""
      SELECT doc_id, '{kind}' AS kind, {nth} AS nth, start, '{kind}:' || start || ':' || (start + size) AS span FROM (
        SELECT doc_id, held, size, (sum(gap) OVER w + sum(size) OVER w - size)::BIGINT AS start FROM (
          SELECT doc_id, generate_subscripts(found, 1) AS i, length(unnest(found)) AS size, length(unnest(held)) AS held, length(unnest(between[: len(found)])) AS gap
          FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS found, regexp_extract_all(text, '{pattern}', {group}) AS held, string_split_regex(text, '{pattern}') AS between FROM d WHERE regexp_matches(text, '{pattern}'))
        ) WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)
      ) WHERE held >= {least}"""


def _any_case(pattern: str) -> str:
    """A pattern whose upper-case words stand for letters A to Z in either case, and for no others."""
    head, bracket, rest = pattern.partition("))")
    return re.sub("[A-Z]", lambda m: f"[{m[0]}{m[0].lower()}]", head) + bracket + rest


ORACLES["op1_secret_ledger"] = f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    spans AS ({" UNION ALL ".join(_spans(kind, nth, _any_case(pattern) if kind == "assign" else pattern, *rest) for kind, nth, pattern, *rest in _SECRETS)}),
    sums AS (
      SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(span, ',' ORDER BY start, nth) FILTER (nth < 3) AS base, string_agg(span, ',' ORDER BY start, nth) AS spans
      FROM spans GROUP BY doc_id
    )
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN sums USING (doc_id)
"""


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), span=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLES["op4_decontamination"] = r"""
    WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
    items AS (SELECT item_id, words, least(10, len(words)) AS span FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark) WHERE len(words) > 0),
    item_windows AS (SELECT DISTINCT item_id, span, words[i : i + span - 1] AS win FROM (SELECT *, unnest(range(1, len(words) - span + 2)) AS i FROM items)),
    doc_windows AS (
      SELECT doc_id, span, i, words[i : i + span - 1] AS win
      FROM (SELECT doc_id, words, span, unnest(range(1, len(words) - span + 2)) AS i FROM docs, (SELECT DISTINCT span FROM items) WHERE len(words) >= span)
    ),
    found AS (SELECT doc_id, span, i, item_id FROM doc_windows JOIN item_windows USING (span, win)),
    hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + span)) AS place FROM found) GROUP BY doc_id),
    by_item AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY doc_id)
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN by_item USING (doc_id)
"""


@query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixdedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), span=100)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op10_suffix_dedup"] = r"""
    WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hex FROM documents),
    spans AS (SELECT doc_id, p, md5_number(substr(hex, 2 * p + 1, 200)) AS name FROM (SELECT doc_id, hex, unnest(range(length(hex) // 2 - 99)) AS p FROM docs)),
    late AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY name ORDER BY doc_id, p) AS nth FROM spans) WHERE nth > 1),
    runs AS (
      SELECT doc_id, min(p) AS a, max(p) + 100 AS b
      FROM (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run
            FROM (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS fresh FROM late))
      GROUP BY doc_id, run
    ),
    pieces AS (
      SELECT doc_id, a, substr(hex, 2 * coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0))) AS before
      FROM runs JOIN docs USING (doc_id)
    ),
    kept AS (
      SELECT doc_id, string_agg(before, '' ORDER BY a) AS before FROM pieces GROUP BY doc_id
    ),
    totals AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last FROM runs GROUP BY doc_id)
    SELECT doc_id, length(hex) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
      sha256(unhex(coalesce(before, '') || substr(hex, 2 * coalesce(last, 0) + 1))) AS kept_sha256
    FROM docs LEFT JOIN kept USING (doc_id) LEFT JOIN totals USING (doc_id)
"""


@query
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"), threshold=0.8)


ORACLES["op2_near_duplicates"] = r"""
    WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[\s\x0B\x1C-\x1F\x85\xA0]+'), lambda x: x <> '') AS w FROM d),
    s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS shingle FROM w),
    b AS (SELECT doc_id, shingle, count(*) AS n FROM s GROUP BY 1, 2),
    t AS (SELECT doc_id, sum(n) AS total FROM b GROUP BY 1),
    p AS (SELECT x.doc_id AS a, y.doc_id AS c, sum(least(x.n, y.n)) AS shared FROM b x JOIN b y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2),
    links AS (
      SELECT a, c FROM p JOIN t ta ON ta.doc_id = a JOIN t tc ON tc.doc_id = c WHERE shared::DOUBLE / (ta.total + tc.total - shared) >= 0.8
      UNION SELECT x.doc_id, y.doc_id FROM d x JOIN d y ON x.text = y.text AND x.doc_id <> y.doc_id
    ),
    reached(doc_id, class_id) AS (SELECT doc_id, doc_id FROM d UNION SELECT a, class_id FROM reached JOIN links ON c = reached.doc_id)
    SELECT doc_id, min(class_id) AS class_id FROM reached GROUP BY doc_id
"""


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), folds=4, held_out=2)
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (labelled.fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = quality.fit(docs, table(spark, sf_dir, "labels"), folds=3, held_out=1)
    scored = quality.score(docs.select("doc_id", "text"), trees)
    return scored.select("doc_id", (labelled.fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op7_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media(table(spark, sf_dir, "documents"))


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens")


@query
def op11_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.records(warc.read(warc.write(table(spark, sf_dir, "pages"), scratch_dir(spark))))
    return found.select(warc.key_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), warc.key_of("refers_to").alias("refers_to"))


ORACLES["op11_warc_chunks"] = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
    d AS (
      SELECT *, max(page_id) OVER (PARTITION BY html) AS keeper,
        list_aggregate(list_transform(range(8), lambda g: list_aggregate(list_transform(range(4), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * g + 1, 5))::INT >> (15 - 5 * i)) & 31)::INT + 1, 1)), 'string_agg', '')), 'string_agg', '') AS digest
      FROM p
    )
    SELECT page_id, strlen(html) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM d
"""


@query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), scale=64, shift=1_000_000, wanted=16)


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hardneg.mine(rows, F.col("vec_id") % 50 == 0, scale=256, positives=5, negatives=3, low=50, high=95)


ORACLES["op13_hard_negatives"] = """
    WITH r AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(c::DOUBLE * 256)) AS x
      FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    ),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT * FROM (
      SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    ) WHERE rank <= 3
"""
