"""Secret scans over an incremental blob ledger.

Content is addressed by its SHA-256: a text that occurs at many ids, sources or times is one
blob. The ledger is a table of (blob, rules) pairs that were scanned, beside a table of what
was found. A run scans the blobs whose pair with the present rules is not in the ledger, each
once, appends both tables, and joins the findings of this rule version back to every row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import written


@dataclass(frozen=True)
class Rule:
    """A kind of secret: every leftmost non-overlapping match, kept if group ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    #: Some of these (in either case if ``fold``) is in any text that matches; () for none.
    needs: tuple[str, ...] = ()
    fold: bool = False


#: In the order in which kinds at the same start are listed.
BASE_RULES = (
    Rule("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, ("passw", "secret", "token", "api"), True),
    Rule("access", r"AKIA[A-Z0-9]+", 18, 0, ("AKIA",)),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{16,}", 16),
)
#: What the scanner looks for besides: key blocks and tokens whose prefix names their issuer.
MORE_RULES = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 1, 0, ("PRIVATE KEY",)),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 40, 0, ("gh",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40, 0, ("eyJ",)),
)
RULES = BASE_RULES + MORE_RULES


def rules_version(rules: tuple[Rule, ...]) -> str:
    return sha256(repr(rules).encode()).hexdigest()[:16]


def find(text: str, rules: tuple[Rule, ...]) -> list[tuple[int, int, int]]:
    """(start, order of the kind, end) in code points, sorted."""
    found, folded = [], None
    for k, rule in enumerate(rules):
        if rule.needs:
            if rule.fold and folded is None:
                folded = text.lower()
            if not any(x in (folded if rule.fold else text) for x in rule.needs):
                continue
        for m in re.finditer(rule.pattern, text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def blobs(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with blob, the lower-case SHA-256 of the text (null: of the empty text)."""
    return docs.withColumn("blob", F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256))


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path, empty if there is none yet. One that can't be read is an error: nothing must be taken for unseen because of it."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return spark.createDataFrame([], schema)


#: The ledger's tables: both have a folder for each rule version, and findings one for blobs with some and one for those without.
SEEN = "blob string, rules string"
FOUND = "blob string, found array<struct<kind: string, start: long, end: long>>, rules string, hit boolean"
#: If at most one blob in SHARE is unseen, and FEW at most (25 MB of hashes), these are sent to the rows, so that no text is
#: shuffled; else texts go to them, which is less than SHARE times what is new.
SHARE, FEW = 20, 200_000


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with blob and found: array of (kind, start, end), by start, then kind as listed.

    ``ledger`` is a folder that all executors share; it is made at the first run and only ever
    appended to: findings first, then what was seen, so a run that ends between the two leaves
    blobs that the next one scans again, to no other result. Runs on one ledger follow each
    other; two at once may both scan a blob, which adds rows but changes no result. A null text is the empty blob; a null id is scanned like any other; equal texts
    get equal findings, in whatever rows. An empty table adds nothing and gives no rows.
    Columns of docs named blob or found are replaced.

    A run scans, shuffles and appends what is new. Of what earlier runs left it reads this rule
    version's hashes, to tell what is new, and the findings of blobs that had any.
    """
    spark, version = docs.sparkSession, rules_version(rules)
    keyed = blobs(docs.drop("found", "blob"), text)
    seen = _table(spark, f"{ledger}/seen", SEEN).where(F.col("rules") == version).select("blob")
    # one row stands for each unseen blob; only ids and hashes are compared to find it
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body")).withColumn("blob", F.sha2("body", 256))
    mine = written(rows.groupBy("blob").agg(F.min("id").alias("id")))
    unseen = written(mine.join(seen, "blob", "left_anti"))

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in find(body, rules)] for body in batch["body"].array]
            yield pd.DataFrame({"blob": batch["blob"], "found": found, "rules": version, "hit": [bool(x) for x in found]})

    # repeated rows have equal blobs, so the groups below are scanned once a row at most
    first = unseen.select(F.col("blob").alias("first_blob"), F.col("id").alias("first_id"))
    n = unseen.count()
    if n <= FEW and SHARE * n <= mine.count():
        first = F.broadcast(first)
    bodies = rows.join(first, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("blob") == F.col("first_blob")), "left_semi")
    results = bodies.select("blob", "body").mapInPandas(scanned, FOUND)
    results.write.mode("append").partitionBy("rules", "hit").parquet(f"{ledger}/found")
    unseen.select("blob", F.lit(version).alias("rules")).write.mode("append").partitionBy("rules").parquet(f"{ledger}/seen")
    # a table, not an aggregate above the same exchange, so that Spark can split the join where one blob has very many rows
    known = _table(spark, f"{ledger}/found", FOUND).where((F.col("rules") == version) & F.col("hit")).select("blob", "found")
    hits = written(known.join(mine, "blob", "left_semi").dropDuplicates(["blob"]))
    joined = keyed.join(hits, "blob", "left")
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return joined.withColumn("found", F.coalesce("found", none))
