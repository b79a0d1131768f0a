"""Secret scans over a ledger of content-addressed blobs.

Every version of a document is known by the SHA-256 of its text. The ledger holds, for each blob and rule version, the spans
that were found, an empty list included. A run scans the pairs of blob and rule version that the ledger lacks, each blob
once however many documents hold it, and joins the findings back to all of them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.llm.common import Scratch, per_text

#: Kinds, patterns, the group that must be long enough and its least length.
BASE = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Rules of this scan besides the base ones: keys in armour, web tokens, and user:password in a URL.
MORE = (
    ("armour", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END (?:[A-Z]+ ){0,3}PRIVATE KEY-----", 0, 1),
    ("webtoken", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("urlpass", r"\b[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:([^\s/@]{6,128})@", 0, 1),
)
RULES = (*BASE, *MORE)
RULE_VERSION = hashlib.sha256(repr(RULES).encode()).hexdigest()[:16]
_COMPILED = [(kind, re.compile(pattern), group, least) for kind, pattern, group, least in RULES]
#: A pattern is only run where its text occurs: a cheap search for what every match holds.
_HINTS = {"access": "AKIA", "armour": "PRIVATE KEY-----", "webtoken": "eyJ", "urlpass": "://"}

FINDING = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
LEDGER = T.StructType([T.StructField("blob", T.BinaryType()), T.StructField("rules", T.StringType()), T.StructField("findings", T.ArrayType(FINDING))])


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive: leftmost non-overlapping matches of each kind, less those that are too short."""
    out = []
    for kind, pattern, group, least in _COMPILED:
        if (hint := _HINTS.get(kind)) and hint not in text:
            continue
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return out


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(blobs by version, the ledger with every pair of blob and RULE_VERSION) for versions (version, text).

    `version` is any column that tells the versions apart, such as a path and a commit. The text moves through one shuffle,
    keyed by version, of which no value is hot; copies of a blob are told by their digest first, and one version of each
    unseen blob is scanned. A null text is the empty blob.
    """
    told, new = _scanned(versions, ledger)
    return told, new if ledger is None else ledger.select(*LEDGER.names).union(new)


def _scanned(versions: DataFrame, ledger: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(blobs by version, the findings of the blobs that the ledger lacks under RULE_VERSION)."""
    scratch = Scratch(versions.sparkSession)
    told = scratch.table(versions.select("version", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("blob")))
    one = told.groupBy("blob").agg(F.min("version").alias("version"))
    if ledger is not None:
        one = one.join(ledger.where(F.col("rules") == RULE_VERSION).select("blob"), "blob", "left_anti")
    texts = versions.select("version", F.coalesce("text", F.lit("")).alias("text"))
    # Equal rows share a version; of those and of null parts in it, one text is enough.
    unseen = texts.join(one.hint("shuffle_hash"), texts["version"].eqNullSafe(one["version"])).select("blob", "text")

    def run(batches) -> Iterator[dict]:
        for b in batches:
            found = [[dict(zip(("kind", "start", "end"), f, strict=True)) for f in scan(x)] for x in b.column("text").to_pylist()]
            yield {"blob": b.column("blob"), "rules": [RULE_VERSION] * len(found), "findings": found}

    return told, scratch.table(per_text(unseen, run, LEDGER).dropDuplicates(["blob"]))


class Ledger:
    """The ledger as a table in a folder that all machines reach, in parts by rule version; a scan adds what it has found and never scans a pair of blob and rule version again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self) -> DataFrame | None:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        if not root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
            return None
        return self.spark.read.schema(LEDGER).parquet(self.path).select(*LEDGER.names)

    def update(self, versions: DataFrame) -> tuple[DataFrame, int]:
        """(blobs by version, number of blobs that were scanned) for versions (version, text). A run that fails has added nothing, or whole files of findings that are right; blobs that two
        runs scan at once have two equal rows, of which readers take one."""
        told, new = _scanned(versions, self.read())
        new.write.mode("append").partitionBy("rules").parquet(self.path)
        return told, new.count()


def _digest(spans: F.Column, order: list[str]) -> F.Column:
    """kind:start:end by start, then kind in the given order, joined by commas."""
    keyed = F.transform(spans, lambda f: F.struct(f["start"].alias("s"), F.array_position(F.array(*map(F.lit, order)), f["kind"]).alias("k"), f["end"].alias("e"), f["kind"].alias("kind")))
    return F.concat_ws(",", F.transform(F.array_sort(keyed), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))))


def secrets_of(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): n_assign, n_access, n_hex, base_sha256 and spans.

    Rows that repeat a doc_id are versions of it, and each comes back as a row; a null text has no spans. The join on blobs
    moves digests and findings only; where one blob is very common, Spark splits its part of the join.
    """
    kinds, base = [k for k, *_ in RULES], [k for k, *_ in BASE]
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h")).alias("version"), "text")
    told, known = update_ledger(rows, ledger)
    found = told.join(known.where(F.col("rules") == RULE_VERSION), "blob")
    of = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    own = F.filter("findings", lambda f: f["kind"].isin(base))
    return found.select(F.col("version.doc_id").alias("doc_id"), *(of(k).alias(f"n_{k}") for k in base), F.sha2(_digest(own, base).cast("binary"), 256).alias("base_sha256"), _digest(F.col("findings"), kinds).alias("spans"))
