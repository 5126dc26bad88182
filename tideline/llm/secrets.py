"""Secret scans over an incremental blob ledger.

A *blob* is a text, addressed by the SHA-256 of its content; a *path* is a row that holds it. The ledger is a table
(blob, rule_version, kind, start, end) with one row for every blob that a version of the rules has scanned, findings or
not. A scan

1. addresses all rows (a narrow table),
2. takes the blobs that the ledger lacks under this rule version and names one row of each as its owner,
3. scans the owners' texts only, and appends them to the ledger in one write, and
4. joins the ledger's findings back to all rows that hold the blob.

Run again, it scans what is new; under new rules, everything once. A failed run leaves the ledger as it was.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import durable, look_up, map_slices

# The rules, in their order. Of each, leftmost matches that do not overlap; those that fail a length go.
BASE_KINDS = ["assign", "access", "hex"]
MORE_KINDS = ["github", "slack", "jwt", "pem"]
KINDS = BASE_KINDS + MORE_KINDS
RULE_VERSION = 2

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a shorter run fails, so only long ones are looked for
_MORE = {
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"),
    "slack": re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    # begins at a word's edge and gives nothing back, so no run of characters is read more than three times
    "jwt": re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    "pem": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
}
_MARKS = {"github": "gh", "slack": "xox", "jwt": "eyJ", "pem": "-----BEGIN"}

FINDINGS = "blob string, kind array<string>, start array<bigint>, end array<bigint>"


def find_secrets(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) in code points, end exclusive, by start and then by kind as listed."""
    found = []
    low = text.lower()
    if any(word in low for word in ("passw", "secret", "token", "api")):
        found += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    for kind, rule in _MORE.items():
        if _MARKS[kind] in text:
            found += [(m.start(), kind, m.end()) for m in rule.finditer(text)]
    return sorted(found, key=lambda f: (f[0], KINDS.index(f[1]), f[2]))


def scan_texts(blobs: DataFrame) -> DataFrame:
    """Findings of each row (blob, text): arrays kind, start, end."""

    def make():
        def work(batch, data, offsets):
            rows = [find_secrets(t or "") for t in batch.column("text").to_pylist()]
            return {
                "blob": batch.column("blob"),
                "kind": pa.array([[f[1] for f in r] for r in rows], pa.list_(pa.string())),
                "start": pa.array([[f[0] for f in r] for r in rows], pa.list_(pa.int64())),
                "end": pa.array([[f[2] for f in r] for r in rows], pa.list_(pa.int64())),
            }

        return work

    return map_slices(blobs.select("blob", "text"), "text", FINDINGS, make)


def read_ledger(spark: SparkSession, path: str, rule_version: int) -> DataFrame:
    """The ledger's rows of a rule version: none where no ledger is there yet."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    schema = f"{FINDINGS}, rule_version int"
    ledger = spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)
    return ledger.where(F.col("rule_version") == rule_version).drop("rule_version")


def secret_scan(docs: DataFrame, ledger: str, rule_version: int = RULE_VERSION) -> DataFrame:
    """Each row of ``docs`` as (doc_id, blob, kind, start, end) with the findings of its text; new blobs join the ledger.

    A null text is the empty blob. Rows that repeat share a blob and each get its findings. An empty table gives none.
    Every rule reads a text in time proportional to its length. A blob that very many rows hold is looked up in parts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # addresses travel as 32 bytes, and as hex only in the ledger and the result
    rows = rows.withColumn("_b", F.unhex(F.sha2("text", 256)))
    paths = durable(rows.select("doc_id", "_b"))
    blobs = paths.groupBy("_b").agg(F.min("doc_id").alias("_owner"))
    scanned = read_ledger(spark, ledger, rule_version).select(F.unhex("blob").alias("_b"))
    owners = blobs.join(scanned, "_b", "left_anti").withColumnRenamed("_b", "_blob")
    texts = rows.join(owners, F.col("doc_id").eqNullSafe(F.col("_owner")) & (F.col("_b") == F.col("_blob")))
    # rows that repeat are scanned each, and their findings, not their texts, are thinned out
    made = scan_texts(texts.select(F.lower(F.hex("_b")).alias("blob"), "text")).dropDuplicates(["blob"])
    made.withColumn("rule_version", F.lit(rule_version)).write.mode("append").partitionBy("rule_version").parquet(ledger)
    found = read_ledger(spark, ledger, rule_version).withColumn("_b", F.unhex("blob")).drop("blob")
    return look_up(paths, found, "_b", "doc_id").withColumn("blob", F.lower(F.hex("_b"))).select("doc_id", "blob", "kind", "start", "end")


def secret_digest(found: DataFrame) -> DataFrame:
    """The columns of the registered query from the rows of :func:`secret_scan`."""
    spans = F.arrays_zip("kind", "start", "end")
    text = lambda some: F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("kind", lambda k: k == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(text(base), 256).alias("base_sha256"), text(spans).alias("spans"))
