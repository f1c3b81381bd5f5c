"""Secret scans with an incremental ledger of blobs.

A text is a blob, addressed by its SHA-256. The ledger has a row per blob and version of
the rules; a scan reads only blobs that the ledger does not have yet under the current
version, and the findings are joined back to all rows (paths, versions) that hold the blob.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townhall.llm.common import row_key, settle

# The rules, in this order.
RULES = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]{16,}"), 0, 16),  # runs are maximal, so shorter ones need not be looked at
}
RULES_VERSION = "1"
LEDGER = "blob string, rules string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_text(text: str) -> tuple[int, int, int, str, str]:
    """Counts per kind, the digest of the spans and the spans as kind:start:end, in code points."""
    found, counts = [], []
    for rank, (kind, (pattern, group, least)) in enumerate(RULES.items()):
        own = [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
        counts.append(len(own))
        found += own
    spans = ",".join(x for _, _, x in sorted(found))
    return (*counts, hashlib.sha256(spans.encode()).hexdigest(), spans)


def history(docs: DataFrame) -> DataFrame:
    """Every version with its address: doc_id, source, blob, row_key. Null text is the empty blob."""
    c = F.col
    return docs.select("doc_id", "source", F.sha2(F.coalesce(c("text"), F.lit("")).cast("binary"), 256).alias("blob"), row_key(docs).alias("row_key"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, versions: DataFrame | None = None) -> DataFrame:
    """The ledger with the blobs of ``docs`` added: one row per blob and rules version.

    Blobs that ``ledger`` has under the current version are not read again. Of the rows that share
    a new blob one is scanned.
    """
    c = F.col
    versions = settle(history(docs)) if versions is None else versions
    fresh = versions.groupBy("blob").agg(F.min(F.struct("row_key", "doc_id")).alias("k"))
    if ledger is not None:
        fresh = fresh.join(ledger.filter(c("rules") == RULES_VERSION).select("blob"), "blob", "left_anti")
    fresh = settle(fresh.select(c("k.row_key").alias("_scan_key"), c("k.doc_id").alias("_scan_id")))
    rows = docs.select("doc_id", row_key(docs).alias("_row"), F.coalesce(c("text"), F.lit("")).alias("text"))
    unseen = rows.join(fresh, (c("_row") == c("_scan_key")) & c("doc_id").eqNullSafe(c("_scan_id")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["blob", "rules", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
        for b in batches:
            texts = b["text"].to_pylist()
            found = [(hashlib.sha256(t.encode()).hexdigest(), RULES_VERSION, *scan_text(t)) for t in texts]
            cols = list(zip(*found, strict=True)) if found else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if n.startswith("n_") else pa.string()) for n, v in zip(names, cols, strict=True)], names)

    # Rows repeated in full are scanned together; one entry stays.
    new = unseen.select("text").mapInArrow(run, LEDGER).dropDuplicates(["blob", "rules"])
    new = settle(new)
    return new if ledger is None else ledger.unionByName(new)


def report(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """A row per document with its blob's findings: doc_id, source, blob, counts, base_sha256, spans.

    Null and empty texts are one blob without findings. Repeated rows and copies get the same findings.
    An empty table gives an empty result; other columns are not read but for the row key.
    """
    versions = settle(history(docs))
    found = scan(docs, ledger, versions).filter(F.col("rules") == RULES_VERSION).drop("rules")
    return versions.join(found, "blob").select("doc_id", "source", "blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
