"""Secret scans over an incremental blob ledger.

Every historical version of every path is content-addressed (SHA-256 of its text).  A ledger holds
the (blob, rule version) pairs that were scanned; only blobs without their pair are scanned, each
once however many paths and versions share it, and findings are joined back to all paths.

Null text counts as empty (one blob, no findings); repeated rows share a blob; an empty table gives
empty results; columns of the caller that clash with ours are replaced by ours.  A text may be of any length.
Whole texts are scanned; spans count code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlattice.functions.storage import materialize
from runlattice.llm.common import batches, table

#: Base rules: kind, pattern, group whose length counts, least length.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)
#: Further shapes that hardly occur outside secrets.
MORE = (
    ("pem", re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"), 0, 1),
    ("hosted", re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{20,}|sk_live_[A-Za-z0-9]{16,})"), 0, 1),
    ("jwt", re.compile(r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"), 0, 1),
)
RULES = BASE + MORE
#: Follows from the rules, so that an edited rule is another version.
RULE_VERSION = hashlib.sha256("\n".join(f"{name} {p.pattern} {p.flags} {g} {n}" for name, p, g, n in RULES).encode()).hexdigest()[:16]
N_BASE = len(BASE)


def find(text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, number of the rule) of all findings in a text, by start and then rule."""
    if not text:
        return []
    out = []
    for k, (_, pattern, group, least) in enumerate(RULES):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), m.end(), k))
    out.sort(key=lambda x: (x[0], x[2]))
    return out


FINDINGS = "blob string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan(it):
    names = [r[0] for r in RULES]
    for batch in batches(it):
        got = {k: [] for k in ("blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for blob, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = find(text)
            counts = [0] * len(RULES)
            for _, _, k in found:
                counts[k] += 1
            said = [f"{names[k]}:{a}:{b}" for a, b, k in found]
            base = ",".join(x for x, (_, _, k) in zip(said, found) if k < N_BASE)
            row = (blob, *counts[:N_BASE], hashlib.sha256(base.encode()).hexdigest(), ",".join(said))
            for key, value in zip(got, row):
                got[key].append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, pa.int64() if k.startswith("n_") else pa.string()) for k, v in got.items()], list(got)
        )


def address(versions: DataFrame, text: str = "text") -> DataFrame:
    """``versions`` with ``blob``, the SHA-256 of the text."""
    return versions.withColumn("blob", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def scan_unseen(
    versions: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION, text: str = "text"
) -> DataFrame:
    """Findings of the blobs of ``versions`` that ``ledger`` (blob, rule_version) doesn't have for this version.

    A row per blob, also without findings: appended to the ledger it marks the blob as seen.  Copies
    meet in partial aggregation, so a blob shared by a third of all rows is shuffled once per task.
    """
    blobs = address(versions, text).groupBy("blob").agg(F.first(text).alias("text"))
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == rule_version).select("blob").distinct()
        blobs = blobs.join(seen, "blob", "left_anti")
    return blobs.select("blob", "text").mapInArrow(_scan, FINDINGS).withColumn("rule_version", F.lit(rule_version))


def seen_by(findings: DataFrame) -> DataFrame:
    """The rows (blob, rule_version) that findings add to a ledger."""
    return findings.select("blob", "rule_version").distinct()


def scan_incrementally(versions: DataFrame, ledger_path: str, text: str = "text") -> DataFrame:
    """Findings of the blobs that the ledger at ``ledger_path`` (Parquet in a shared folder) doesn't have; it has them afterwards.

    The folder keeps the findings themselves, so those of earlier runs are found there.  A run that fails before the
    append has ended leaves the ledger as it was; its blobs are scanned again.
    """
    spark = versions.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(ledger_path)
    known = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)
    found = materialize(scan_unseen(versions, spark.read.parquet(ledger_path) if known else None, text=text), "secrets-new")
    found.write.mode("append").parquet(ledger_path)
    return found


def join_back(paths: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings for every row of ``paths`` (which has ``blob``)."""
    ours = {c.lower() for c in findings.columns} - {"blob"}
    return paths.drop(*[c for c in paths.columns if c.lower() in ours]).join(findings, "blob", "left")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_unseen(docs, spark.createDataFrame([], "blob string, rule_version string"))
    return join_back(address(docs).select("doc_id", "blob"), found).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"
    )


def _pieces(pattern: str, kind: str, group: int, least: int, rank: int) -> str:
    """SQL for one kind: matches and what lies between them give the places."""
    return f"""
SELECT k, {rank} AS r, '{kind}' AS kind, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0) AS s,
  length(found[i]) AS n
FROM (SELECT k, found, gaps, groups, unnest(range(1, len(found) + 1)) AS i FROM (
  SELECT k, regexp_extract_all(t, '{pattern}') AS found, regexp_extract_all(t, '{pattern}', {group}) AS groups, regexp_split_to_array(t, '{pattern}') AS gaps FROM d))
WHERE length(groups[i]) >= {least}"""


_ASSIGN = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
_ASSIGN = f"({_ASSIGN}|[Aa][Pp][Ii]_?[Kk][Ee][Yy])" + """["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({_pieces(_ASSIGN, "assign", 2, 6, 0)}
 UNION ALL {_pieces("AKIA[A-Z0-9]+", "access", 0, 20, 1)}
 UNION ALL {_pieces("[0-9a-f]+", "hex", 0, 24, 2)}
 UNION ALL {_pieces("-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", "pem", 0, 1, 3)}
 UNION ALL {_pieces(r"\\b(?:gh[pousr]_[A-Za-z0-9]{{36,}}|xox[abprs]-[A-Za-z0-9-]{{20,}}|sk_live_[A-Za-z0-9]{{16,}})".replace("{{", "{").replace("}}", "}").replace(chr(92) * 2, chr(92)), "hosted", 0, 1, 4)}
 UNION ALL {_pieces(r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", "jwt", 0, 1, 5)}),
g AS (SELECT k, CAST(count(*) FILTER (r = 0) AS BIGINT) AS n_assign, CAST(count(*) FILTER (r = 1) AS BIGINT) AS n_access, CAST(count(*) FILTER (r = 2) AS BIGINT) AS n_hex,
  string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, r) FILTER (r < 3) AS base,
  string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, r) AS spans FROM f GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON g.k = d.k
"""
