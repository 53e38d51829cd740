"""Language identification by compression.

Each language has a zstandard dictionary of raw content (text of that language).  A text, lowered and
with only its letters and white space left, is encoded with every dictionary, in chunks so that a long
text doesn't become its own dictionary, and gets the language with the smallest sum of sizes.  Close
calls are encoded once more at a higher level; margins that stay narrow are rejected.

Training takes at most ``SAMPLE_DOCS`` texts per language, first in the order of a hash of doc_id, of each its first
``SAMPLE_CHARS`` characters, until ``DICTIONARY_BYTES`` are reached: documented bounds of the sample.  Texts that
are judged are judged whole.

Null text, and text without a letter, is ``und`` with score 0 and rejected; so is all text where
nothing can be learned.  Ties go to the language first in code-point order.  Rows that repeat are
judged alike; empty tables give empty results; clashing columns of the caller are replaced.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from runlattice.llm.common import batches, table

SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 96, 16_384, 112_640
LEVEL, CHUNK = 5, 4096
#: Below this share of the second-best size a text is encoded again, at the level that finds most.
CLOSE_MARGIN, CLOSE_LEVEL = 0.04, 12
#: Rejected below this share of the second-best size, and when fewer than MIN_BYTES apart, as very short texts can be.
MIN_MARGIN, MIN_BYTES = 0.01, 2
UND = "und"


def learn(docs: DataFrame) -> dict[str, bytes]:
    """Language to dictionary content, from rows of (doc_id, text, lang)."""
    size = F.octet_length("text")
    fit = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (size > 0))
    key = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id"), F.xxhash64("text")]
    narrow = fit.select("lang", "doc_id", *[k.alias(f"_k{i}") for i, k in enumerate(key)])
    first = narrow.withColumn("_n", F.row_number().over(W.partitionBy("lang").orderBy("_k0", "doc_id", "_k2")))
    first = first.where(F.col("_n") <= SAMPLE_DOCS).select("lang", "doc_id", "_k2", "_n").distinct()
    picked = fit.select("lang", "doc_id", "text", F.xxhash64("text").alias("_k2")).join(
        F.broadcast(first), ["lang", "doc_id", "_k2"]  # SAMPLE_DOCS rows for each language at most
    )
    out: dict[str, list[str]] = {}
    rows = picked.groupBy("lang", "_n").agg(F.first(F.substring("text", 1, SAMPLE_CHARS)).alias("text")).collect()
    for row in sorted(rows, key=lambda r: (r.lang, r._n)):
        have = out.setdefault(row.lang, [])
        if sum(map(len, have)) < DICTIONARY_BYTES:
            have.append(letters(row.text))
    return {k: "\n".join(v).encode() for k, v in out.items()}


_NO_LETTER = re.compile(r"[^\w\s]+|[\d_]+")


def letters(text: str) -> str:
    """The text lowered, with a space for all that is neither letter nor white space."""
    return _NO_LETTER.sub(" ", text.lower())


def _sizes(text: str, packers: list) -> list[int]:
    data = text.encode("utf-8", "surrogatepass")
    parts = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
    return [sum(len(p.compress(x)) for x in parts) for p in packers]


def packers(dictionaries: dict[str, bytes], level: int = LEVEL) -> list:
    """A compressor for each language, in code-point order of the names."""
    out = []
    for name in sorted(dictionaries):
        content = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=level)
        out.append(zstandard.ZstdCompressor(level=level, dict_data=content, write_content_size=False, write_dict_id=False))
    return out


class Judge:
    """(language, score from 0 to 1, rejected) of a text."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = sorted(dictionaries)
        self.fast, self.strong = packers(dictionaries), packers(dictionaries, CLOSE_LEVEL)

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.names or not any(c.isalpha() for c in text):
            return UND, 0.0, True
        if len(self.names) == 1:
            return self.names[0], 1.0, False
        plain = letters(text)
        name, margin, apart = self._best(_sizes(plain, self.fast))
        if margin < CLOSE_MARGIN:
            name, margin, apart = self._best(_sizes(plain, self.strong))
        return name, margin, margin < MIN_MARGIN or apart < MIN_BYTES

    def _best(self, sizes: list[int]) -> tuple[str, float, int]:
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        best, second = sizes[order[0]], sizes[order[1]]
        return self.names[order[0]], (second - best) / second, second - best


ADDED = ("lang_pred", "score", "rejected")


def predict(docs: DataFrame, dictionaries: dict[str, bytes], added: tuple[str, str, str] = ADDED) -> DataFrame:
    """``docs`` with lang_pred, score and rejected, or what ``added`` calls them; only the text is looked at."""
    rest = docs.drop(*added)
    schema = StructType(list(rest.schema))
    for name, kind in zip(added, ("string", "double", "boolean")):
        schema = schema.add(name, kind)
    at, names = rest.columns.index("text"), [*rest.columns, *added]

    def run(it):
        judge = Judge(dictionaries)
        for batch in batches(it):
            got = [judge(t) for t in batch.column(at).to_pylist()]
            more = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names)

    return rest.mapInArrow(run, schema)


def fold(docs: DataFrame) -> DataFrame:
    """``docs`` with held_out: crc32 of doc_id as text is a multiple of 5 (null doc_id: as empty text)."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    return docs.withColumn("held_out", F.pmod(F.crc32(key), F.lit(5)) == 0)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fold(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    learned = learn(docs.where(~F.col("held_out")))
    return predict(docs.select("doc_id", "held_out", "text"), learned).select(
        "doc_id", "held_out", "lang_pred", "score", "rejected"
    )
