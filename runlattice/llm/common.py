"""What the corpus operators share: word rules, table access, Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space is \x20 and \x09-\x0D; a word is a maximal run of other characters.
SPACES = " \t\n\x0b\f\r"
#: Sides of a join of at most so many rows of a few numbers are broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\f\r", "     ")
    return F.array_remove(F.split(flat, " "), "")


def n_words(text: Column) -> Column:
    """Number of words as long, without building them: starts of runs of other characters."""
    return F.size(words(text)).cast("long")


def batches(it: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``rows`` rows, so that a worker holds few texts at a time."""
    for batch in it:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def lower_words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lowered; bytes methods know ASCII only, as the rule asks."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def free(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as it takes to clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is: joins then shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
