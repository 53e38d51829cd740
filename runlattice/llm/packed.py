"""Shuffles of packed numbers: a row holds the numbers that one task has for one group of keys.

Rows of (group, bytes, bytes, ...) move 8-byte keys and values without a row's overhead for each; what
reads a group sorts it with numpy.  ``groups`` is set from the size of the input, so that a group
stays a few megabytes however much there is.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_BYTES = 3_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def trim() -> None:
    """Give free memory of this process back: Python workers live on for later tasks, and what they keep adds up."""
    pa.default_memory_pool().release_unused()
    back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if back:
        back(0)


def trimmed(batches: Iterator) -> Iterator:
    """The same batches; free memory goes back after the last."""
    yield from batches
    trim()


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


def groups_for(entry_bytes: float) -> int:
    return max(16, int(entry_bytes / GROUP_BYTES) + 1)


def deal(keys: np.ndarray, columns: list[np.ndarray], groups: int) -> Iterator[pa.RecordBatch]:
    """Batches (g int, c0 binary, c1 binary, ...) of the numbers, by group of their key."""
    if not len(keys):
        return
    g = ((keys * _MIX) >> np.uint64(40)) % np.uint64(groups)
    order = np.argsort(g, kind="stable")
    g = g[order]
    cuts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True])))
    columns = [c[order] for c in columns]
    arrays = [pa.array(g[cuts[:-1]].astype(np.int32), pa.int32())]
    for c in columns:
        arrays.append(pa.array([c[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()))
    yield pa.RecordBatch.from_arrays(arrays, schema_names(len(columns)))


def schema_names(n: int) -> list[str]:
    return ["g", *(f"c{i}" for i in range(n))]


def schema(n: int) -> str:
    return ", ".join(["g int", *(f"c{i} binary" for i in range(n))])


def unpack(column, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def per_group(dealt: DataFrame, dtypes: list, work: Callable, out: str) -> DataFrame:
    """``work(arrays)`` for every group, which yields tuples of columns of ``out``."""
    names = [x.split()[0] for x in out.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in out.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        arrays = [unpack(table.column(f"c{i}"), t) for i, t in enumerate(dtypes)]
        got = work(*arrays)
        del arrays
        trim()
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(got, kinds)], names)

    return dealt.groupBy("g").applyInArrow(run, out)
