"""Exact removal of repeated byte strings by suffix arrays.

Every window of LENGTH bytes belongs to one anchor, the GRAM-byte string in it with the smallest hash, so
equal windows meet in the group of their anchor.  Neighbouring windows of one anchor form a region.  Groups
with one occurrence are done; regions that are equal as a whole are counted by hash; what remains, the
distinct regions of a group, is suffix-sorted in two stages: suffixes smaller than their successors are
sorted directly, the others are induced by scans of the buckets of first bytes.  Neighbours in the
suffix array with LENGTH bytes in common are repeats.

Groups of more than MAX_REGIONS distinct regions, a passage on the edge of very many texts, are not sorted
in one task: their windows are counted by hash, dealt anew, which is as exact.  Equal texts are one text here
(all of it repeats); texts meet by 64-bit hashes of their bytes.

Null text is empty; texts shorter than LENGTH lose nothing; repeated rows count as documents; an empty
table gives an empty result.  Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlattice.functions.storage import materialize
from runlattice.llm.common import batches, bounded, table
from runlattice.llm.packed import deal, mix64, schema, text_bytes, unpack

LENGTH, GRAM = 200, 64
MAX_REGIONS = 20_000
GROUP_BYTES, REGION_BYTES = 8_000_000, 2_000_000
_WINDOW = LENGTH - GRAM + 1
_P = 0x9E3779B97F4A7C15
_PI = pow(_P, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_P, _PI)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def anchors(data: bytes, chunk: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, region hash, first window, windows, offset of the anchor in the first window) of each region."""
    if len(data) < LENGTH:
        z = np.empty(0, np.int64)
        return z.astype(np.uint64), z.astype(np.uint64), z, z, z
    out = []
    for at in range(0, len(data) - LENGTH + 1, chunk):
        part = np.frombuffer(data, np.uint8)[at : at + chunk + LENGTH - 1]
        n = len(part)
        up, down = _grow(n + 1)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[part] * up[:n], out=total[1:])
        h = mix64((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
        # the place in the low bits: the leftmost of equal hashes is smallest
        v = (h & ~np.uint64((1 << 23) - 1)) | np.arange(len(h), dtype=np.uint64)
        m, width = v, 1
        while 2 * width <= _WINDOW:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        rest = _WINDOW - width
        m = np.minimum(m[: len(m) - rest], m[rest:]) if rest else m
        place = (m & np.uint64((1 << 23) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        count = np.diff(np.concatenate((first, [len(place)])))
        end = first + count - 1 + LENGTH
        region = mix64((total[end] - total[first]) * down[first] + count.astype(np.uint64))
        out.append((h[place[first]], region, first + at, count, place[first] - first))
    return tuple(np.concatenate(x) for x in zip(*out))


def suffix_order(text: np.ndarray, ends: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Places of ``text`` in the order of their suffixes, which stop at the end of their piece.

    ``text``: pieces of bytes as int16 values from 1, each followed by eight zeros; ``ends``: for each place,
    where its piece ends.  Suffixes agree with the order on their first ``depth`` bytes at least.
    """
    n = len(text)
    real = text > 0
    nxt = np.empty(n, np.int16)
    nxt[:-1], nxt[-1] = text[1:], 0
    # smaller than the successor: the next byte that differs is larger
    at = np.where(text != nxt, np.arange(n), n)
    at = np.minimum(np.minimum.accumulate(at[::-1])[::-1], n - 1)
    rising = (text[at] < nxt[at]) & real

    padded = np.concatenate((text, np.zeros(16, np.int16))).astype(np.int32)
    low = np.where(padded > 0, padded - 1, 0).astype(np.uint8)
    word = np.zeros(n + 8, np.uint64)
    for k in range(8):
        word |= low[k : k + n + 8].astype(np.uint64) << np.uint64(56 - 8 * k)

    # stage 1: sort those directly, eight bytes a round, as long as they tie
    order = np.flatnonzero(rising)
    group = text[order].astype(np.int64)
    order = order[np.argsort(group, kind="stable")]
    group = text[order].astype(np.int64)
    tied = np.arange(len(order))
    for d in range(0, depth, 8):
        if not len(tied):
            break
        p = order[tied]
        w = np.where(p + d < ends[p], word[np.minimum(p + d, n)], np.uint64(0))
        sub = np.lexsort((w, group[tied]))
        p, w, g = p[sub], w[sub], group[tied][sub]
        order[tied] = p
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (w[1:] != w[:-1])))
        number = np.cumsum(new)
        # group numbers only have to tell groups apart and to rise
        group[tied] = tied[np.flatnonzero(new)][number - 1] + 1000
        size = np.diff(np.concatenate((np.flatnonzero(new), [len(new)])))
        tied = tied[np.repeat(size > 1, size)]
    by_first = np.searchsorted(text[order], np.arange(259))

    # stage 2: bucket by bucket, the others from their successors
    pending: list[list[np.ndarray]] = [[] for _ in range(258)]

    def scan(places: np.ndarray, c: int) -> np.ndarray:
        """Predecessors in the bucket itself; those of higher buckets are noted there."""
        p = places[places > 0] - 1
        t = text[p]
        same = p[(t == c) & ~rising[p]] if c else p[:0]
        p, t = p[t > c], t[t > c]
        by = np.argsort(t, kind="stable")
        p, t = p[by], t[by]
        cuts = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1], [True]))) if len(t) else [0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            pending[t[a]].append(p[a:b])
        return same

    scan(np.flatnonzero(~real & np.concatenate(([False], real[:-1]))), 0)
    out = []
    for c in range(1, 257):
        now = np.concatenate(pending[c]) if pending[c] else np.empty(0, np.int64)
        pending[c] = []
        while len(now):
            out.append(now)
            now = scan(now, c)
        direct = order[by_first[c] : by_first[c + 1]]
        if len(direct):
            out.append(direct)
            scan(direct, c)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def repeated_windows(pieces: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """For regions (bytes one after the other, ``windows`` + LENGTH - 1 of each): which windows occur more than once."""
    size = windows + LENGTH - 1
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    shift = np.repeat(8 * np.arange(len(size)), size)
    n = int(size.sum()) + 8 * len(size)
    text = np.zeros(n, np.int16)
    text[np.arange(len(pieces)) + shift] = pieces.astype(np.int16) + 1
    starts = begin + 8 * np.arange(len(size))
    ends = np.zeros(n, np.int64)
    ends[:] = np.repeat(starts + size, size + 8)
    is_window = np.zeros(n, bool)
    where = np.repeat(starts, windows) + np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    is_window[where] = True
    order = suffix_order(text, ends)
    order = order[is_window[order]]
    # common prefixes of neighbours, up to LENGTH
    wide = np.zeros(n, np.uint64)
    for k in range(8):
        wide[: n - k] |= (text[k:] & 0xFF).astype(np.uint64) << np.uint64(56 - 8 * k)
    pair = np.arange(len(order) - 1)
    for d in range(0, LENGTH, 8):
        pair = pair[wide[order[pair] + d] == wide[order[pair + 1] + d]]
    found = np.zeros(n, bool)
    found[order[pair]] = True
    found[order[pair + 1]] = True
    return found[where]


def runs(t: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(t, start, end) of the bytes under windows that begin at the places ``s``."""
    if not len(t):
        return t, s, s
    order = np.lexsort((s, t))
    t, s = t[order], s[order]
    new = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (s[1:] > s[:-1] + LENGTH))))
    last = np.concatenate((new[1:] - 1, [len(t) - 1]))
    return t[new], s[new], s[last] + LENGTH


def _texts(docs: DataFrame) -> DataFrame:
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), data.alias("data")).withColumn("t", F.xxhash64("data"))


def _entries(texts: DataFrame, groups: int) -> DataFrame:
    def run(it):
        seen: set[int] = set()
        held, n = [], 0

        def flush():
            c = [np.concatenate(x) for x in zip(*held)]
            yield from deal(c[0], c, groups)

        for batch in batches(it, 300):
            for t, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(data) < LENGTH or t in seen:
                    continue
                seen.add(t)
                h, r, s, w, off = anchors(data)
                held.append((h, r, np.full(len(h), t, np.int64), s.astype(np.int32), w.astype(np.int16), off.astype(np.int16)))
                n += len(h)
            if n > 1_000_000:
                yield from flush()
                held, n = [], 0
            if len(seen) > 1_000_000:
                seen.clear()
        if held:
            yield from flush()

    return texts.select("t", "data").mapInArrow(run, schema(6))


CANDIDATES = "kind int, key long, t long, s int, w int, off int"
_DTYPES = [np.uint64, np.uint64, np.int64, np.int32, np.int16, np.int16]


def _sift(table_: pa.Table, max_regions: int = MAX_REGIONS) -> pa.Table:
    """Regions that are repeated as a whole (kind 0), and the distinct regions of anchors that have several (1; 2: very many)."""
    h, r, t, s, w, off = (unpack(table_.column(f"c{i}"), d) for i, d in enumerate(_DTYPES))
    order = np.lexsort((s, t, off, w, r, h))
    h, r, t, s, w, off = (x[order] for x in (h, r, t, s, w, off))
    if len(h):
        fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (t[1:] != t[:-1]) | (s[1:] != s[:-1])))
        h, r, t, s, w, off = (x[fresh] for x in (h, r, t, s, w, off))
    if not len(h):
        kind = np.empty(0, np.int32)
    else:
        same = (h[1:] == h[:-1]) & (r[1:] == r[:-1]) & (w[1:] == w[:-1]) & (off[1:] == off[:-1])
        lead = np.concatenate(([True], ~same))
        number = np.cumsum(lead) - 1
        whole = (np.bincount(number) > 1)[number]
        group = np.cumsum(np.concatenate(([True], h[1:] != h[:-1]))) - 1
        distinct = np.bincount(group, lead).astype(np.int64)[group]
        kind = np.full(len(h), -1, np.int32)
        kind[lead & (distinct > 1)] = 1
        kind[lead & (distinct > max_regions)] = 2
        a, b = np.flatnonzero(whole), np.flatnonzero(kind > 0)
        kind = np.concatenate((np.zeros(len(a), np.int32), kind[b]))
        h, t, s, w, off = (np.concatenate((x[a], x[b])) for x in (h, t, s, w, off))
    names = [x.split()[0] for x in CANDIDATES.split(", ")]
    return pa.Table.from_arrays(
        [pa.array(kind), pa.array(h.view(np.int64)), pa.array(t), pa.array(s), pa.array(w.astype(np.int32)), pa.array(off.astype(np.int32))], names
    )


def _regions(rows: DataFrame, groups: int) -> DataFrame:
    """Packed regions with their bytes, dealt by anchor, from rows (t, want, data)."""

    def run(it):
        held, n = [], 0

        def flush():
            key, t, s, w, data = (np.concatenate([x[i] for x in held]) for i in range(5))
            size = w.astype(np.int64) + LENGTH - 1
            g = ((key * np.uint64(_P)) >> np.uint64(40)) % np.uint64(groups)
            order = np.argsort(g, kind="stable")
            at = np.concatenate(([0], np.cumsum(size)))
            cuts = np.flatnonzero(np.concatenate(([True], g[order][1:] != g[order][:-1], [True])))
            for a, b in zip(cuts[:-1], cuts[1:]):
                o = order[a:b]
                joined = b"".join(data[at[i] : at[i + 1]].tobytes() for i in o)
                columns = [pa.array([x[o].tobytes()], pa.binary()) for x in (key, t, s, w)]
                yield pa.RecordBatch.from_arrays([pa.array([int(g[o[0]])], pa.int32()), *columns, pa.array([joined], pa.binary())], ["g", "c0", "c1", "c2", "c3", "c4"])

        for batch in batches(it, 300):
            for t, want, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                key = np.array([x["key"] for x in want], np.int64).view(np.uint64)
                s = np.array([x["s"] for x in want], np.int32)
                w = np.array([x["w"] for x in want], np.int16)
                view = np.frombuffer(data, np.uint8)
                parts = [view[a : a + b + LENGTH - 1] for a, b in zip(s.tolist(), w.tolist())]
                held.append((key, np.full(len(key), t, np.int64), s, w, np.concatenate(parts)))
                n += len(held[-1][4])
            if n > 8_000_000:
                yield from flush()
                held, n = [], 0
        if held:
            yield from flush()

    return rows.select("t", "want", "data").mapInArrow(run, schema(5))


SPANS = "t long, start long, stop long"


def _span_table(t, a, b) -> pa.Table:
    return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in (t, a, b)], ["t", "start", "stop"])


def _sorted_group(table_: pa.Table) -> pa.Table:
    key, t, s, w, data = (unpack(table_.column(f"c{i}"), d) for i, d in enumerate((np.uint64, np.int64, np.int32, np.int16, np.uint8)))
    size = w.astype(np.int64)
    hit = repeated_windows(data, size)
    place = np.repeat(s.astype(np.int64), size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return _span_table(*runs(np.repeat(t, size)[hit], place[hit]))


def _windows(rows: DataFrame, groups: int) -> DataFrame:
    """Hashes of single windows, for regions of anchors with very many; dealt by hash."""

    def run(it):
        for batch in batches(it, 50):
            hs, ts, ss = [], [], []
            for t, want, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                n = len(data)
                up, down = _grow(n + 1)
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[np.frombuffer(data, np.uint8)] * up[:n])))
                s = np.unique(np.concatenate([np.arange(x["s"], x["s"] + x["w"]) for x in want]))
                hs.append(mix64((total[s + LENGTH] - total[s]) * down[s]))
                ts.append(np.full(len(s), t, np.int64))
                ss.append(s.astype(np.int64))
            if hs:
                h = np.concatenate(hs)
                yield from deal(h, [h, np.concatenate(ts), np.concatenate(ss)], groups)

    return rows.select("t", "want", "data").mapInArrow(run, schema(3))


def _counted_group(table_: pa.Table) -> pa.Table:
    h, t, s = (unpack(table_.column(f"c{i}"), d) for i, d in enumerate((np.uint64, np.int64, np.int64)))
    _, where, n = np.unique(h, return_inverse=True, return_counts=True)
    hit = n[where] > 1
    return _span_table(*runs(t[hit], s[hit]))


def repeated_spans(docs: DataFrame, max_regions: int = MAX_REGIONS) -> tuple[DataFrame, DataFrame]:
    """((t, start, stop) of repeated bytes in distinct texts, (t, doc_id, n) of the texts)."""
    texts = _texts(docs)
    total = text_bytes(docs)
    reps = texts.groupBy("t").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id")).alias("r"), F.count(F.lit(1)).alias("n"), F.first(F.octet_length("data")).alias("size")
    )
    reps = materialize(reps.select("t", "r.doc_id", "n", "size"), "suffix-texts")
    groups = max(16, int(total * 0.5 / GROUP_BYTES) + 1)
    sifted = _entries(texts, groups).groupBy("g").applyInArrow(lambda x: _sift(x, max_regions), CANDIDATES)
    found = materialize(sifted, "suffix-candidates")
    whole = found.where("kind = 0").select("t", F.col("s").cast("long").alias("start"), (F.col("s") + F.col("w") - 1 + LENGTH).cast("long").alias("stop"))
    copies = reps.where((F.col("n") > 1) & (F.col("size") >= LENGTH)).select("t", F.lit(0).cast("long").alias("start"), F.col("size").cast("long").alias("stop"))

    def with_text(kind: int) -> DataFrame:
        want = found.where(F.col("kind") == kind).groupBy("t").agg(F.collect_list(F.struct("key", "s", "w")).alias("want"))  # of one text
        keys = materialize(want.select("t").join(reps.select("t", "doc_id"), "t"), "suffix-wanted")
        same = (F.col("k.t") == F.col("d.t")) & F.col("k.doc_id").eqNullSafe(F.col("d.doc_id"))
        own = texts.alias("d").join(bounded(keys).alias("k"), same).select("d.t", "d.data")
        return own.join(want, "t").select("t", "want", "data")

    size = found.where("kind = 1").agg(F.coalesce(F.sum(F.col("w") + (LENGTH - 1)), F.lit(0))).first()[0]
    one = _regions(with_text(1), max(16, int(size / REGION_BYTES) + 1)).groupBy("g").applyInArrow(_sorted_group, SPANS)
    size = found.where("kind = 2").agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    two = _windows(with_text(2), max(16, int(size * 24 / GROUP_BYTES) + 1)).groupBy("g").applyInArrow(_counted_group, SPANS)
    return materialize(whole.unionByName(copies).unionByName(one).unionByName(two), "suffix-spans"), reps


def _merge(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, max_regions: int = MAX_REGIONS) -> DataFrame:
    """(doc_id, data, n_bytes, n_removed, n_spans): the bytes that stay of each document, and what was removed."""
    spans, _ = repeated_spans(docs, max_regions)
    per = spans.groupBy("t").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))  # of one text
    texts = _texts(docs)
    hit = materialize(per.select("t"), "suffix-hit")
    few = bounded(hit.withColumn("hit", F.lit(True)))
    clean = texts.join(few, "t", "left").where(F.col("hit").isNull())
    zero = F.lit(0).cast("long")
    clean = clean.select("doc_id", "data", F.octet_length("data").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"))
    rows = texts.join(few, "t").select("doc_id", "t", "data").join(per, "t").select("doc_id", "data", "spans")

    def run(it):
        for batch in batches(it, 300):
            left, n, removed, count = [], [], [], []
            for data, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                merged = _merge([(x["start"], x["stop"]) for x in found])
                at, keep = 0, []
                for a, b in merged:
                    keep.append(data[at:a])
                    at = b
                keep.append(data[at:])
                left.append(b"".join(keep))
                n.append(len(data))
                removed.append(sum(b - a for a, b in merged))
                count.append(len(merged))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(left, pa.binary()), *(pa.array(x, pa.int64()) for x in (n, removed, count))], ["doc_id", "data", "n_bytes", "n_removed", "n_spans"]
            )

    return clean.unionByName(rows.mapInArrow(run, "doc_id long, data binary, n_bytes long, n_removed long, n_spans long"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("data", 256).alias("kept_sha256"))
