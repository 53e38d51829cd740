"""Exact Jaccard join of word-shingle sets by universe-partition pigeonhole.

Token hashes are dealt into segments by ranges of the hash.  The number of segments follows from the
size band (octaves of the set size): two sets with a similarity of at least 4/5 differ in at most
``smaller size // 4`` tokens, so of more segments than that at least one is equal.  Bands of small sets
get few, larger segments with one-deletion neighbourhoods (a segment that differs in one token is found,
too, so a segment counts twice); bands of large sets get more segments than needed and equal subsets
only: that is what costs least there, as neighbourhoods take a row per token.  A set also enters the
next smaller band where its size lets it reach into it.

Costs decide which subsets are used: one that no other set has is free and generates nothing; a set
with too many of those can't have a partner and leaves.  An empty segment is what most sets share, so
it is only searched by the few sets that can't spare it.

Candidates: first every set against the one it shares most subsets with; components of the verified
links; then all pairs that share a subset across components (links within a component change nothing),
unless bitmaps of token parities show that they differ too much; of these, first only those that would join
components, nearest first.  All are verified exactly on the texts.

Null or empty text: no set, linked with nothing, component of its own (null doc_id: null).  Equal sets
are one class and always one component; repeated rows get equal results; an empty table an empty one.
Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlattice.functions.storage import materialize
from runlattice.llm.common import batches, bounded, free, table
from runlattice.llm.packed import deal, mix64, per_group, schema, text_bytes, trim, trimmed
from runlattice.llm.shingles import shingle_sets
from runlattice.operators.graph import components

#: Up to this band (sizes below 2**band) segments have one-deletion neighbourhoods.
NEIGHBOUR_BAND = 5
GROUP_BYTES, ACROSS_ENTRIES, COUNTED = 4_000_000, 300_000, 1_000_000
#: Keys of at least so many sets remember which pairs were compared, while they hold at most so many sets in all.
BIG_RUN, MEMO_CLASSES = 64, 8_000
DELETED, EMPTY, PROBE, LOW = 1, 2, 4, 8


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 80 * union, of sorted distinct arrays."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 80 * (len(a) + len(b) - both)


def segments(band: int) -> int:
    most = ((1 << band) - 1) // 4
    return (most + 2) // 2 + 1 if band <= NEIGHBOUR_BAND else most + 1 + (most + 4) // 4


def bands(n: int) -> list[int]:
    """Bands that a set of n tokens enters: its own, and the next smaller one if it reaches into it."""
    own = n.bit_length()
    out = [own] if n >= 4 else []
    if own > 3 and 4 * n <= 5 * ((1 << own - 1) - 1):
        out.append(own - 1)
    return out


_BOUNDS: dict[int, np.ndarray] = {}
_STEP = np.uint64(0x2545F4914F6CDD1D)


def _cuts(h: np.ndarray, m: int) -> np.ndarray:
    if m not in _BOUNDS:
        _BOUNDS[m] = np.array([(i << 64) // m for i in range(1, m)], np.uint64)
    return np.concatenate(([0], np.searchsorted(h, _BOUNDS[m]), [len(h)]))


def differ(n: int, band: int) -> int:
    """Most tokens by which a set of n tokens differs from a partner in a band."""
    return min(n, (1 << band) - 1) // 4


def units(h: np.ndarray, band: int) -> int:
    return int(np.count_nonzero(np.diff(_cuts(h, segments(band)))))


def subsets(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, flags) of a sorted set: its segment subsets and, in small bands, their one-deletion neighbourhoods."""
    keys, flags = [], []
    own = len(h).bit_length()
    mixed = mix64(h ^ _STEP)
    upto = np.concatenate(([np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)))
    for band in bands(len(h)):
        m = segments(band)
        cuts = _cuts(h, m)
        size = np.diff(cuts)
        total = np.diff(upto[cuts])
        salt = mix64(np.arange(m, dtype=np.uint64) + np.uint64(band << 40))
        low = LOW if band < own else 0
        twice = 2 if band <= NEIGHBOUR_BAND else 1
        lacks = twice * np.count_nonzero(size) < differ(len(h), band) + 1
        keys.append(mix64(total * _STEP + salt))
        flags.append(np.where(size > 0, low, low | EMPTY | (PROBE if lacks else 0)).astype(np.uint8))
        if twice == 2:
            where = np.repeat(np.arange(m), size)
            keys.append(mix64((total[where] - mixed) * _STEP + salt[where]))
            alone = size[where] == 1
            flags.append(np.where(alone, low | DELETED | EMPTY, low | DELETED).astype(np.uint8))
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.uint8)
    return np.concatenate(keys), np.concatenate(flags)


def class_of(h: np.ndarray) -> int:
    """A 63-bit number of a set."""
    x = int(np.bitwise_xor.reduce(mix64(h))) + int(np.add.reduce(mix64(h ^ _STEP))) * int(_STEP) + len(h)
    return int(mix64(np.array([x & (1 << 64) - 1], np.uint64))[0] >> np.uint64(1))


def bitmap(h: np.ndarray) -> bytes:
    """Parities of a set's tokens in 4 * 2**band places, 64 at least: two sets differ in at least as many tokens as their bitmaps in bits."""
    width = max(64, 4 << len(h).bit_length())
    odd = np.bincount((mix64(h ^ _STEP) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: bytes, words: int) -> np.ndarray:
    """A bitmap at a smaller width: parities of its halves."""
    x = np.frombuffer(bits, np.uint64)
    while len(x) > words:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


SETS = "doc_id long, t long, n_shingles long, cls long, own int, low int, bits binary"


def sets(docs: DataFrame) -> DataFrame:
    """A row for each document: size and class of its set, and its segments with tokens, by band."""

    def run(it):
        for batch in batches(it):
            rows = []
            for h in shingle_sets(batch.column(2).to_pylist()):
                b = bands(len(h))
                u = [units(h, x) for x in b] + [0, 0]
                rows.append((len(h), class_of(h) if len(h) else None, u[0], u[1], bitmap(h) if len(h) >= 4 else b""))
            n, cls, own, low, bits = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(own, pa.int32()), pa.array(low, pa.int32()), pa.array(bits, pa.binary())],
                [x.split()[0] for x in SETS.split(", ")],
            )

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("t"), "text").mapInArrow(lambda it: trimmed(run(it)), SETS)


def _subset_entries(docs: DataFrame, groups: int) -> DataFrame:
    def run(it):
        seen: set[int] = set()  # equal sets of one task are one
        keys, classes, flags, n = [], [], [], 0

        def flush():
            if keys:
                k, c, f = np.concatenate(keys), np.concatenate(classes), np.concatenate(flags)
                yield from deal(k, [k.astype(np.uint32), (k >> np.uint64(32)).astype(np.uint16), c, f], groups)

        for batch in batches(it):
            for h in shingle_sets(batch.column(0).to_pylist()):
                if len(h) < 4:
                    continue
                cls = class_of(h)
                if cls in seen:
                    continue
                seen.add(cls)
                k, f = subsets(h)
                keys.append(k)
                flags.append(f)
                classes.append(np.full(len(k), cls, np.int64))
                n += len(k)
            if n > 1_000_000:
                yield from flush()
                keys, classes, flags, n = [], [], [], 0
        yield from flush()

    return docs.select("text").mapInArrow(lambda it: trimmed(run(it)), schema(4))


def _runs(key: np.ndarray) -> np.ndarray:
    """Where runs of a sorted array begin, and its end."""
    return np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))) if len(key) else np.zeros(1, np.int64)


def _shared(lo, hi, cls, flag):
    """Entries of keys that at least two classes have, as one row."""
    key = lo.astype(np.uint64) | hi.astype(np.uint64) << np.uint64(32)
    order = np.lexsort((flag, cls, key))
    key, cls, flag = key[order], cls[order], flag[order]
    # an equal set of another task; a class has a key as a subset before as a neighbour
    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1]))) if len(key) else np.zeros(0, bool)
    key, cls, flag = key[fresh], cls[fresh], flag[fresh]
    at = _runs(key)
    n = np.diff(at)
    if not len(n):
        return [[], [], [], []]
    plain = np.add.reduceat((flag & DELETED) == 0, at[:-1]) > 0
    probed = np.add.reduceat(((flag & EMPTY) == 0) | ((flag & PROBE) > 0), at[:-1]) > 0
    keep = np.repeat((n > 1) & plain & probed, n)
    if not keep.any():
        return [[], [], [], []]
    return [[0], [key[keep].tobytes()], [cls[keep].tobytes()], [flag[keep].tobytes()]]


SHARED = "g int, key binary, cls binary, flag binary"


def _arrays(batch):
    for key, cls, flag in zip(batch.column("key"), batch.column("cls"), batch.column("flag")):
        yield np.frombuffer(key.as_py(), np.uint64), np.frombuffer(cls.as_py(), np.int64), np.frombuffer(flag.as_py(), np.uint8)


def _counts(shared: DataFrame) -> DataFrame:
    """(cls, own, low, other): subsets of a class that others have, by band; other: by neighbourhoods or empty segments."""

    def counted(held):
        cls, flag = (np.concatenate(x) for x in zip(*held))
        u, where = np.unique(cls, return_inverse=True)
        full = (flag & (EMPTY | DELETED)) == 0
        own = np.bincount(where, full & ((flag & LOW) == 0), len(u)).astype(np.int64)
        low = np.bincount(where, full & ((flag & LOW) > 0), len(u)).astype(np.int64)
        other = np.bincount(where, ~full, len(u)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (u, own, low, other)], ["cls", "own", "low", "other"])

    def run(it):
        held, n = [], 0  # a class goes out once for the groups that a task holds together
        for batch in it:
            for _, cls, flag in _arrays(batch):
                held.append((cls, flag))
                n += len(cls)
                if n > COUNTED:
                    yield counted(held)
                    held, n = [], 0
        if held:
            yield counted(held)

    rows = shared.mapInArrow(lambda it: trimmed(run(it)), "cls long, own long, low long, other long")
    return rows.groupBy("cls").agg(*[F.sum(c).alias(c) for c in ("own", "low", "other")])


def _live(counts: DataFrame, classes: DataFrame) -> DataFrame:
    """Classes that may have a partner: at most as many subsets are theirs alone as a partner may differ in."""
    c = counts.select("cls", *[F.col(x).alias(f"_{x}") for x in ("own", "low", "other")]).join(classes, "cls")
    band = F.length(F.bin("n_shingles"))
    half = F.pow(F.lit(2.0), band - 1).cast("long") - 1
    own = (band <= NEIGHBOUR_BAND) | (F.col("_own") >= F.col("own") - F.floor(F.col("n_shingles") / 4))
    low = (F.col("low") > 0) & ((band - 1 <= NEIGHBOUR_BAND) | (F.col("_low") >= F.col("low") - F.floor(half / 4)))
    return c.where(own | low | (F.col("_other") > 0)).select("cls", "n_shingles")


def _hubs(shared: DataFrame) -> DataFrame:
    """(a, b, n): subsets that class b shares with class a, the smallest that has the subset."""

    def run(it):
        for batch in it:
            for key, cls, flag in _arrays(batch):
                full = (flag & (EMPTY | DELETED)) == 0
                key, cls = key[full], cls[full]
                at = _runs(key)
                n = np.diff(at)
                if not len(n):
                    continue
                hub = np.repeat(np.minimum.reduceat(cls, at[:-1]), n)
                pair = np.stack((hub, cls), 1)[hub != cls]
                if len(pair):
                    u, c = np.unique(pair, axis=0, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(u[:, 0]), pa.array(u[:, 1]), pa.array(c)], ["a", "b", "n"])

    rows = shared.mapInArrow(lambda it: trimmed(run(it)), "a long, b long, n long")
    return rows.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _entries(shared: DataFrame, groups: int) -> DataFrame:
    def run(it):
        for batch in it:
            for key, cls, flag in _arrays(batch):
                g = (mix64(key) % np.uint64(groups)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g), pa.array(key.view(np.int64)), pa.array(cls), pa.array(flag.astype(np.int32))], ["g", "key", "cls", "flag"]
                )

    return shared.mapInArrow(lambda it: trimmed(run(it)), "g int, key long, cls long, flag int")


def _pairs_of(at: np.ndarray, size: int, most: int = 200_000):
    """Places (i, j), i before j, of all pairs within runs of one size that begin at ``at``; some at a time."""
    if size * size > 2 * most:  # row by row
        rows = max(1, most // size)
        for start in at:
            for a in range(0, size - 1, rows):
                i, j = np.nonzero(np.arange(a, min(a + rows, size))[:, None] < np.arange(size))
                yield start + a + i, start + j
        return
    i, j = np.triu_indices(size, 1)
    many = max(1, most // len(i))
    for a in range(0, len(at), many):
        start = at[a : a + many, None]
        x, y = (start + i).ravel(), (start + j).ravel()
        for b in range(0, len(x), most):
            yield x[b : b + most], y[b : b + most]


def forest(pairs: np.ndarray, comp_of: dict[int, int]) -> np.ndarray:
    """Of pairs (a, b, apart), nearest first, those that join components which no pair before has joined."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    keep = []
    for k in np.argsort(pairs[:, 2], kind="stable").tolist():
        a, b = root(comp_of[int(pairs[k, 0])]), root(comp_of[int(pairs[k, 1])])
        if a != b:
            up[max(a, b)] = min(a, b)
            keep.append(k)
    return pairs[np.array(keep, np.int64)]


def near_pairs(key, cls, comp, flag, n, bits, tree: bool = False) -> np.ndarray:
    """(a, b) of classes of different components that share a key and whose bitmaps allow that they are linked.

    ``n`` and ``bits``: size and bitmap of each entry's class.  Bitmaps bound the difference from below, so none is lost.
    ``tree``: only the nearest pairs that would join all of them.
    """
    level = np.array([int(x).bit_length() for x in n], np.int64) - ((flag & LOW) > 0)
    order = np.lexsort((cls, key, level))
    key, cls, comp, flag, n, level = key[order], cls[order], comp[order], flag[order], n[order], level[order]
    bits = [bits[i] for i in order]
    comp_of = dict(zip(cls.tolist(), comp.tolist())) if tree else {}
    at = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (level[1:] != level[:-1]), [True]))) if len(key) else np.zeros(1, np.int64)
    if len(at) < 2:
        return np.empty((0, 2), np.int64)
    straddles = np.minimum.reduceat(comp, at[:-1]) != np.maximum.reduceat(comp, at[:-1])
    begin, size = at[:-1][straddles], np.diff(at)[straddles]
    out = []
    for lv in np.unique(level[begin]):
        words = max(1, (4 << int(lv)) // 64)
        here = level[begin] == lv
        used = np.repeat(begin[here], size[here]) + np.arange(int(size[here].sum())) - np.repeat(np.cumsum(size[here]) - size[here], size[here])
        u, first = np.unique(cls[used], return_index=True)
        rows = np.stack([folded(bits[used[i]], words) for i in first])
        place = np.zeros(len(cls), np.int64)
        place[used] = np.searchsorted(u, cls[used])
        def check(i, j):
            """Keep the near ones of these pairs; tells which pairs the key may count for at all."""
            small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            counts = ((flag[i] & flag[j] & DELETED) == 0) & (((flag[i] & EMPTY) == 0) | (((flag[i] | flag[j]) & PROBE) > 0))
            ok = counts & (comp[i] != comp[j]) & (4 * large <= 5 * small)
            i, j, small = i[ok], j[ok], small[ok]
            for c in range(0, len(i), max(1, 1_000_000 // words)):
                x, y = i[c : c + 1_000_000 // words], j[c : c + 1_000_000 // words]
                apart = np.bitwise_count(rows[place[x]] ^ rows[place[y]]).sum(1, dtype=np.int64)
                near = apart <= small[c : c + len(x)] // 4
                if near.any():
                    out.append(np.stack((cls[x[near]], cls[y[near]], apart[near]), 1))
            return counts

        large_runs = begin[here & (size >= BIG_RUN)], size[here & (size >= BIG_RUN)]
        held = np.unique(np.concatenate([place[a : a + b] for a, b in zip(*large_runs)])) if len(large_runs[0]) else np.empty(0, np.int64)
        once = len(held) <= MEMO_CLASSES
        done = np.zeros((len(held), len(held)), bool) if once else None
        for k in np.unique(size[here]):
            starts = begin[here & (size == k)]
            if k < BIG_RUN or not once:
                for i, j in _pairs_of(starts, int(k)):
                    check(i, j)
                continue
            for a in starts:  # sets that share many subsets are compared once
                ids = np.searchsorted(held, place[a : a + k])
                for p, q in _pairs_of(np.zeros(1, np.int64), int(k)):
                    left = ~done[ids[p], ids[q]]
                    p, q = p[left], q[left]
                    counts = check(a + p, a + q)
                    done[ids[p[counts]], ids[q[counts]]] = True
        if tree and out:
            out = [forest(np.concatenate(out), comp_of)]
    return np.unique(np.concatenate(out)[:, :2], axis=0) if out else np.empty((0, 2), np.int64)


def _across(entries: DataFrame, labels: DataFrame, tree: bool) -> DataFrame:
    """(a, b): pairs of live classes of different components to verify; ``labels``: (cls, comp, n_shingles, bits)."""
    own = entries.select("g", "cls").distinct().join(labels, "cls")
    own = own.select(F.col("g").alias("g2"), F.col("cls").alias("known"), "comp", "n_shingles", "bits")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known = right.column("known").to_numpy()
        by = np.argsort(known)
        cls = left.column("cls").to_numpy()
        pairs = np.empty((0, 2), np.int64)
        if len(known):
            where = by[np.minimum(np.searchsorted(known[by], cls), len(by) - 1)]
            live = known[where] == cls
            where = where[live]
            bits = right.column("bits").to_pylist()
            pairs = near_pairs(
                left.column("key").to_numpy()[live], cls[live], right.column("comp").to_numpy()[where], left.column("flag").to_numpy()[live],
                right.column("n_shingles").to_numpy()[where], [bits[i] for i in where], tree,
            )
            del bits
        trim()
        return pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return entries.groupBy("g").cogroup(own.groupBy("g2")).applyInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets are linked, as edges (u, v); ``reps``: (cls, doc_id, t)."""
    pairs = materialize(pairs, "jaccard-pairs")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")

    def fetch(wanted: DataFrame) -> DataFrame:
        wanted = materialize(wanted.select("*"), "jaccard-wanted")
        same = (F.col("w.t") == F.col("d.t")) & F.col("w.doc_id").eqNullSafe(F.col("d.doc_id"))
        return texts.alias("d").join(bounded(wanted).alias("w"), same).select("w.*", F.col("d.text").alias("text"))

    mine = reps.withColumnRenamed("cls", "b")
    right = fetch(pairs.join(mine, "b")).select("a", "b", F.col("text").alias("text_b"))
    left = fetch(pairs.select("a").distinct().join(reps.withColumnRenamed("cls", "a"), "a")).select("a", F.col("text").alias("text_a"))

    def run(it):
        last, of = None, None
        for batch in batches(it, 500):
            us, vs = [], []
            a_s, b_s, xs, ys = (batch.column(i).to_pylist() for i in range(4))
            lead = [k == 0 or a != a_s[k - 1] for k, a in enumerate(a_s)]
            leads = shingle_sets([x for x, new in zip(xs, lead) if new])
            for a, b, new, other in zip(a_s, b_s, lead, shingle_sets(ys)):
                if new:
                    own = next(leads)
                    if a != last:
                        last, of = a, own
                if linked(of, other):
                    us.append(a)
                    vs.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return right.join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(lambda it: trimmed(run(it)), "u long, v long").distinct()


def classified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, t, n_shingles, cls) of every document, (cls, doc_id, t, comp) of every class).

    t is xxhash64 of the text, cls null for documents without a set; doc_id and t of a class are of its first document.
    """
    docs = docs.select("doc_id", "text")
    groups = max(16, int(text_bytes(docs) * 0.7 / GROUP_BYTES) + 1)
    every = materialize(sets(docs), "jaccard-sets")
    full = every.where(F.col("cls").isNotNull())
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "t"))
    classes = full.groupBy("cls").agg(
        F.first("n_shingles").alias("n_shingles"), F.first("own").alias("own"), F.first("low").alias("low"), F.first("bits").alias("bits"), first.alias("_r")
    )
    classes = materialize(classes.select("cls", "n_shingles", "own", "low", "bits", "_r.doc_id", "_r.t"), "jaccard-classes")
    reps = classes.select("cls", "doc_id", "t")

    dealt = _subset_entries(docs, groups)
    shared = per_group(dealt, [np.uint32, np.uint16, np.int64, np.uint8], _shared, SHARED)
    shared = materialize(shared, "jaccard-shared")
    live = materialize(_live(_counts(shared), classes.drop("bits")), "jaccard-live")

    # every live class against the one that it shares most with
    hubs = _hubs(shared).join(live.select(F.col("cls").alias("b")), "b").join(live.select(F.col("cls").alias("a")), "a")
    best = hubs.groupBy("b").agg(F.max(F.struct("n", "a")).alias("_m")).select(F.col("_m.a").alias("a"), "b")
    links = materialize(verified(best, reps, docs), "jaccard-links")
    comps = components(links, "jaccard-components")

    # then what shares a subset across components and may be near enough: first the nearest pairs that would join
    # them, so that large groups grow together, then all pairs of the components that are left
    total = shared.agg(F.coalesce(F.sum(F.octet_length("flag")), F.lit(0))).first()[0]
    groups = max(6, int(total / ACROSS_ENTRIES) + 1)
    for tree in (True, False):
        label = live.select("cls").join(comps.withColumnRenamed("id", "cls"), "cls", "left").join(classes.select("cls", "n_shingles", "bits"), "cls")
        label = materialize(label.select("cls", F.coalesce("component", "cls").alias("comp"), "n_shingles", "bits"), "jaccard-labels")
        more = verified(_across(_entries(shared, groups), label, tree), reps, docs)
        links = materialize(links.unionByName(more), "jaccard-links")
        comps = components(links, "jaccard-components")

    named = classes.join(comps.withColumnRenamed("id", "cls"), "cls", "left")
    named = named.select("cls", "doc_id", "t", F.coalesce("component", "cls").alias("comp"))
    return every.select("doc_id", "t", "n_shingles", "cls"), materialize(named, "jaccard-all")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    every, named = classified(docs)
    ids = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    by_class = named.join(ids, "comp").select("cls", "component_id")
    out = every.where(F.col("cls").isNotNull()).join(by_class, "cls").select("doc_id", "n_shingles", "component_id")
    alone = every.where(F.col("cls").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, its first by doc_id (null last); documents without a set stay.

    Rows with equal doc_id and text are one document: one of them stays.
    """
    every, named = classified(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "t"))
    keys = named.groupBy("comp").agg(first.alias("k")).select("k.doc_id", "k.t")
    alone = every.where(F.col("cls").isNull()).select("doc_id", "t").distinct()
    keys = materialize(keys.unionByName(alone), "jaccard-keep")
    (t,) = free(docs, "t")
    same = (F.col(f"d.{t}") == F.col("k.t")) & F.col("d.doc_id").cast("long").eqNullSafe(F.col("k.doc_id"))
    kept = docs.withColumn(t, F.xxhash64("text")).alias("d").join(bounded(keys).alias("k"), same).select("d.*")
    repeated = every.groupBy("t", "doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    return (kept.dropDuplicates([t, "doc_id"]) if repeated else kept).drop(t)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
