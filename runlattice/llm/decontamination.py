"""Benchmark decontamination: BM25 over test items, block-max WAND for every training passage.

The test items are indexed (postings in blocks with their largest impact).  Impacts are divided by
the item's score for itself, so one threshold serves all items.  Every training document is cut into
overlapping passages, twice the longest item; each passage is a query.  A passage is first held against
sums of upper bounds of the items' essential terms, over whole batches at once: where they stay below
the threshold no item can be reached.  The other passages run block-max WAND and all items above the
threshold are retrieved.  A retrieved pair counts when the passage covers the item's question (all
sentences but the last) and its answer (the last one) by shared word sequences.

The index is broadcast in shards of at most ``SHARD_BYTES`` of item text; a larger benchmark takes more
passes over the corpus, no item is left out.  Document frequencies and the mean length are those of all items,
whatever the shards, so scores don't depend on them.

Null or empty texts and items match nothing; a text may be of any length; items of equal score are all retrieved.  An item id or document that repeats gives a row per
distinct pair.  Empty tables give empty results; only doc_id/text and item_id/text are read, so other
columns can't clash.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlattice.llm.common import batches, lower_words, table

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach; shares of question and answer it must cover.
MIN_SCORE, MIN_QUESTION, MIN_ANSWER = 0.6, 0.8, 0.8
SHARD_BYTES = 16_000_000
BLOCK = 16
STRIP = b".,;:!?\"'()[]*#%&$|"
CACHE = 400_000
#: Essential terms hold at least this share of an item's score (more than 1 - MIN_SCORE).
ESSENTIAL = 0.65


def terms(text: str | None) -> list[bytes]:
    return [w for w in (x.strip(STRIP) for x in lower_words(text)) if w]


def parts(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words of the question and of the answer: the last sentence, or the last third where there is but one."""
    ends = [i + 1 for i in range(len(text) - 1) if text[i] in ".?!" and text[i + 1].isspace()]
    ends = [e for e in ends if terms(text[:e]) and terms(text[e:])]
    if ends:
        return terms(text[: ends[-1]]), terms(text[ends[-1] :])
    ws = terms(text)
    cut = len(ws) - max(1, len(ws) // 3)
    return ws[:cut], ws[cut:]


def _gram(n: int) -> int:
    return 5 if n >= 15 else min(3, n)


def coverage(part: list[bytes], seen: dict[int, set]) -> float:
    """Share of the words of a part that lie in word sequences of the passage; ``seen``: its sequences by length."""
    if not part:
        return 1.0
    n = _gram(len(part))
    grams, covered, upto = seen[n], 0, 0
    for i in range(len(part) - n + 1):
        if tuple(part[i : i + n]) in grams:
            covered += i + n - max(i, upto)
            upto = i + n
    return covered / len(part)


class Statistics:
    """Number, summed length and document frequencies of items."""

    def __init__(self):
        self.n, self.words, self.df = 0, 0, Counter()

    def add(self, items: list[tuple[int, str]]) -> Statistics:
        for _, text in items:
            if ws := terms(text):
                self.n += 1
                self.words += len(ws)
                self.df.update(set(ws))
        return self


class Index:
    """BM25 impacts of the items of one shard, normalised, as postings with block maxima.

    ``every``: statistics of all items; those of the shard if there is but one.
    """

    def __init__(self, items: list[tuple[int, str]], every: Statistics | None = None):
        self.items = sorted((i, t) for i, t in items if terms(t))
        words = [terms(t) for _, t in self.items]
        self.parts = [parts(t) for _, t in self.items]
        self.longest = max(map(len, words), default=0)
        every = every or Statistics().add(self.items)
        n, mean, df = every.n, every.words / max(1, every.n), every.df
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for ws in words for w in ws}))}
        postings: list[list[tuple[int, float]]] = [[] for _ in self.vocabulary]
        essential: list[tuple[int, int, float]] = []
        self.need = np.zeros(len(words))
        for item, ws in enumerate(words):
            raw = {}
            for w, tf in Counter(ws).items():
                idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                raw[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ws) / mean))
            own = sum(raw.values())
            order = sorted(raw, key=lambda w: (df[w], -raw[w], w))
            held = 0.0
            for w in order:
                postings[self.vocabulary[w]].append((item, raw[w] / own))
                if held < ESSENTIAL:
                    held += raw[w] / own
                    essential.append((self.vocabulary[w], item, raw[w] / own))
            self.need[item] = MIN_SCORE - (1.0 - held)
        self.docs = [[p[0] for p in ps] for ps in postings]
        self.impacts = [[p[1] for p in ps] for ps in postings]
        self.largest = [max(x) for x in self.impacts]
        self.block_ends = [[ds[min(k + BLOCK, len(ds)) - 1] for k in range(0, len(ds), BLOCK)] for ds in self.docs]
        self.block_max = [[max(x[k : k + BLOCK]) for k in range(0, len(x), BLOCK)] for x in self.impacts]
        # essential postings by term, as one array with offsets
        essential.sort()
        t = np.array([e[0] for e in essential], np.int64)
        self.ess_item = np.array([e[1] for e in essential], np.int64)
        self.ess_weight = np.array([e[2] for e in essential])
        self.ess_at = np.searchsorted(t, np.arange(len(self.vocabulary) + 1))

    def wand(self, query: list[int], least: float = MIN_SCORE) -> list[tuple[int, float]]:
        """(item, score) of all items that reach ``least`` for the distinct terms of a query."""
        eps = least - 1e-9
        cursors = [[self.docs[t][0], 0, t] for t in query if self.docs[t]]
        out = []
        end = len(self.items)
        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += self.largest[c[2]]
                if total >= eps:
                    pivot = k
                    break
            if pivot < 0:
                break
            doc = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == doc:
                pivot += 1
            # maxima of the blocks that would hold the pivot
            bound, upto = 0.0, end
            for c in cursors[: pivot + 1]:
                b = bisect_left(self.block_ends[c[2]], doc)
                if b < len(self.block_max[c[2]]):
                    bound += self.block_max[c[2]][b]
                    upto = min(upto, self.block_ends[c[2]][b] + 1)
            if bound < eps:
                goal = max(doc + 1, min(upto, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end))
                cursors = self._advance(cursors, pivot, goal)
            elif cursors[0][0] == doc:
                score = sum(self.impacts[c[2]][c[1]] for c in cursors[: pivot + 1])
                if score >= eps:
                    out.append((doc, score))
                cursors = self._advance(cursors, pivot, doc + 1)
            else:
                cursors = self._advance(cursors, pivot, doc)
        return out

    def _advance(self, cursors: list, pivot: int, goal: int) -> list:
        rest = []
        for k, c in enumerate(cursors):
            if k <= pivot and c[0] < goal:
                ds = self.docs[c[2]]
                at = bisect_left(ds, goal, c[1])
                if at == len(ds):
                    continue
                c[0], c[1] = ds[at], at
            rest.append(c)
        return rest


class _Numbers(dict):
    """Numbers of the words met so far, as they stand in the text."""

    def __init__(self, vocabulary: dict[bytes, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> int:
        bare = word.strip(STRIP)
        self[word] = k = self.vocabulary.get(bare, -1) if bare else -2
        return k


class Matcher:
    """Pairs (document, item) of a batch of texts."""

    def __init__(self, index: Index):
        self.index = index
        self.stride = max(1, index.longest)
        self.cache = _Numbers(index.vocabulary)

    def _ids(self, ws: list[bytes]) -> list[int]:
        """Term numbers; -1 for words that no item has, -2 for what is no word."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        return list(map(self.cache.__getitem__, ws))

    def candidates(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Numbers of blocks (of ``stride`` words) where a passage begins whose upper bound reaches an item.

        ``starts``: the first block of every document in a numbering in which documents don't touch.
        """
        ix = self.index
        place = np.flatnonzero(ids >= 0)
        t = ids[place]
        n = ix.ess_at[t + 1] - ix.ess_at[t]
        place, t, n = place[n > 0], t[n > 0], n[n > 0]
        if not len(t):
            return np.empty(0, np.int64)
        at = np.repeat(ix.ess_at[t] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        block = np.repeat(starts[place], n)
        # a term counts once in a block
        cell = np.unique(block * len(ix.ess_item) + at)
        block, at = np.divmod(cell, len(ix.ess_item))
        key, where = np.unique(block * len(ix.items) + ix.ess_item[at], return_inverse=True)
        total = np.bincount(where, ix.ess_weight[at])
        block, item = np.divmod(key, len(ix.items))
        # a passage is a block and the next one
        nxt = np.searchsorted(key, key + len(ix.items))
        follows = (nxt < len(key)) & (key[np.minimum(nxt, len(key) - 1)] == key + len(ix.items))
        both = total + np.where(follows, total[np.minimum(nxt, len(key) - 1)], 0.0)
        hit = both >= ix.need[item] - 1e-9
        # the passage that begins one block earlier has this block, too, whatever else it holds
        alone = block[total >= ix.need[item] - 1e-9] - 1
        return np.unique(np.concatenate((block[hit], alone[alone >= 0])))

    def match(self, texts: list[str | None]) -> list[tuple[int, int, float, float, float, int]]:
        """(text number, item number, score, question share, answer share, passages)."""
        docs, flat, starts, owner, number = [], [], [], {}, 0
        for k, text in enumerate(texts):
            ids = self._ids(lower_words(text)) if text else []
            docs.append(ids)
            if ids:
                flat.append(np.array(ids, np.int64))
                blocks = number + np.arange(len(ids)) // self.stride
                starts.append(blocks)
                owner[number] = k
                number = int(blocks[-1]) + 2  # a gap: passages end with their document
        if not flat or not self.index.items:
            return []
        found = self.candidates(np.concatenate(flat), np.concatenate(starts))
        firsts = np.array(sorted(owner))
        best: dict[tuple[int, int], list] = {}
        split, whole = -1, []
        for block in found.tolist():
            first = int(firsts[np.searchsorted(firsts, block, "right") - 1])
            k = owner[first]
            a = (block - first) * self.stride
            query = sorted({i for i in docs[k][a : a + 2 * self.stride] if i >= 0})
            hits = self.index.wand(query)
            if not hits:
                continue
            # what an edge cuts off may lie a block before or after
            if split != k:
                split, whole = k, lower_words(texts[k])
            ws = whole[max(0, a - self.stride) : a + 3 * self.stride]
            passage = [w for w in (x.strip(STRIP) for x in ws) if w]
            seen = {n: {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)} for n in range(1, 6) if n in (1, 2, 3, 5)}
            for item, score in hits:
                q, r = (coverage(p, seen) for p in self.index.parts[item])
                if q >= MIN_QUESTION and r >= MIN_ANSWER:
                    old = best.setdefault((k, item), [0.0, 0.0, 0.0, 0])
                    old[:] = [max(old[0], score), max(old[1], q), max(old[2], r), old[3] + 1]
        return [(k, item, *v) for (k, item), v in sorted(best.items())]


FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, n_passages long"


def shards(items: DataFrame, shard_bytes: int = SHARD_BYTES):
    """Lists of (item_id, text) of at most about ``shard_bytes`` each, read one at a time."""
    rows = items.where(F.col("text").isNotNull()).select("item_id", "text").distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / shard_bytes))
    for k in range(n):
        own = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r.item_id, r.text) for r in own.collect()]


def contaminated(docs: DataFrame, items: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row for every pair of a document and a test item that it holds."""
    out = None
    every = Statistics()
    for shard in shards(items, shard_bytes):
        every.add(shard)
    for shard in shards(items, shard_bytes):
        index = docs.sparkSession.sparkContext.broadcast(Index(shard, every))

        def run(it, index=index):
            matcher = Matcher(index.value)
            names = [x.split()[0] for x in FOUND.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            for batch in batches(it, 400):
                ids = batch.column(0).to_pylist()
                rows = [(ids[k], matcher.index.items[i][0], *v) for k, i, *v in matcher.match(batch.column(1).to_pylist())]
                columns = list(zip(*rows)) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FOUND)
        out = part if out is None else out.unionByName(part)
    best = [F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap", "n_passages")]
    return out.groupBy("doc_id", "item_id").agg(*best)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
