"""Quality classifier: interpolated modified Kneser-Ney model of characters, trained on trusted text.

N-grams of ORDER characters are counted over all trusted text (summed per task before the shuffle);
lower orders get continuation counts from the table of the order above.  Discounts come from counts of
counts, back-off weights from sums per context, and joins sharded by n-gram or context turn the tables
into a probability for each seen n-gram of each order.  Documents get the perplexity of their whole
text and are kept up to a quantile of the trusted documents of their language that the model hasn't seen:
one trusted text in HELD_OUT, told by its hash, is left out of training for that.

A model of at most ``MAX_BROADCAST`` rows is broadcast; a larger one stays sharded and is joined with
the documents' n-gram counts.  Both give the same perplexity.

Null or empty text has no perplexity and isn't kept.  Null language is a group of its own; a language
with fewer than MIN_TRUSTED held-out documents takes the quantile over all of them; where none is held out or
none would be left to train on, the trusted documents do both.  Without trusted text all perplexities are null and
what has text is kept.  Texts may be of any length; an empty table gives an empty one.  Repeated rows are judged alike; clashing columns of
the caller are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from runlattice.functions.storage import materialize
from runlattice.llm.common import batches, bounded, free, table

ORDER, BITS = 4, 15
BEGIN, UNKNOWN, FIRST = 1, 2, 3
MAX_SYMBOLS = (1 << BITS) - FIRST
MAX_BROADCAST = 2_000_000
#: Ids of trusted documents, eight bytes each, that are broadcast; more are joined by a shuffle of both sides.
BROADCAST_IDS = 1_000_000
QUANTILE, MIN_TRUSTED, HELD_OUT = 0.995, 20, 10
MASK = (1 << BITS) - 1


def symbols(texts: DataFrame, text: str = "text") -> np.ndarray:
    """Numbers of the characters: the MAX_SYMBOLS most frequent ones of the trusted text; the others are UNKNOWN."""

    def run(it):
        total = np.zeros(0x110000, np.int64)
        for batch in batches(it):
            for t in batch.column(0).to_pylist():
                if t:
                    c = np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32))
                    total[: len(c)] += c
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["ch", "n"])

    rows = texts.select(text).mapInArrow(run, "ch long, n long").groupBy("ch").agg(F.sum("n").alias("n"))
    out = np.full(0x110000, UNKNOWN, np.uint16)
    for k, r in enumerate(rows.orderBy(F.desc("n"), "ch").limit(MAX_SYMBOLS).collect()):
        out[r.ch] = FIRST + k
    return out


def grams(text: str, ids: np.ndarray) -> np.ndarray:
    """The n-grams of ORDER that end at each character, packed."""
    s = ids[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
    s = np.concatenate((np.full(ORDER - 1, BEGIN, np.int64), s))
    n = len(s) - ORDER + 1
    out = np.zeros(n, np.int64)
    for k in range(ORDER):
        out = out << BITS | s[k : k + n]
    return out


def count(texts: DataFrame, ids: np.ndarray) -> DataFrame:
    """(g, c): n-grams of ORDER and how often they occur."""
    table_ = texts.sparkSession.sparkContext.broadcast(ids)

    def run(it):
        held, size = [], 0

        def flush():
            g, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(g), pa.array(c)], ["g", "c"])

        for batch in batches(it):
            for t in batch.column(0).to_pylist():
                if t:
                    held.append(grams(t, table_.value))
                    size += len(held[-1])
            if size > 4_000_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return texts.select("text").mapInArrow(run, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))


def train(texts: DataFrame, ids: np.ndarray) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: ((g, p): probability of seen n-grams, (ctx, w): back-off weight of contexts)."""
    tables = [materialize(count(texts, ids), "kn-counts")]
    for k in range(ORDER - 1, 0, -1):
        cut = F.col("g").bitwiseAND(F.lit((1 << BITS * k) - 1))
        tables.insert(0, materialize(tables[0].groupBy(cut.alias("g")).agg(F.count(F.lit(1)).alias("c")), "kn-counts"))
    out, below, size = [], None, tables[0].count()
    for k, t in enumerate(tables, 1):
        n = t.agg(*[F.coalesce(F.sum((F.col("c") == i).cast("double")), F.lit(0.0)).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
        y = n.n1 / (n.n1 + 2 * n.n2) if n.n1 and n.n2 else 0.5
        d = [min(max(i - (i + 1) * y * b / a, 0.0), i - 0.01) if a else y for i, a, b in ((1, n.n1, n.n2), (2, n.n2, n.n3), (3, n.n3, n.n4))]
        d = [x if x > 0 else 0.1 for x in d]
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        part = t.withColumns({"ctx": F.shiftright("g", BITS), "off": off})
        sums = part.groupBy("ctx").agg(F.sum("c").alias("total"), F.sum("off").alias("freed"))
        full = part.join(sums, "ctx").select("g", ((F.col("c") - F.col("off")) / F.col("total")).alias("a"), (F.col("freed") / F.col("total")).alias("w"))
        if below is None:
            p = full.select("g", (F.col("a") + F.col("w") / F.lit(float(size + 1))).alias("p"))
        else:
            low = below.withColumnRenamed("g", "low").withColumnRenamed("p", "lp")
            cut = F.col("g").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1))
            p = full.withColumn("low", cut).join(low, "low").select("g", (F.col("a") + F.col("w") * F.col("lp")).alias("p"))
        below = materialize(p, "kn-p")
        out.append((below, materialize(sums.select("ctx", (F.col("freed") / F.col("total")).alias("w")), "kn-w")))
    return out


class Local:
    """The model as sorted arrays."""

    def __init__(self, orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.orders = orders

    def log_p(self, g: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of packed n-grams."""
        return np.log(self._p(g, len(self.orders)))

    def _p(self, g: np.ndarray, k: int) -> np.ndarray:
        keys, p, ctx, w = self.orders[k - 1]
        g = g & ((1 << BITS * k) - 1)
        at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
        out = np.where(keys[at] == g, p[at], 0.0)
        miss = np.flatnonzero(keys[at] != g)
        if len(miss):
            c = g[miss] >> BITS
            i = np.minimum(np.searchsorted(ctx, c), len(ctx) - 1)
            weight = np.where(ctx[i] == c, w[i], 1.0)
            below = self._p(g[miss], k - 1) if k > 1 else np.full(len(miss), 1.0 / (len(keys) + 1))
            out[miss] = weight * below
        return out


def local(model: list[tuple[DataFrame, DataFrame]]) -> Local:
    orders = []
    for p, w in model:
        a, b = p.toArrow(), w.toArrow()
        x = [a.column(0).to_numpy(), a.column(1).to_numpy(), b.column(0).to_numpy(), b.column(1).to_numpy()]
        i, j = np.argsort(x[0]), np.argsort(x[2])
        orders.append((x[0][i], x[1][i], x[2][j], x[3][j]))
    return Local(orders)


def score_local(docs: DataFrame, model: Local, ids: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with perplexity, the model broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast((model, ids))
    at, places, names = docs.columns.index("text"), [docs.columns.index(c) for c in keep], [*keep, "perplexity"]

    def run(it):
        lm, table_ = shared.value
        for batch in batches(it, 300):
            held = [grams(t, table_) if t else np.empty(0, np.int64) for t in batch.column(at).to_pylist()]
            n = np.array([len(x) for x in held])
            u, where = np.unique(np.concatenate(held), return_inverse=True)
            total = np.bincount(np.repeat(np.arange(len(n)), n), lm.log_p(u)[where] if len(u) else None, len(n))
            ppl = np.exp(-total / np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in places], pa.array(ppl, pa.float64(), mask=n == 0)], names)

    kinds = {f.name: f for f in docs.schema}
    return docs.mapInArrow(run, StructType([kinds[c] for c in keep]).add("perplexity", "double"))


def score_joined(docs: DataFrame, model: list[tuple[DataFrame, DataFrame]], ids: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with perplexity by joins of n-gram counts with the sharded model."""
    (key,) = free(docs, "key")
    rest = docs.withColumn(key, F.sha2("text", 256))
    shared = docs.sparkSession.sparkContext.broadcast(ids)

    def run(it):
        for batch in batches(it, 300):
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    g, c = np.unique(grams(text, shared.value), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(g)), pa.array(g), pa.array(c)], ["_k", "g", "c"])

    per = rest.select(F.col(key).alias("_k"), "text").dropDuplicates(["_k"]).mapInArrow(run, "_k string, g long, c long")
    # each distinct n-gram is looked up once, order by order, and its probability joined back
    want = per.select("g").distinct().withColumns({"lp": F.lit(0.0), "done": F.lit(False)})
    for k in range(len(model), 0, -1):
        p, w = model[k - 1]
        want = want.withColumn("_g", F.col("g").bitwiseAND(F.lit((1 << BITS * k) - 1))).withColumn("_c", F.shiftright("_g", BITS))
        want = want.join(p.select(F.col("g").alias("_g"), "p"), "_g", "left").join(w.select(F.col("ctx").alias("_c"), "w"), "_c", "left")
        add = F.when(F.col("done"), 0.0).when(F.col("p").isNotNull(), F.log("p")).otherwise(F.coalesce(F.log("w"), F.lit(0.0)))
        want = want.select("g", (F.col("lp") + add).alias("lp"), (F.col("done") | F.col("p").isNotNull()).alias("done"))
    floor = -np.log(model[0][0].count() + 1.0)
    want = want.select("g", F.when(F.col("done"), F.col("lp")).otherwise(F.col("lp") + float(floor)).alias("lp"))
    sums = per.join(want, "g").groupBy("_k").agg(F.exp(-F.sum(F.col("c") * F.col("lp")) / F.sum("c")).alias("perplexity"))
    return rest.select(*keep, key).join(sums.withColumnRenamed("_k", key), key, "left").select(*keep, "perplexity")


def trained_on(texts: DataFrame) -> tuple[DataFrame, bool]:
    """(what of the trusted texts the model is trained on, whether the others are held out)."""
    out = F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0
    kinds = texts.select(out.alias("o")).groupBy("o").count().collect()  # two rows at most
    return (texts.where(~out), True) if len(kinds) == 2 else (texts, False)


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, max_broadcast: int = MAX_BROADCAST, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (doc_id, text, lang, ...) with perplexity, threshold and kept; of their columns those in ``keep`` (None: all).

    Texts are scored once; what is kept of the rows is written with the score.
    """
    rest = docs.drop("perplexity", "threshold", "kept")
    keep = rest.columns if keep is None else keep
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_q")).where("_q > 0").select("doc_id")
    good = bounded(materialize(good, "kn-trusted"), BROADCAST_IDS)
    texts = rest.select("doc_id", "text").where(F.length("text") > 0).join(good, "doc_id", "left_semi").select("text")
    texts, apart = trained_on(texts)
    ids = symbols(texts)
    model = train(texts, ids)
    rows = sum(p.count() + w.count() for p, w in model)
    if rows == 0:
        null = F.lit(None).cast("double")
        told = rest.withColumns({"perplexity": null, "threshold": null, "kept": F.coalesce(F.length("text") > 0, F.lit(False))})
        return told.select(*keep, "perplexity", "threshold", "kept")
    doc, lang, out, t, n, whole, name = free(rest, "doc", "language", "out", "t", "n", "whole", "name")
    seen = F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0 if apart else F.lit(True)
    ready = rest.withColumns({doc: F.col("doc_id"), lang: F.col("lang"), out: seen})
    wide = list(dict.fromkeys([*keep, doc, lang, out]))
    scored = score_local(ready, local(model), ids, wide) if rows <= max_broadcast else score_joined(ready, model, ids, wide)
    scored = materialize(scored, "kn-scores")
    few = scored.where(out).select(F.col(doc).alias("doc_id"), F.col(lang).alias(name), "perplexity").join(good, "doc_id", "left_semi")
    at = F.percentile_approx("perplexity", quantile, 10000)
    by = few.groupBy(name).agg(at.alias(t), F.count("perplexity").alias(n)).where(F.col(n) >= MIN_TRUSTED).select(name, t)
    over = few.agg(at.alias(whole))
    # one row, and one row a language
    told = scored.join(F.broadcast(over)).join(F.broadcast(by), F.col(lang).eqNullSafe(F.col(name)), "left")
    threshold = F.coalesce(t, whole)
    kept = F.coalesce(F.col("perplexity") <= threshold, F.lit(False))
    return told.withColumns({"threshold": threshold, "kept": kept}).select(*keep, "perplexity", "threshold", "kept")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return classify(docs, table(spark, sf_dir, "labels"), keep=["doc_id"])
