"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue.  Its documents, in a shuffled but fixed order, get the virtual finish
time (words of the source up to and with the document) / (target of the source); further rounds of
the source follow the first.  All documents of all sources are then range-sorted by finish time and
the order is cut at the total budget, so each source has come about equally far on its way to its target.

The running sums never gather a source in one task: sums are taken per slice of the order, offsets
come from a window over the slices, and only a slice is summed row by row.

Null source is a source (the last), null text has size 0; rows that repeat are documents of their
own; an empty table gives an empty result; columns that clash with the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runlattice.functions.storage import materialize
from runlattice.llm.common import free, n_words, table

WEIGHTS = (5, 2, 1)
#: Share of all sizes to take, and how often a document may be taken.
BUDGET_PERCENT, ROUNDS = 150, 2
SLICE_ROWS = 2_000
#: Slices whose offsets one task sums up.
BLOCK_SLICES = 4_096


def targets(sizes: DataFrame, weights=WEIGHTS, percent: int = BUDGET_PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """(source, source_size) to (source, source_size, target): water filling in closed form.

    The table has a row per source.  A source is full when ``rounds * size`` is at most its share;
    sources get full in the order of ``rounds * size / weight``, so one pass over that order finds
    the last one that does.
    """
    every = W.partitionBy(F.lit(0))
    ranked = sizes.withColumn(
        "_w",
        F.element_at(
            F.array(*[F.lit(float(x)) for x in weights]),
            F.pmod(F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1,
        ),
    ).withColumn("_cap", F.col("source_size") * F.lit(float(rounds)))
    order = every.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    upto = order.rowsBetween(W.unboundedPreceding, -1)
    stepped = (
        ranked.withColumn("_all", F.sum("source_size").over(every) * F.lit(percent / 100.0))
        .withColumn("_weights", F.sum("_w").over(every))
        .withColumn("_full", F.coalesce(F.sum("_cap").over(upto), F.lit(0.0)))
        .withColumn("_gone", F.coalesce(F.sum("_w").over(upto), F.lit(0.0)))
        .withColumn("_level", (F.col("_all") - F.col("_full")) / (F.col("_weights") - F.col("_gone")))
        .withColumn("_open", F.col("_cap") / F.col("_w") > F.col("_level"))
    )
    # the first open source sets the level of all that stay open
    first = F.first(F.when(F.col("_open"), F.col("_level")), ignorenulls=True).over(
        order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    )
    return stepped.withColumn("_line", first).select(
        "source",
        "source_size",
        F.coalesce(F.least(F.col("_cap"), F.col("_w") * F.col("_line")), F.col("_cap")).alias("target"),
    )


def _running(df: DataFrame, keys: list[str], slice_col: str, order: list, value: str, out: str) -> DataFrame:
    """``out``: the running sum of ``value`` within ``keys`` in the order of (slice_col, order), peers included."""
    # offsets in two levels: a task holds the slices of one block, and one row a block
    block = F.floor(F.col(slice_col) / BLOCK_SLICES).alias("_block")
    per = df.groupBy(*keys, slice_col).agg(F.sum(value).alias("_s")).select("*", block)
    blocks = per.groupBy(*keys, "_block").agg(F.sum("_s").alias("_b"))
    by = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    rows = by.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "_block", F.coalesce(F.sum("_b").over(rows), F.lit(0)).alias("_upto"))
    rows = W.partitionBy(*keys, "_block").orderBy(slice_col).rowsBetween(W.unboundedPreceding, -1)
    inner = per.select(*keys, slice_col, "_block", F.coalesce(F.sum("_s").over(rows), F.lit(0)).alias("_in"))
    cond = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_block"]]
    offsets = inner.alias("l").join(blocks.alias("r"), cond)
    offsets = offsets.select(*[F.col(f"l.{k}") for k in [*keys, slice_col]], (F.col("l._in") + F.col("r._upto")).alias("_before"))
    cond = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, slice_col]]
    joined = df.alias("l").join(offsets.alias("r"), cond).select("l.*", "r._before")
    inside = W.partitionBy(*keys, slice_col).orderBy(*order)
    frame = inside.rangeBetween if len(order) == 1 else inside.rowsBetween
    return joined.withColumn(
        out, F.col("_before") + F.sum(value).over(frame(W.unboundedPreceding, W.currentRow))
    ).drop("_before")


def schedule(
    docs: DataFrame,
    weights=WEIGHTS,
    percent: int = BUDGET_PERCENT,
    rounds: int = ROUNDS,
    seed: str = "mix-1",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """A narrow row for each document: doc_id, source, size, source_size, target, taken, _x (hash of the text)."""
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("_x"))
    key = F.concat(F.lit(seed + "/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = materialize(sized.withColumn("_h", F.md5(key)), "mix-sizes")
    slices = 1 << (max(1, sized.count() // slice_rows) - 1).bit_length()
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = materialize(targets(per_source, weights, percent, rounds), "mix-targets")

    # a slice is a range of the shuffled order: the leading 32 bits of the hash, so slices are even
    top = F.conv(F.substring("_h", 1, 8), 16, 10).cast("long")
    cut = sized.withColumn("_slice", F.shiftright(top * F.lit(slices), 32))
    order = ["_h", F.col("doc_id").asc_nulls_last(), "_x", "size"]
    cum = _running(cut, ["source"], "_slice", order, "size", "_cum").drop("_slice")
    same = F.col("l.source").eqNullSafe(F.col("r.source"))
    cum = cum.alias("l").join(goals.alias("r"), same).select("l.*", "r.source_size", "r.target")
    cum = materialize(cum, "mix-running")

    finish = lambda r: (F.col("_cum") + F.lit(r) * F.col("source_size")) / F.col("target")
    turns = F.filter(F.array(*[finish(r) for r in range(rounds)]), lambda x: x.isNotNull())
    line = cum.where(F.col("size") > 0).select("size", F.explode(turns).alias("_finish"))
    # the global order by finish time: ranges of it are summed first, then the rows within a range
    # the cut lies near 1; a source much larger than its target goes on far beyond, in slices that get wider
    even = F.least(F.col("_finish"), F.lit(4.0)) * F.lit(float(slices * 8))
    wide = F.log2(F.greatest(F.col("_finish"), F.lit(4.0)) / F.lit(4.0)) * F.lit(float(slices * 8))
    line = line.withColumn("_slice", F.floor(even) + F.floor(wide))
    upto = _running(line, [], "_slice", ["_finish"], "size", "_upto")
    budget = sized.agg((F.coalesce(F.sum("size"), F.lit(0)) * F.lit(percent).cast("long")).alias("_budget"))
    fits = F.col("_upto") * F.lit(100).cast("long") <= F.col("_budget")
    last = upto.join(F.broadcast(budget), fits).agg(F.max("_finish").alias("_last"))  # one row each
    taken = sum((F.when(finish(r) <= F.col("_last"), F.col("size")).otherwise(0) for r in range(rounds)), F.lit(0))
    return cum.join(F.broadcast(last)).select(
        "doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "_x"
    )


def mix(docs: DataFrame, **how) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with size, source_size, target and taken."""
    added = ["size", "source_size", "target", "taken"]
    rows = docs.drop(*added)
    key = ["doc_id", "source", "_x"]
    plan = materialize(schedule(rows, **how), "mix-plan")
    x, n = free(rows, "x", "n")
    full = rows.withColumn(x, F.xxhash64("text"))
    on = [("doc_id", "doc_id"), ("source", "source"), (x, "_x")]
    if plan.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").limit(1).count():
        # rows that agree in all of the key are interchangeable; a number tells them apart
        plan = plan.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(F.lit(0))))
        full = full.withColumn(n, F.row_number().over(W.partitionBy("doc_id", "source", x).orderBy(F.lit(0))))
        on.append((n, "_n"))
    on = [F.col(f"l.`{a}`").eqNullSafe(F.col(f"r.{b}")) for a, b in on]
    full = full.alias("l").join(plan.alias("r"), on)
    return full.select(*[F.col(f"l.`{c}`") for c in rows.columns], *[F.col(f"r.{c}") for c in added])


def op8_weighted_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return schedule(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS size,
   md5('mix-1/' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
r1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
   source_size * 2.0::DOUBLE AS cap FROM src),
r2 AS (SELECT *, (SELECT sum(source_size) * 1.5::DOUBLE FROM src) AS tot, (SELECT sum(w) FROM r1) AS ws,
   coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS filled,
   coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS gone FROM r1),
r3 AS (SELECT *, (tot - filled) / (ws - gone) AS level FROM r2),
lev AS (SELECT level FROM r3 WHERE cap / w > level ORDER BY cap / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(cap, w * (SELECT level FROM lev)), cap) AS target FROM r3),
c AS (SELECT s.*, t.source_size, t.target, CAST(sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id NULLS LAST ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum
   FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, cum / target AS f0, (cum + source_size) / target AS f1 FROM c),
line AS (SELECT f0 AS fin, size FROM f WHERE size > 0 UNION ALL SELECT f1, size FROM f WHERE size > 0),
u AS (SELECT fin, sum(size) OVER (ORDER BY fin RANGE UNBOUNDED PRECEDING) AS upto FROM line),
z AS (SELECT max(fin) AS last FROM u WHERE upto * 100 <= (SELECT sum(size) * 150 FROM s))
SELECT doc_id, size, source_size, target, CAST(CASE WHEN f0 <= last THEN size ELSE 0 END + CASE WHEN f1 <= last THEN size ELSE 0 END AS BIGINT) AS taken
FROM f CROSS JOIN z
"""
