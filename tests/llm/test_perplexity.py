"""The character model against a plain one, and thresholds from documents that it hasn't seen."""

import math
from collections import Counter, defaultdict

import pytest

from runlattice.llm import perplexity as P

KIND = "doc_id long, text string, lang string"


def plain(texts: list[str]):
    """Interpolated modified Kneser-Ney over tuples of characters; the logarithm of p(last | those before)."""
    pad = [None] * (P.ORDER - 1)
    counts = {P.ORDER: Counter(tuple(s[i : i + P.ORDER]) for t in texts for s in [pad + list(t)] for i in range(len(t)))}
    for k in range(P.ORDER - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    off, total, freed = {}, defaultdict(int), defaultdict(float)
    for k, c in counts.items():
        n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
        d = [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.0), i - 0.01) if n[i - 1] else y for i in (1, 2, 3)]
        off[k] = [x if x > 0 else 0.1 for x in d]
        for g, v in c.items():
            total[k, g[:-1]] += v
            freed[k, g[:-1]] += off[k][min(v, 3) - 1]

    def p(g):
        k = len(g)
        if k == 0:
            return 1.0 / (len(counts[1]) + 1)
        if (k, g[:-1]) not in total:
            return p(g[1:])
        v = counts[k].get(g, 0)
        own = (v - off[k][min(v, 3) - 1]) / total[k, g[:-1]] if v else 0.0
        return own + freed[k, g[:-1]] / total[k, g[:-1]] * p(g[1:])

    def perplexity(t):
        s = pad + list(t)
        return math.exp(-sum(math.log(p(tuple(s[i : i + P.ORDER]))) for i in range(len(t))) / len(t))

    return perplexity


def test_perplexity_equals_a_plain_model(spark):
    known = ["the cat sat on the mat", "a cat and the other cat", "on and on the mat sat", "der Hund ß", "aaaa" * 300]
    new = ["the hat sat", "on a cat", "xyz the", "m", "the cat sat on the mat " * 500]
    texts = spark.createDataFrame([(t,) for t in known], "text string")
    ids = P.symbols(texts)
    model = P.train(texts, ids)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*known, *new, "", None])], KIND)
    expected = plain(known)
    for got in (P.score_local(docs, P.local(model), ids, ["doc_id"]), P.score_joined(docs, model, ids, ["doc_id"])):
        held = {r.doc_id: r.perplexity for r in got.collect()}
        # a character that the model hasn't seen has a symbol of its own, which the plain model has too
        assert all(held[i] == pytest.approx(expected(t), rel=1e-9) for i, t in enumerate([*known, *new]))
        assert held[10] is None and held[11] is None


def test_thresholds_come_from_what_was_held_out(spark):
    rows = [(i, f"text number {i} of the kind that is trusted here", "x") for i in range(400)]
    docs = spark.createDataFrame(rows, KIND)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    part, apart = P.trained_on(docs.select("text"))
    assert apart and 300 < part.count() < 400
    seen = {r.text for r in part.collect()}
    got = P.classify(docs, labels, quantile=1.0).collect()
    out = [r.perplexity for r in got if r.text not in seen]
    assert {round(r.threshold, 9) for r in got} == {round(max(out), 9)}
    assert all(r.kept for r in got if r.text not in seen)


def test_columns_of_any_name_pass(spark):
    docs = spark.createDataFrame([(1, "abc abd", "x", "k", 5), (1, "abc abd", "x", "k", 5), (None, None, None, None, None)], KIND + ", doc string, t int")
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = P.classify(docs, labels).collect()
    assert sorted((r.doc_id or 0, r.doc, r.t, r.kept) for r in got if r.doc) == [(1, "k", 5, True)] * 2
    assert [r.kept for r in got if r.doc_id is None] == [False]
    assert P.classify(docs.limit(0), labels).collect() == []
