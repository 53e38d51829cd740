import random

import numpy as np
import pytest

from runlattice.llm import jaccard, line_dedup, suffix_dedup
from runlattice.llm.shingles import shingle_sets
from tests.llm.data import DOCS, documents


def shingles(t):
    ws = (t or "").encode().lower().split()
    return frozenset(tuple(ws[k : k + 5]) for k in range(len(ws) - 4)) if len(ws) >= 5 else frozenset([tuple(ws)] if ws else [])


def grouped(rows):
    """(doc_id, size, smallest doc_id of the component) of each row."""
    sets = [(i, shingles(t)) for i, t in rows]
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                comp[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(sets)]


def mutated(seed, n=120):
    """Short and long texts with copies that lie around the threshold."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    out = []
    for size in (5, 6, 8, 9, 12, 20, 31, 40, 70, 130, 260):
        for _ in range(3):
            base = [r.choice(words) for _ in range(size)]
            out.append(list(base))
            for _ in range(4):
                copy = list(base)
                for _ in range(r.randint(1, max(1, size // 12))):
                    at = r.randrange(len(copy))
                    copy[at : at + r.randint(0, 1)] = [r.choice(words)] * r.randint(0, 2)
                out.append(copy)
    return [(i, " ".join(x)) for i, x in enumerate(out)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = [(r[0], r[1]) for r in documents(seed)] + [(i + 1000, t) for i, t in mutated(seed)]
    got = jaccard.jaccard_components(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, cls long"))
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(grouped(rows), key=key)


def test_pigeonhole_never_loses_a_pair():
    """Linked sets share a key that isn't only a neighbour of both, with a probe where it is an empty segment."""
    r = np.random.default_rng(4)
    for n in list(range(4, 40)) + [63, 64, 80, 127, 128, 200, 511, 512, 640]:
        for _ in range(6):
            tokens = np.unique(r.integers(0, 1 << 63, n + n, dtype=np.uint64))[: n + n // 4 + 2]
            r.shuffle(tokens)
            a = np.sort(tokens[:n])
            drop = int(r.integers(0, n // 4 + 1))
            add = int(r.integers(0, n // 4 + 1))
            b = np.sort(np.concatenate((tokens[drop:n], tokens[n : n + add])))
            if not len(b) or not jaccard.linked(a, b) or len(a) == len(b) and (a == b).all():
                continue
            ka, fa = jaccard.subsets(a)
            kb, fb = jaccard.subsets(b)
            da, db = {}, {}
            for k, f, d in [(k, f, da) for k, f in zip(ka, fa)] + [(k, f, db) for k, f in zip(kb, fb)]:
                d.setdefault(int(k), []).append(int(f))
            good = False
            for k in da.keys() & db.keys():
                for f in da[k]:
                    for g in db[k]:
                        both_neighbours = f & g & jaccard.DELETED
                        unprobed = f & jaccard.EMPTY and not (f | g) & jaccard.PROBE
                        good |= not both_neighbours and not unprobed
            assert good, (n, len(a), len(b))
            width = (4 << min(len(a).bit_length(), len(b).bit_length())) // 64 or 1
            x, y = (jaccard.folded(jaccard.bitmap(s), width) for s in (a, b))
            assert np.bitwise_count(x ^ y).sum() <= min(len(a), len(b)) // 4


def test_keep_one_of_each_group(spark):
    rows = documents()
    out = jaccard.keep_one(spark.createDataFrame(rows, DOCS))
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())
    expected = {(i is None, i or 0) for i, _, c in grouped([(r[0], r[1]) for r in rows]) if i == c}
    assert kept == sorted(expected)
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert jaccard.keep_one(spark.createDataFrame([], DOCS)).count() == 0


def test_lines_that_repeat_stay_once(spark):
    line = "The quick brown fox jumps over the lazy dog near the river bank today"
    rows = [
        (1, f"{line}\nfirst own line that nobody else has written down", "a", 9),
        (2, f"short\n{line.upper()}!!\nshort\nsecond own line which is quite different from it", "b", 9),
        (3, f"{line}\n{line}", "c", 9),
        (4, None, "d", 9),
        (5, "", "e", 9),
        (None, line + "\nkept words of a document that has no number at all", "f", 9),
        (6, line.replace("lazy", "lazi"), "g", 9),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_lines long")
    got = {r.lang: r for r in line_dedup.dedup_lines(docs).collect()}
    assert got["a"].text == rows[0][1] and got["a"].n_removed == 0
    assert got["b"].text == "short\nshort\nsecond own line which is quite different from it"
    assert (got["c"].text, got["c"].n_lines, got["c"].n_removed) == ("", 2, 2)
    assert got["d"].text is None and got["d"].n_lines == 0 and got["e"].text == ""
    assert got["f"].text == "kept words of a document that has no number at all"
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_fuzzy_lines_are_found(spark):
    """Lines of forty words with one changed: most are found, and none that differ."""
    r = random.Random(3)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ra", "so", "ti") for b in ("n", "r", "s", "t", "l", "m", "x", "z")]
    rows = []
    for i in range(60):
        ws = [r.choice(words) + str(r.randint(0, 99)) for _ in range(40)]
        rows.append((2 * i, " ".join(ws)))
        ws[r.randrange(40)] = "other"
        rows.append((2 * i + 1, " ".join(ws)))
    got = {x.doc_id: x.n_removed for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] for i in range(0, 120, 2)) == 0
    assert sum(got[i] for i in range(1, 120, 2)) >= 57


def test_suffixes_come_in_order():
    r = random.Random(3)
    for _ in range(30):
        pieces = [bytes(r.choice(b"abc") for _ in range(r.randint(1, 70))) for _ in range(r.randint(1, 6))]
        text = np.concatenate([np.concatenate((np.frombuffer(p, np.uint8).astype(np.int16) + 1, np.zeros(8, np.int16))) for p in pieces])
        stops = np.cumsum([len(p) + 8 for p in pieces]) - 8
        ends = np.concatenate([np.full(len(p) + 8, e) for p, e in zip(pieces, stops)])
        order = suffix_dedup.suffix_order(text, ends)
        assert sorted(order.tolist()) == np.flatnonzero(text > 0).tolist()
        got = [bytes((text[i : ends[i]] - 1).astype(np.uint8)) for i in order]
        assert got == sorted(got)


def removed(texts, n=200):
    where = {}
    data = [(t or "").encode() for t in texts]
    for k, d in enumerate(data):
        for i in range(len(d) - n + 1):
            where.setdefault(d[i : i + n], []).append((k, i))
    cover = [bytearray(len(d)) for d in data]
    for at in where.values():
        if len(at) > 1:
            for k, i in at:
                cover[k][i : i + n] = b"\1" * n
    return [bytes(b for b, c in zip(d, m) if not c) for d, m in zip(data, cover)]


@pytest.mark.parametrize("max_regions", [20_000, 1])
def test_repeated_bytes_equal_brute_force(spark, max_regions):
    r = random.Random(9)
    passage = "".join(r.choice("abcdé ") for _ in range(330))
    texts = ["".join(r.choice("abcdefgh \n") for _ in range(r.randint(0, 900))) for _ in range(14)]
    texts += [t[:150] + passage + t[150:] for t in texts[:5]] + [passage[:250], passage[40:245] + "z", "ab" * 400, "x" * 600, None, "", texts[3], texts[3]]
    rows = [(i if i != 4 else None, t, 5) for i, t in enumerate(texts)]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, n_bytes long"), max_regions)
    got = sorted((r.n_bytes, r.n_removed, bytes(r.data)) for r in out.collect())
    left = removed(texts)
    assert got == sorted((len((t or "").encode()), len((t or "").encode()) - len(x), x) for t, x in zip(texts, left))
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shingle_sets_are_those_of_brute_force():
    def brute(text):
        ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
        return frozenset([tuple(ws)] if 0 < len(ws) < 5 else [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)])

    r = random.Random(5)
    texts = [None, "", " \n", "a", "a b", "b a", "É", "é", "A b C d E f", "a B c D e F", "a b c d", "a b c d e", "x\x0by\x0cz\x1cw\x85v\xa0u t s r", "b" * 64 + " c d e f g", "b" * 65 + " c d e f g"]
    texts += ["".join(r.choice("aB \n\t") for _ in range(r.randint(0, 60))) for _ in range(800)]
    texts += ["w" * r.randint(1, 90) + " " + "é" * r.randint(1, 70) + " v" * 5 for _ in range(200)] + ["word " * 300_000, "a " * 9]
    hashes: dict = {}
    for text, h in zip(texts, shingle_sets(texts), strict=True):
        assert len(h) == len(brute(text)) and (h[1:] > h[:-1]).all()
        hashes.setdefault(brute(text), set()).add(tuple(h.tolist()))
    assert all(len(x) == 1 for x in hashes.values()) and len(set.union(*hashes.values())) == len(hashes)
    assert [x.tolist() for t in texts[:50] for x in shingle_sets([t])] == [x.tolist() for x in shingle_sets(texts[:50])]
