import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from runlattice.llm import decontamination, html, language, perplexity
from tests.llm.data import DOCS, documents

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS).cache()


def test_language_of_held_out_documents(spark):
    got = language.op4_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in out) >= 0.95 * len(out)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark, docs):
    learned = language.learn(docs)
    got = {(r.doc_id, r.text): r for r in language.predict(docs, learned).collect()}
    assert len(got) == len({(r[0], r[1]) for r in documents()})
    for r in got.values():
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in learned
    assert {r.lang_pred for r in language.predict(docs, {}).collect()} == {"und"}
    assert language.learn(docs.limit(0)) == {}


def test_decontamination_finds_what_holds_an_item(spark):
    got = {(r.doc_id, r.item_id) for r in decontamination.op3_decontamination(spark, SF).collect()}
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    expected = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text}
    assert expected <= got and len(got - expected) <= 2


def test_wand_equals_scoring_everything():
    items = [(k, f"alpha w{k} w{k + 1} common w{k + 7} beta{k % 3}. answer{k} final w{k}") for k in range(60)]
    ix = decontamination.Index(items)
    for k in range(60):
        query = sorted({ix.vocabulary[w] for w in decontamination.terms(items[k][1] + " extra words common")if w in ix.vocabulary})
        for least in (0.2, 0.5, 0.9):
            full = {}
            for t in query:
                for d, x in zip(ix.docs[t], ix.impacts[t]):
                    full[d] = full.get(d, 0.0) + x
            expected = {d: s for d, s in full.items() if s >= least - 1e-9}
            assert dict(ix.wand(query, least)) == pytest.approx(expected)


def test_decontamination_edges(spark, docs):
    items = spark.createDataFrame([(1, documents()[4][1]), (2, None), (3, ""), (4, "...")], "item_id long, text string")
    got = decontamination.contaminated(docs, items).collect()
    assert 4 in {r.doc_id for r in got} and {r.item_id for r in got} == {1}
    split = decontamination.contaminated(docs, items, shard_bytes=30).collect()
    assert {(r.doc_id, r.item_id) for r in split} == {(r.doc_id, r.item_id) for r in got}
    assert decontamination.contaminated(docs.limit(0), items).count() == 0
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0


def test_perplexity_tells_junk_and_joins_agree(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    a = {r.doc_id: r for r in perplexity.classify(d, labels).collect()}
    b = {r.doc_id: r for r in perplexity.classify(d, labels, max_broadcast=0).collect()}
    assert all(a[k].perplexity == pytest.approx(b[k].perplexity) and a[k].kept == b[k].kept for k in a)
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert sum(a[k].kept for k in good) >= 0.97 * len(good)


def test_probabilities_sum_to_one(spark):
    texts = spark.createDataFrame([("abracadabra",), ("abcabc",), ("banana band",)], "text string")
    ids = perplexity.symbols(texts)
    model = perplexity.local(perplexity.train(texts, ids))
    import numpy as np

    known = sorted(set(ids.tolist()))  # the unknown symbol stands for the mass that is left
    for context in ("abr", "zzz", "ana"):
        g = [int(perplexity.grams(context + "a", ids)[-1]) >> perplexity.BITS << perplexity.BITS | k for k in known]
        total = float(np.exp(model.log_p(np.array(g, np.int64))).sum())
        assert total == pytest.approx(1.0, abs=0.02)


def test_perplexity_edges(spark, docs):
    labels = spark.createDataFrame([(i, 1) for i in range(50)] + [(None, 1), (3, 0)], "doc_id long, quality int")
    got = perplexity.classify(docs, labels).collect()
    assert len(got) == len(documents())
    assert all((r.perplexity is None) == (not r.text) for r in got)
    assert not any(r.kept for r in got if not r.text)
    none = perplexity.classify(docs, labels.limit(0)).collect()
    assert all(r.kept == bool(r.text) and r.perplexity is None for r in none)


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{x:1}</style></head><body><nav><ul><li><a href="/">Menu</a></ul></nav>
<div class="ad banner">Buy</div><!-- <p>no</p> --><article><h1>Title &amp; more</h1><p>One <b>bo</b>ld&nbsp;word<p>Two<br>three
four<script>var x = "</p><p>bad";</script><aside>side</aside><form>name <input value="q"></form><div class="comments"><p>me too</p></div>
<ul><li>a<li>b</ul></article><footer>&copy; site</footer></body></html>"""


def test_article_of_a_page():
    assert html.extract(PAGE) == "Title & more One bold word Two three four a b"
    assert html.extract(None) == html.extract("") == html.extract("<nav>x</nav>") == ""
    assert html.extract("plain &lt;text&gt; <") == "plain <text> <"
    assert html.extract("<p>a<p>b" + "<div>" * 3000 + "deep") == "a b deep"


def test_templates_of_a_host_are_removed(spark):
    page = "<body><div><p>Site motto that is everywhere</p></div><div><p>Own text number {0}</p></div></body>"
    rows = [(i, f"http://a.example/{i}", page.format(i), "x") for i in range(10)] + [(90, "http://b.example/", page.format(90), "x"), (91, None, None, "x"), (92, None, "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html.main_text(pages).collect()}
    assert all(got[i] == f"Own text number {i}" for i in range(10))
    assert got[90] == "Site motto that is everywhere Own text number 90" and got[91] == got[92] == ""
    assert html.main_text(pages.limit(0)).count() == 0


def test_pipeline_stages(spark, docs, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    now = docs.select(*columns)
    item = documents()[8][1]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.materialize(stage(spark, now, str(tmp_path)), "test")
        assert now.columns == columns
        if name == "language_id":
            assert not {103, 104, 105, 106} & {r.doc_id for r in now.collect()}
    left = {r.doc_id for r in now.collect()}
    assert 1 in left and not {8, 100, 110} & left
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert set(columns) <= set(out.columns)
    rows = out.collect()
    assert {r.doc_id for r in rows} <= left and all(0 < r.taken <= 2 * r.size for r in rows)
    assert out.agg(F.sum("taken")).first()[0] <= 1.5 * now.agg(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0]
