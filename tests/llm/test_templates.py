from runlattice.llm import html

COLUMNS = "page_id long, url string, html string"


def texts(spark, rows):
    return {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, COLUMNS)).collect()}


def test_copies_of_a_page_are_one_page(spark):
    copy = "<body><div><p>A page that was crawled again and again</p></div></body>"
    rows = [(i, f"http://a.example/{i % 3}", copy) for i in range(6)] + [(9, "http://a.example/9", "<p>Another</p>")]
    assert texts(spark, rows) == {i: "A page that was crawled again and again" for i in range(6)} | {9: "Another"}


def test_templates_of_a_section_are_removed_from_a_large_host(spark):
    page = "<body><div><p>Links of this section</p></div><div><p>Own text {0}</p></div></body>"
    rows = [(i, f"http://a.example/{i}", page.format(i)) for i in range(6)]
    rows += [(i, f"http://a.example/{i}", f"<body><p>Page {i} of another section</p></body>") for i in range(6, 60)]
    got = texts(spark, rows)
    assert all(got[i] == (f"Own text {i}" if i < 6 else f"Page {i} of another section") for i in range(60))


def articles(n, body):
    page = "<html><body><article><h1>Title {0}</h1><div><p>Get our letter every week</p></div>{1}</article></body></html>"
    return [(i, f"http://a.example/{i}", page.format(i, body(i))) for i in range(n)]


def test_an_unmarked_block_of_many_articles_is_removed(spark):
    rows = articles(12, lambda i: "".join(f"<p>Word{i} and {k} more of article {i * 7 + k}</p>" for k in range(9)))
    got = texts(spark, rows)
    assert not any("letter" in x for x in got.values())
    assert all(f"Title {i}" in got[i] and f"Word{i} and 8 more" in got[i] for i in range(12))
    few = texts(spark, rows[:4])
    assert all("letter" in x for x in few.values())


def test_near_copies_of_an_article_keep_their_text(spark):
    prose = "".join(f"<p>Sentence {k} of the article that stands on several pages</p>" for k in range(30))
    got = texts(spark, articles(9, lambda i: prose + f"<p>Seen {i}</p>"))
    assert all("Sentence 0 of" in x and "Sentence 29 of" in x for x in got.values())
