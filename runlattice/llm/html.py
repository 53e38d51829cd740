"""HTML main-text extraction with removal of site templates.

Element subtrees are hashed and counted per host in Spark, those inside the article apart; subtrees that recur
on many pages of their host (of distinct text: copies of a page count once) are deleted with the page's own boilerplate elements (menus, adverts,
forms, ...).  What remains of the article is cut into blocks.

An article or main element, where there is one, bounds the text.  A subtree inside it is a template only if
the articles that hold it are unlike: least hashes of their word triples (SIGNS of them) must differ on many
pages and on at least half of those with differing text, so that what near copies of one article share stays.
Pages without one lose templates anywhere.  Null html is an empty page; repeated rows give repeated results; null url is a host of
its own; an empty table gives an empty result; other columns of the caller pass through unchanged.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlattice.functions.storage import materialize
from runlattice.llm.common import batches, free, table

#: A subtree is a template when it is on this many pages of its host whose texts differ, however many pages the host has.
MIN_PAGES = 5
#: Least hashes of a text, by which near copies are told from other articles.
SIGNS = 4

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>",
    re.S,
)
ATTR = re.compile(r"""(?<![\w.:-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROP = {
    "script", "style", "noscript", "template", "nav", "footer", "aside", "form", "button", "select", "option", "textarea",
    "input", "iframe", "svg", "canvas", "audio", "video", "object", "head", "title", "dialog", "menu", "map", "noembed", "noframes",
}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend",
    "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
HASHED = {"div", "section", "nav", "header", "footer", "aside", "ul", "ol", "dl", "table", "form", "p", "h1", "h2", "h3", "h4", "blockquote", "figure"}
#: Words of class, id or role that mark boilerplate.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices"
    " popup modal overlay newsletter subscribe subscription signup nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer"
    " comment comments reply replies respond disqus share sharing social related recommended widget toolbar pagination pager"
    " contentinfo complementary search searchbox masthead topbar".split()
)
#: What a start tag closes when it is open.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"ul", "ol", "dl", "table", "select", "tbody", "thead"}


def _marked(tag: str, attrs: str) -> bool:
    for m in ATTR.finditer(attrs):
        value = (m[2] or m[3] or m[4] or "").lower()
        if any(x in MARKS for x in re.split(r"[^a-z0-9]+", value)):
            return True
    return False


def parse(text: str) -> tuple[list, list]:
    """(pieces, elements) of a page.

    A piece is (element, text) in page order, text None at the edge of a block; an element is
    [tag, parent, start, end, boilerplate].
    """
    elements: list = [["#root", -1, 0, len(text), False]]
    stack = [0]
    pieces: list = []
    at = 0
    n = len(text)

    def close(k: int, end: int) -> None:
        while len(stack) > k:
            e = elements[stack.pop()]
            e[3] = end
            if e[0] in BLOCK:
                pieces.append((stack[-1], None))

    while at < n:
        m = TOKEN.search(text, at)
        if not m:
            pieces.append((stack[-1], text[at:]))
            break
        if m.start() > at:
            pieces.append((stack[-1], text[at : m.start()]))
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if elements[stack[k]][0] == tag:
                    close(k, at)
                    break
            continue
        attrs = m[3] or m[6] or ""
        if tag in BLOCK and tag != "br":
            for k in range(len(stack) - 1, 0, -1):
                t = elements[stack[k]][0]
                if t == "p":
                    close(k, m.start())
                    break
                if t in BLOCK:
                    break
        if tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                t = elements[stack[k]][0]
                if t in CLOSES[tag]:
                    close(k, m.start())
                    break
                if t in STOPS:
                    break
        if tag in BLOCK:
            pieces.append((stack[-1], None))
        parent = stack[-1]
        drop = tag in DROP or (tag not in ("html", "body", "article", "main") and bool(attrs) and _marked(tag, attrs))
        drop = drop or (tag == "header" and not any(elements[k][0] in ("article", "main") for k in stack))
        drop = drop or (tag == "article" and bool(attrs) and bool(re.search(r"\b(comment|reply)", attrs, re.I)))
        elements.append([tag, parent, m.start(), n, drop])
        if tag in VOID or attrs.endswith("/") and tag in ("svg", "path"):
            elements[-1][3] = at
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(text, at)
            elements[-1][3] = at = end.end() if end else n
            continue
        stack.append(len(elements) - 1)
    close(1, n)
    return pieces, elements


def _roots(elements: list) -> tuple[list[bool], list[bool], bool]:
    """For each element: is it in the main part, is it in boilerplate; and whether a main part is marked."""
    dropped = [False] * len(elements)
    for k, e in enumerate(elements):
        dropped[k] = e[4] or (k > 0 and dropped[e[1]])
    found = []
    for wanted in ("article", "main"):
        inside = [False] * len(elements)
        for k, e in enumerate(elements):
            inside[k] = not dropped[k] and (e[0] == wanted or k > 0 and inside[e[1]])
        if any(inside):
            found.append((sum(e[3] - e[2] for k, e in enumerate(elements) if inside[k] and (k == 0 or not inside[e[1]])), inside))
    if not found:
        return [True] * len(elements), dropped, False
    # articles that are less than half of a main are teasers within it
    return (found[1] if len(found) == 2 and 2 * found[0][0] < found[1][0] else found[0])[1], dropped, True


def _signs(text: str) -> list[int]:
    """SIGNS least hashes of the word triples of a text."""
    words = text.split()
    triples = {" ".join(words[i : i + 3]).encode("utf-8", "surrogatepass") for i in range(max(1, len(words) - 2))}
    return [min(xxhash.xxh3_64_intdigest(t, k) for t in triples) - (1 << 63) for k in range(SIGNS)]


def subtrees(text: str | None) -> tuple[list[int], list[int], int, list[int]]:
    """Distinct hashes of the element subtrees of a page that may be templates, outside of and inside the article;
    the hash of its main text and the signs of it."""
    if not text:
        return [], [], 0, []
    pieces, elements = parse(text)
    inside, dropped, marked = _roots(elements)
    main = _joined(text, pieces, elements, inside, dropped, marked)
    holds = {0}
    if marked:  # what holds the article is no template
        for k in range(len(elements) - 1, 0, -1):
            if inside[k] or k in holds:
                holds.add(elements[k][1])
    found = {
        _hash(text, e)
        for k, e in enumerate(elements)
        if e[0] in HASHED and k not in holds and not (marked and inside[k])
    }
    within = {_hash(text, e, True) for k, e in enumerate(elements) if marked and inside[k] and e[0] in HASHED}
    return sorted(found), sorted(within), _text_hash(main), _signs(main) if within else []


def _text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _hash(text: str, e: list, within: bool = False) -> int:
    """Of a subtree; inside of an article and outside it the same text has different hashes."""
    return _text_hash(" ".join(text[e[2] : e[3]].split()) + "\0" * within)


def extract(text: str | None, templates=frozenset()) -> str:
    """Main text of a page without the subtrees whose hashes are in ``templates``."""
    if not text:
        return ""
    pieces, elements = parse(text)
    inside, dropped, marked = _roots(elements)
    return _joined(text, pieces, elements, inside, dropped, marked, templates)


def _joined(text: str, pieces: list, elements: list, inside: list, dropped: list, marked: bool, templates=frozenset()) -> str:
    if templates:
        for k, e in enumerate(elements):
            dropped[k] = dropped[k] or (k > 0 and dropped[e[1]])
            if not dropped[k] and e[0] in HASHED and _hash(text, e, marked and inside[k]) in templates:
                dropped[k] = True
    blocks, now = [], []
    for k, piece in pieces:
        if piece is None:
            if now:
                blocks.append(" ".join("".join(now).split()))
                now = []
        elif inside[k] and not dropped[k]:
            now.append(entities.unescape(piece) if "&" in piece else piece)
    blocks.append(" ".join("".join(now).split()))
    return " ".join(b for b in blocks if b)


def with_host(pages: DataFrame, host_name: str = "_host", key: str = "_key") -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return pages.withColumns({host_name: host, key: F.xxhash64("url", "html")})


def page_subtrees(pages: DataFrame) -> DataFrame:
    """(_key, _host, h, body, signs): the subtrees of each page, body the hash of its main text; signs inside an article only."""

    def run(it):
        for batch in batches(it, 500):
            keys, hosts, hs, bodies, signs = [], [], [], [], []
            for key, host, page in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found, within, body, sign = subtrees(page)
                n = len(found) + len(within)
                keys += [key] * n
                hosts += [host] * n
                hs += found + within
                bodies += [body] * n
                signs += [None] * len(found) + [sign] * len(within)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, t) for c, t in ((keys, pa.int64()), (hosts, pa.string()), (hs, pa.int64()), (bodies, pa.int64()), (signs, pa.list_(pa.int64()))))],
                ["_key", "_host", "h", "body", "signs"],
            )

    return pages.select("_key", "_host", "html").mapInArrow(run, "_key long, _host string, h long, body long, signs array<long>")


def site_templates(subtree_rows: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(_host, h) of subtrees on many pages of their host whose texts differ; inside articles, whose texts are unlike."""
    distinct = subtree_rows.select("_host", "h", "body").distinct()
    counted = distinct.groupBy("_host", "h").agg(F.count(F.lit(1)).alias("_n"))
    counted = materialize(counted.where(F.col("_n") >= min_pages), "html-counted")
    within = subtree_rows.where("signs is not null").join(counted, ["_host", "h"])
    each = within.select("_host", "h", "_n", F.posexplode("signs").alias("_k", "_sign")).distinct()
    unlike = each.groupBy("_host", "h", "_n", "_k").agg(F.count(F.lit(1)).alias("_u"))
    unlike = unlike.where((F.col("_u") >= min_pages) & (2 * F.col("_u") >= F.col("_n"))).select("_host", "h").distinct()
    outside = counted.join(subtree_rows.where("signs is not null").select("_host", "h").distinct(), ["_host", "h"], "left_anti")
    return outside.select("_host", "h").unionByName(unlike)


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` (url, html, ...) with text."""
    rest = pages.drop("text")
    key, host, h = free(rest, "key", "host", "h")
    keyed = with_host(rest, host, key)
    rows = materialize(page_subtrees(keyed.select(F.col(key).alias("_key"), F.col(host).alias("_host"), "html")), "html-subtrees")
    found = site_templates(rows, min_pages)
    own = rows.join(found, ["_host", "h"]).groupBy("_key").agg(F.collect_set("h").alias(h))  # of one page
    joined = keyed.join(own.withColumnRenamed("_key", key), key, "left").drop(key, host)
    at, hs = joined.columns.index("html"), joined.columns.index(h)
    keep = [i for i, c in enumerate(joined.columns) if c != h]
    names = [*(joined.columns[i] for i in keep), "text"]

    def run(it):
        for batch in batches(it, 500):
            texts = [
                extract(page, frozenset(h or ())) for page, h in zip(batch.column(at).to_pylist(), batch.column(hs).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(texts, pa.string())], names)

    return joined.mapInArrow(run, joined.drop(h).schema.add("text", "string"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
