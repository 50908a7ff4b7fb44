"""Wrappers of hosts and the main text: against a naive reader of the tables' own pages, other templates, odd pages."""

import html
import json
import os
import random
import re

import pytest

from strandline.llm import markup, op11_html

DIR = "/root/testdata/sf0.01"
SCHEMA = "page_id long, url string, html string, host string, wrapper int"


def words(r, n):
    return " ".join(r.choice("alpha beta gamma delta rho tau".split()) for _ in range(n))


def named_parts(r, k):
    """A page with an article element and all that is to go, and its main text."""
    lines, body = [f"Title {k}"], f"<header><h1>Title {k}</h1></header>"
    for _ in range(r.randint(1, 3)):
        head, paragraphs = words(r, 2), [words(r, 9) for _ in range(r.randint(1, 3))]
        body += f"<h2>{head}</h2>" + "".join(f"<p>{p} <b>a &amp;\n b</b>" for p in paragraphs)
        lines += [head, *(f"{p} a & b" for p in paragraphs)]
        if r.random() < 0.5:
            body += f'<div class="advert">{words(r, 9)}</div>'
    return f"""<!doctype html><head><title>no</title><style>p{{}}</style><script>var a = "<p>no</p>";</script></head><body><header>Site<nav><ul><li><a href=/>Home<li><a href=/x>News</ul></nav></header>
      <div class="cookie-notice">We use cookies</div><main><article>{body}<form><label>mail</label><button>Go</button></form><aside>more</aside></article>
      <section id="comments"><article class="comment"><p>{words(r, 60)}</article></section></main><!-- <p>no</p> --><div hidden>no</div><footer>&copy; no</footer>""", "\n".join(lines)


def plain_parts(r, k):
    """A page without any telling element or name: lists of links and texts of the template go, as the host's pages show."""
    paragraphs = [words(r, 12) for _ in range(r.randint(2, 5))]
    links = "".join(f"<li><a href=/{j}>{words(r, 3)}</a></li>" for j in range(r.randint(2, 6)))
    lost = f"<div class=x4>{words(r, 4)}</div>" if k % 2 else ""
    page = f"<body><div class=x1>The Daily</div><div class=x2><h1>T {k}</h1>{''.join(f'<p>{p}</p>' for p in paragraphs)}{lost}</div><div class=x3><ul>{links}</ul></div><div class=x5>All of this is ours</div></body>"
    return page, "\n".join([f"T {k}", *paragraphs, *([re.sub("<.*?>", "", lost)] if lost else [])])


@pytest.mark.parametrize("fan", [1, 32])
def test_main_text_of_templates(spark, fan):
    r = random.Random(3)
    rows, want = [], {}
    for k in range(60):
        page, text = (named_parts if k % 3 else plain_parts)(r, k)
        rows.append((k, f"https://user@{'A.Example' if k % 3 else 'b.example'}:80/{k}", page, "odd", 5))
        want[k] = text
    got = {x.page_id: x.text for x in op11_html.extract_text(spark.createDataFrame(rows, SCHEMA).repartition(7), fan=fan).collect()}
    assert got == want


def test_wrapper_reads_as_an_expression(spark):
    pages = [("https://a/1", "<p>x</p><ul><li>1<li>2</ul>"), ("https://a/2", "<p>y</p><div class=n>z</div><ul><li>3</ul>"), ("https://b/", "<h2>a</h2><p>b<p>c<h2>d</h2><p>e")]
    got = {x.host: x.pattern for x in op11_html.infer_wrappers(spark.createDataFrame(pages, "url string, html string")).collect()}
    assert got == {"a": "<p>#</p>(<div.n>#</div>)?<ul>(<li>#</li>)+</ul>", "b": "(<h2>#</h2>(<p>#</p>)+)+"}


def test_alignment():
    a, b, c = ([x, 0, [[markup.SLOT, 0, [1, 1, 1, 1, 0]]]] for x in ("a", "b", "c"))
    keys = lambda items: [(x[0], x[1]) for x in items]
    assert keys(markup.aligned([a, c], [a, b, c])) == [("a", 0), ("b", markup.OPTIONAL), ("c", 0)]
    assert keys(markup.folded([a, b, a, b, a, b, c])) == [("(a b)", markup.REPEATED), ("c", 0)]
    assert keys(markup.aligned(markup.folded([a, b, a, b]), [a, b, c])) == [("(a b)", markup.REPEATED), ("c", markup.OPTIONAL)]
    one = markup.aligned([a], [[a[0], 0, [[markup.SLOT, 0, [1, 5, 5, 2, 2]]]]])
    assert one[0][2][0][2] == [2, 1, 5, 3, 2]


def test_expressions_do_not_depend_on_partitions(spark):
    r = random.Random(4)
    rows = [(k, "http://x/", named_parts(r, k)[0], "", 0) for k in range(80)]
    found = []
    for parts in (1, 9):
        frame = spark.createDataFrame(rows, SCHEMA).repartition(parts).select("html", op11_html.host_of(op11_html.F.col("url")).alias("host"))
        found.append(op11_html.expressions(frame, fan=2).collect())
    assert found[0] == found[1] and len(found[0]) == 1
    assert max(s[2][0] for s in markup.slots(json.loads(found[0][0].expression))) >= 80


def test_odd_pages(spark):
    deep = "<div>" * 5000 + "bottom" + "</div>" * 5000
    rows = [
        (1, None, None, None, None), (2, "", "", "", 0), (3, "not a url", "no markup &lt;b&gt; at\x0b all", "", 0), (3, "not a url", "no markup &lt;b&gt; at\x0b all", "", 0), (None, "http://h/", "<p>null id", "", 0),
        (4, "http://deep/", deep, "", 0), (5, "http://cut/", "<article><p>begun <a href='x", "", 0), (6, "http://raw/", "<script>never closed <p>x</p>", "", 0),
        (7, "http://stray/", "</p></div><p>a</p></ul>b<hr>c< d <3", "", 0), (8, "http://long/", "<article>" + "<p>word</p>" * 20_000 + "</article>", "", 0), (9, "http://one/", "<article><p>only</p><p>page</p></article>", "", 0),
    ]
    got = {}
    for x in op11_html.extract_text(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(x.page_id, []).append(x.text)
    assert got == {
        1: [""], 2: [""], 3: ["no markup <b> at all"] * 2, None: ["null id"], 4: ["bottom"], 5: ["begun"], 6: [""], 7: ["a\nb\nc< d <3"], 8: ["\n".join(["word"] * 20_000)], 9: ["only\npage"],
    }
    empty = spark.createDataFrame([], SCHEMA)
    assert op11_html.extract_text(empty).count() == 0


def test_equal_pages_keep_their_text(spark):
    rows = [(k, "http://same/", "<div><p>one text</p><p>of all</p></div>", "", 0) for k in range(9)]
    assert {x.text for x in op11_html.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()} == {"one text\nof all"}


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables aren't here")
def test_all_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    want = {}
    for p in pages.collect():
        article = p.html.split("<article>")[1].split("</article>")[0]
        lines = (" ".join(html.unescape(re.sub("<[^>]*>", " " if x == "<br>" else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        want[p.page_id] = "\n".join(x for x in lines if x)
    got = op11_html.op11_html(spark, DIR).collect()
    assert {x.page_id: x.text for x in got} == want and all(x.n_chars == len(x.text) for x in got)
