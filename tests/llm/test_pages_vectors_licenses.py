import html
import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from mailmetrics.llm import html_extract, licenses, queries, topk

PAGE = """<html><head><title>T</title></head><body><header><h1>Site</h1><a>x</a></header>
<div id="sidebar-left"><p>Side text, long enough. Yes it is.</p></div><div class="cookie-notice">We use cookies, ok?</div>
<main><article><header><h1>Real title</h1><p class="byline">By X</p></header><p>First &amp; para &lt;b&gt; with <a href=x>link</a>, text&nbsp;here.
 more</p><script>var a="</p>";</script><ul><li>one<li>two</ul><table><tr><td>a<td>b</table><form><p>form text</p></form>
<section id="comments"><article>A reader, said. This</article></section><aside>rel</aside><!-- c --><p>Last one.</p></article></main>
<footer>f</footer></body></html>"""


def test_extracts_the_article():
    assert html_extract.extract(PAGE)[0] == "Real title\nFirst & para <b> with link, text here. more\none\ntwo\na\nb\nLast one."


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("  ", ""), ("just text &lt;b", "just text <b"), ("<p>a<p>b", "a\nb"), ("<p>x &am", "x &am"),
    ("<script>only", ""), ("<div><p>Hello, this is <b>bold</b> text.<div>next", "Hello, this is bold text.\nnext"),
    ("<article><p>One</p></article" , "One"), ("<p a='<b>'>q</p><p x=\"y>z", "q\nz"), ("< p > 1 < 2", "< p > 1 < 2")])
def test_odd_pages(page, text):
    assert html_extract.extract(page)[0] == text


def test_path_ratios_without_an_article():
    page = PAGE.replace("article>", "div>").replace("main>", "div>")
    assert "First & para" in html_extract.extract(page)[0] and "Side text" not in html_extract.extract(page)[0]


LONG = "<p>A sentence of some length, with a comma, and more words. Another one follows, as long as that.</p>"


@pytest.mark.parametrize("page,text", [
    (f"<main><h1>Title</h1><p>Lead</p><article>{LONG}</article></main>", "Title\nLead\nA sentence"),
    (f"<article><h2>One</h2>{LONG * 3}</article><article><h2>Two</h2>{LONG}</article>", "Two\nA sentence"),
    (f"<main><article><h2>One</h2>{LONG * 3}</article><article><h2>Two</h2>{LONG}</article></main>", "Two\nA sentence"),
    (f"<article><p>Hi</p></article><div><section><h2>Two</h2>{LONG * 3}</section></div>", "Two\nA sentence")])
def test_every_box_with_content_paths_is_kept(page, text):
    assert text in html_extract.extract(page)[0]


def test_paths_decide_inside_and_outside_an_article():
    links = "<ul>" + "<li><a href=x>Another page of this site</a></li>" * 4 + "</ul>"
    page = f"<div><span>Top</span></div><article><h1><a href=x>Title</a></h1>{LONG * 2}{links}<ul><li>Short</ul></article><section>{LONG * 2}</section>"
    assert html_extract.extract(page)[0].split("\n") == ["Title", *[LONG[3:-4]] * 2, "Short", *[LONG[3:-4]] * 2]


@pytest.mark.parametrize("page", [
    f'<body><div class="site has-sidebar"><article>{LONG}</article></div></body>',
    f'<body><div class="with-header no-comments"><main>{LONG}</main></div></body>',
    f'<body><div class="page no-sidebar">{LONG}</div></body>',
    f'<article><p>First.</p><section id="discussion"><h2>Discussion</h2>{LONG}</section></article>',
    f'<article>{LONG}<div class="related-work"><h2>Related work</h2>{LONG}</div></article>',
    f'<article>{LONG}<div id="notice">{LONG}</div></article>',
    f'<article><div data-id="comments" data-class="ad"><p>Short one.</p></div>{LONG}</article>',
    f'<article><p title="a class=ad b">Short one.</p>{LONG}</article>'])
def test_a_listed_word_alone_drops_nothing(page):
    seen = " ".join(re.sub("<[^>]*>", " ", page).split())
    assert " ".join(html_extract.extract(page)[0].split()) == seen


def test_listed_elements_without_ratios_of_their_own_go():
    comments = "".join(f'<div><b>Name {i}</b><div>{i} May</div><p>Nice, thank you!</p><a href=x>Reply</a></div>' for i in range(9))
    for page in (f'<article>{LONG * 3}<div id="comments">{comments}</div></article>', f'<article>{LONG * 3}</article><div id="comments">{comments}</div>',
                 f'<div class="ad">Buy now, please. Buy two.</div><article><p>Hi.</p></article>',
                 f'<article>{LONG * 3}</article><div class="related"><article><p>Teaser, short one.</p></article></div>'):
        assert "Nice" not in html_extract.extract(page)[0] and "Buy" not in html_extract.extract(page)[0] and "Teaser" not in html_extract.extract(page)[0]


def test_pages_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract_pages(df.withColumn("text", F.lit(1))).collect()}
    for r in df.collect():
        a = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ").replace("<b>", "").replace("</b>", "")
        want = "\n".join(x for x in (" ".join(html.unescape(y).split()) for y in re.split(r"</?(?:p|h1)>", a)) if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)
    odd = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", "")], "page_id long, url string, html string")
    assert sorted(r.text for r in html_extract.extract_pages(odd).collect()) == ["", "", ""]
    assert html_extract.extract_pages(odd.limit(0)).count() == 0


def scores(rows, asked, k):
    live = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    got = []
    for q in sorted({i for i, _ in live if asked(i)}):
        qv = min(v for i, v in live if i == q)
        best = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in live if i != q and len(v) == len(qv))[:k]
        got += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(got)


@pytest.mark.parametrize("bucket,block", [(7, 1000), (4096, 2)])
def test_top_k_against_brute_force(spark, monkeypatch, bucket, block):
    import random

    r = random.Random(bucket)
    monkeypatch.setattr(topk, "BUCKET", bucket)
    rows = [(i, [r.gauss(0, 1 + i % 3) for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, [0.5] * 6) for i in range(8)] + [(300, [5.0] * 6), (310, [0.0] * 6), (320, [1.0, 2.0]), (330, [2.0, 1.0])]
    rows += [(None, [1.0] * 6), (340, None), (350, [1.0, None] + [0.0] * 4), (360, [float("nan")] * 6), (370, [float("inf")] * 6), (10, [3.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, 5, query_block=block)
    assert sorted(tuple(x) for x in got.collect()) == scores(rows, lambda i: i % 10 == 0, 5)


def test_top_k_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(none, F.col("vec_id") % 50 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(one, F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("name", ["op2_licenses", "op4_topk"])
def test_sql_oracle(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    df = queries.QUERIES[name](spark, d)
    got = sorted([tuple(r) for r in df.collect()], key=str)
    res = con.execute("select " + ", ".join(df.columns) + f" from ({queries.ORACLE_SQL[name]})")
    assert got == sorted(res.fetchall(), key=str)


def test_licences(spark):
    mit = dict((n, t) for n, t in licenses.KNOWN if t.startswith("Permission is hereby"))["MIT"]
    rows = [(1, mit), (2, "The  MIT LICENCE (MIT)\n\nCopyright (c) 2020 Someone\n\n" + mit.upper().replace("SUBLICENSE", "sub-licence")),
            (3, "Text.\nreleased under the M.I.T License"), (4, "Some words.\n  * Released under the MIT licence\nLicensed under CC BY-NC 4.0."),
            (5, None), (6, ""), (7, mit + " And more."), (1, mit), (None, "Licensed under the Apache License, Version 2.0.")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, license string")
    got = sorted([(r.doc_id, r.license, r.n_license_lines, r.licenses) for r in licenses.scan_licenses(df).collect()], key=str)
    assert got == sorted([(1, "MIT", 0, "MIT"), (1, "MIT", 0, "MIT"), (2, "MIT", 0, "MIT"), (3, None, 0, ""), (4, None, 2, "CC-BY-NC-4.0,MIT"),
                          (5, None, 0, ""), (6, None, 0, ""), (7, None, 0, ""), (None, "Apache-2.0", 0, "Apache-2.0")], key=str)
    assert licenses.scan_licenses(df.limit(0)).count() == 0
    plan = licenses.scan_licenses(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_wrapped_licences(spark):
    """Every known text of several lines, wrapped anywhere, with and without notices above it; body lines that begin with "copyright" stay."""
    import textwrap

    notices = ["", "Copyright (c) 2020 A. Body\n\n", "(c) 2021 Some Body\nAll rights reserved.\n\n", "Copyright © by A. Body\n", "Copyright <year> <holders>\n\n", "COPYRIGHT 1999, 2001 X\n"]
    rows, want = [], []
    for name, text in licenses.KNOWN:
        if len(text) > 300:
            for width in range(60, 101, 4):
                wrapped = "\n\n".join(textwrap.fill(p, width, break_on_hyphens=False, break_long_words=False) for p in text.split("\n\n"))
                rows.append((len(rows), notices[len(rows) % len(notices)] + wrapped))
                want.append(name)
    assert any(line.lower().startswith("copyright notice") for _, t in rows for line in t.splitlines())
    rows += [(10**6, "Copyright law is\ncopyright holders agree\n(c) You must retain"), (10**6 + 1, "law is\nagree\nYou must retain")]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].license for i in range(len(want))] == want
    assert got[10**6].canon_sha256 != got[10**6 + 1].canon_sha256


def test_normalisation_in_few_passes(spark):
    """The texts that four regular expressions and a translation give, from fewer passes: a match or an object for every word or character fills the heap."""
    points = [c for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000]
    rows = [("".join(f"{x}{chr(c)}{y}" for c in points[i:i + 64]),) for i in range(0, len(points), 64) for x, y in (("a", "B"), ("a ", " b"), ("z,", "\u2019 Z"), ("9\n", "9"))]
    rows += [(None,), ("",), (" ",), ("\n \n",), ("A  b\n\n C ",), (" a b ",), ("a - b\u00a0-\u2014 c",), ("\U0001f600 A,\U00010400b",), ("Copyright (c) 2020 X\nIt  is,\nLICENCED",)]
    df = spark.createDataFrame(rows, "text string")
    c = F.regexp_replace(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "(?md)" + licenses.COPYRIGHT_LINE, "")
    c = F.regexp_replace(F.regexp_replace(c, licenses.PUNCTUATION, " "), r"  +", " ")
    for a, b in licenses.SPELLINGS:
        c = F.replace(c, F.lit(a), F.lit(b))
    flat = F.trim(F.regexp_replace(F.regexp_replace(c, r"\n+", " "), r"  +", " "))
    mine = licenses.canonical_lines(F.col("text"))
    got = df.select("text", mine.alias("lines"), c.alias("lines_want"), licenses.whole(mine).alias("flat"), flat.alias("flat_want")).collect()
    assert [r.text for r in got if (r.lines, r.flat) != (r.lines_want, r.flat_want)] == []
    plan = df.select(licenses.whole(mine).alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(") == 3 and "lower(text" in plan
    words = spark.range(1).select(F.regexp_count(F.lit("one two, three - four five"), F.lit(licenses.PUNCTUATION_RUN)))
    assert words.first()[0] == 2
