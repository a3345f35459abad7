import re
from html.parser import HTMLParser

import pytest

from lamplight.llm.html_text import html_text, render

CASES = [
    ("<p>a<p>b", "a\n\nb"),
    ("<ul><li>x<li>y<ol><li>1<li>2</ol></ul>", "- x\n- y\n  1. 1\n  2. 2"),
    ("<table><tr><th>Name<th>Q<tr><td>long name<td>3</table>", "Name       Q\nlong name  3"),
    ("<table><tr><td>a<td colspan=2>bbbb<tr><td>ccc<td>d<td>e</table>", "a    bbbb\nccc  d  e"),
    ("a<div hidden>no</div><span style='display:none'>no</span><i style=\"visibility: hidden\">no</i>b", "ab"),
    ("<head><title>t</title></head><body>x<script>if (a < b) {}</script><style>p{}</style>y", "xy"),
    ("<pre>\na  b\n c</pre>", "a  b\n c"),
    ("a &amp; b &lt;i&gt; &copy;", "a & b <i> ©"),
    ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    ("a<br>b<br/>c", "a\nb\nc"),
    ("<!-- x --><![CDATA[y]]>z<!doctype html>", "z"),
    ("<p>one</i></div> two", "one two"),
    ("<dl><dt>term<dd>what it is</dl>", "term\n  what it is"),
    ("<ol start=3><li>c<li value=9>i<li>j</ol>", "3. c\n9. i\n10. j"),
    ("<a title='x > y' href=\"?a=1&b\">k</a>", "k"),
    ("<input type=text value=v><textarea>q <b></textarea>", "q <b>"),
    ("", ""), (None, ""), ("   \n ", ""), ("<", "<"), ("<a href=\"", ""), ("</p>", ""),
    ("x<select><option>a<option>b</select>", "x\na\nb"),
    ("<h1>T</h1>text<hr>more", "T\n\ntext\n\nmore"),
    ("<table><tr><td>a<table><tr><td>in</table><td>b</table>", "a   b\n\nin" ),
    ("<svg><text>no</text></svg><noscript>no</noscript>yes", "yes"),
]


@pytest.mark.parametrize(("source", "want"), CASES)
def test_render(source, want):
    assert render(source) == want


class Plain(HTMLParser):
    """All visible words, by a parser of its own, for pages without hidden elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title", "head")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title", "head")

    def handle_data(self, data):
        if not self.skip:
            self.words += data.split()


def test_all_visible_words_of_the_pages(spark):
    import os

    path = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("the tables are not here")
    pages = spark.read.parquet(path)
    texts = {r.page_id: r.text for r in html_text(pages).collect()}
    for r in pages.collect():
        p = Plain()
        p.feed(r.html)
        glued = lambda ws: re.sub(r"\s+", "", "".join(ws))
        got = re.sub(r"(?m)^(?:\s*(?:- |\d+\. ))+", "", texts[r.page_id])
        assert glued(got.split()) == glued(p.words), r.page_id


def test_deep_long_and_repeated(spark):
    assert render("<div>" * 20_000 + "x") == "x"
    assert render("<p>w " * 20_000).count("w") == 20_000
    rows = [(1, "<p>a"), (1, "<p>a"), (None, "<b>b"), (2, None), (3, ""), (4, "<td>x" * 500)]
    df = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "'own' as text", "'own' as n_chars")
    got = [tuple(r) for r in html_text(df).collect()]
    assert (1, "a", 1) in got and (None, "b", 1) in got and (2, "", 0) in got and (3, "", 0) in got and len(got) == 6
    assert html_text(df.limit(0)).count() == 0


@pytest.mark.parametrize(("source", "want"), [
    ("a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> b", "a x=2 b"),
    ("<dialog open>yes</dialog><dialog>no</dialog><dialog data-open='open'>no</dialog>", "yes"),
    ("<button><svg/>Save</button><p>rest", "Save\n\nrest"),
    ("<svg viewBox='0 0 1 1' /><math/>rest", "rest"),
    ("<svg><title/><style/><path d='M/'/></svg>rest", "rest"),
    ("<svg><g href=a/>no</svg>rest", "rest"),
    ("<div/>a<math><mtext><b/>c</mtext></math>", "ac"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
    ("<table><tr><td>a<td rowspan=3 colspan=2>b<td>c<tr><td>d<td>e<tr></tr><tr><td>f<td>g</table>", "a  b    c\nd       e\nf  g"),
    ("<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
])
def test_foreign_elements_dialogs_and_rowspan(source, want):
    assert render(source) == want


@pytest.mark.parametrize(("source", "want"), [
    ('<div style="visibility:hidden">no<b style="visibility: visible">yes</b>no</div>', "yes"),
    ('<div style="display:none">no<b style="visibility:visible">no</b></div>yes', "yes"),
    ("<table><tr><td rowspan=2>A<td>b1<tr><td>b2</table>", "A  b1\n   b2"),
    ("<ul style='visibility:hidden'><li>no<li style='visibility:visible'>x</ul>", "- x"),
    ("<p>a<span><table><tr><td>b<p>c</table>d", "a\n\nb\n\nc\n\nd"),
])
def test_visibility_and_spans(source, want):
    assert render(source) == want


@pytest.mark.parametrize("tag", ["<div>", "<ul><li>x", "<p>", "<table><tr><td>x", "<blockquote>y", "<li>", "<math><mi>", "<p><table><td><div>"])
def test_time_grows_in_proportion(tag):
    import time

    def seconds(n):
        began = time.perf_counter()
        assert render(tag * n + "z").rstrip().endswith("z")
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(40_000) < 12 * max(seconds(10_000), 0.05)


def grid(rows):
    """Columns of each cell by the table model of HTML, cell by cell on a grid of taken places."""
    taken, out = {}, []
    for r, cells in enumerate(rows):
        c, line = 0, []
        for text, across, down in cells:
            while (r, c) in taken:
                c += 1
            line.append((text, c))
            taken.update({(r + i, c + j): 1 for i in range(down) for j in range(across)})
            c += across
        out.append(line)
    return out


def test_tables_equal_a_plain_grid():
    import random

    rng = random.Random(6)
    for _ in range(200):
        rows = [[("x" * rng.randint(1, 5), rng.choice([1, 1, 1, 2]), rng.choice([1, 1, 1, 2, 3])) for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 5))]
        placed = grid(rows)
        width = {}
        for cells, line in zip(rows, placed, strict=True):
            for (text, across, _), (_, c) in zip(cells, line, strict=True):
                if across == 1:
                    width[c] = max(width.get(c, 0), len(text))
        want = []
        for line in placed:
            s = ""
            for text, c in line:
                s = s.ljust(2 * c + sum(w for k, w in width.items() if k < c)) + text
            want.append(s.rstrip())
        source = "<table>" + "".join("<tr>" + "".join(f"<td colspan={a} rowspan={d}>{t}" for t, a, d in cells) for cells in rows) + "</table>"
        assert render(source) == "\n".join(want)


@pytest.mark.parametrize("cell", ["<td rowspan=0>", "<td rowspan=60000>", "<td rowspan=9>x<td rowspan=3>"])
def test_many_spanning_rows(cell):
    """Rows whose cells reach down take time in proportion, be they ever so many."""
    import time

    def seconds(n):
        began = time.process_time()
        render("<table>" + f"<tr>{cell}" * n + "</table>")
        return time.process_time() - began

    seconds(500)
    assert seconds(16_000) < 6 * max(seconds(4000), 0.05)
