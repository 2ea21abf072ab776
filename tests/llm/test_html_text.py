"""Rendered pages against written-out results."""

import random
import re

import pytest

from surveyloom.llm import html_text as H


@pytest.mark.parametrize("html,want", [
    (None, ""), ("", ""), ("<p>a<p>b", "a\n\nb"), ("<div>a</div><div>b &amp; c</div>", "a\nb & c"), ("x<br>y", "x\ny"),
    ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>", "- a\n- b\n\n  3. c\n  4. d"),
    ("<table><tr><th>ab<th>c<tr><td>1<td>22</table>z", "ab  c\n1   22\n\nz"),
    ("<head><title>t</title></head><body>s<script>no()</script><i hidden>no</i><b style='display: none'>no</b>een", "seen"),
    ("<pre>a\n  b</pre>c", "a\n  b\n\nc"), ("</p></x>plain", "plain"), ("<b>un<i>closed", "unclosed"),
    ("a<![if x]>b<![endif]>c", "abc"), ("a<![unknown[x]]>b", "ab"), ("a<![unknown[", "a"), ("a<![CDATA[x]]>b", "ab"),
    ("a<!-- x <p>b", "a"), ("a<!--x--!>b", "ab"), ("a<!-->b<!--->c<!-- - -- -->d", "abcd"),
])
def test_layout(html, want):
    assert H.visible_text(html) == want


@pytest.mark.parametrize("html,want", [
    ("<table><tr><td colspan=2>ab<td>c<tr><td>1<td>2<td>3</table>", "ab    c\n1  2  3"),
    ("<table><tr><td rowspan=2>ab<td>c<tr><td>d<tr><td>e<td>f</table>", "ab  c\n    d\ne   f"),
    ("<table><tr><td colspan=2>a long one<td>c<tr><td>1<td>2<td>3</table>", "a long one  c\n1  2        3"),
    ("<table><tr><td rowspan=0>x<td>y<tr><td>z<tr><td>w</table>", "x  y\n   z\n   w"),
    ("<table><tr><td colspan=x rowspan=-1>a<td>b</table>", "a  b"),
    ("<pre><div>a\n   b</div></pre>", "a\n   b"), ("<pre>x <b>y\n  z</b></pre>", "x y\n  z"),
    ("<div style='visibility:hidden'>a<b style='visibility: visible'>b</b>c</div>d", "b\nd"),
    ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
    ("<details>no<summary>s</summary>no<p>no<summary>no</summary></details><details open><summary>t</summary>u</details>", "s\nt\nu"),
    ("<select><option>a<option>b</select><button>c</button><button>d</button>", "a b c d"),
    ("<table>" + "<tr><td colspan=1000>a<td colspan=1000>b" * 3 + "</table>", "a  b\na  b\na  b"),
])
def test_spans_visibility_and_spacing(html, want):
    assert H.visible_text(html) == want


def cells_of(rows):
    """Text of every grid place, by walking the grid place by place."""
    grid = {}
    for y, row in enumerate(rows):
        x = 0
        for text, columns, down in row:
            while (y, x) in grid:
                x += 1
            for k in range(columns):
                for d in range(down):
                    grid.setdefault((y + d, x + k), (y, x, text))
            x += columns
    return grid


def test_columns_are_aligned_on_random_tables():
    rng = random.Random(3)
    for _ in range(300):
        rows = [[("x" * rng.randrange(1, 6), rng.choice([1, 1, 2, 3]), rng.choice([1, 1, 2])) for _ in range(rng.randrange(1, 5))]
                for _ in range(rng.randrange(1, 6))]
        html = "<table>" + "".join("<tr>" + "".join(f"<td colspan={c} rowspan={d}>{t}" for t, c, d in row) for row in rows) + "</table>"
        lines = H.visible_text(html).split("\n")
        begins = {}  # column → the place where its cells begin
        for y, row in enumerate(rows):
            own = sorted(x for (a, b), (ty, tx, _) in cells_of(rows).items() if (ty, tx) == (a, b) and a == y for x in [b])
            at = [m.start() for m in re.finditer("x+", lines[y])]
            assert len(at) == len(row) == len(own)
            for x, place in zip(own, at):
                assert begins.setdefault(x, place) == place, html


def test_deep_and_long_pages():
    assert H.visible_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert H.visible_text("<p>word</p>" * 20000).count("word") == 20000


def test_table(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "<p>a", "y")]
    got = H.extract(spark.createDataFrame(rows, "page_id bigint, html string, text string")).collect()
    assert sorted((r["page_id"] or 0, r["text"]) for r in got) == [(0, "a"), (1, ""), (1, "")]
    assert H.extract(spark.createDataFrame([], "page_id bigint, html string")).count() == 0
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = H.extract(pages).collect()
    assert len(got) == pages.count() and sum(bool(r["text"]) for r in got) > 0.9 * len(got)


@pytest.mark.parametrize("tag", ["b", "font", "span", "div", "p><b"])
def test_what_is_hidden_stays_hidden_at_any_depth(tag):
    deep = f"<{tag}>" * 20_000
    assert H.visible_text(deep + "a<script>no()</script><style>no</style><i hidden>no</i><u style='display:none'>no<b>no</b></u>z") == "az"
    rows = "<table><tr><td>ab<td>c<tr><td>1<td>22</table><ul><li>x<li>y</ul>"
    assert H.visible_text(deep + rows) == "ab  c\n1   22\n\n- x\n- y"
