import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ridgeline.llm.html_layout import extract, parse, render

CASES = {
    "paragraphs end themselves": ("<p>One<p>Two <b>bold</b>\n  x<br>y", "One\n\nTwo bold x\ny"),
    "lists": ("<ul><li>a<li>b<ol start=3><li>c<li value=9>d<li>e</ol><li>f</ul>", "- a\n- b\n  3. c\n  9. d\n  10. e\n- f"),
    "tables align": ("<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td>x<td>22</table>", "Name       N\nlong name  1\nx          22"),
    "cells with lines and spans": ("<table><tr><td>a<br>b<td>c<tr><td colspan=2>wide one<tr><td>d<td>e</table>", "a         c\nb\nwide one\nd         e"),
    "cells over rows": ("<table><tr><td rowspan=2>A<td>b1<tr><td>b2<tr><td>c<td>d</table>", "A  b1\n   b2\nc  d"),
    "a cell over rows ends with its section": ("<table><tbody><tr><td rowspan=0>A<td>b<tr><td>c<tbody><tr><td>d<td>e</table>", "A  b\n   c\nd  e"),
    "reversed lists": ("<ol reversed><li>a<li>b<li hidden>x<li>c</ol><ol reversed start=5><li>d<li value=9>e<li>f</ol>", "3. a\n2. b\n1. c\n\n5. d\n9. e\n8. f"),
    "nested tables": ("<table><tr><td><table><tr><td>1<td>2</table><td>out</table>", "1  2  out"),
    "wide letters": ("<table><tr><td>日本<td>x<tr><td>abc<td>y</table>", "日本  x\nabc   y"),
    "caption": ("<table><caption>C</caption><tr><td>a<td>b</table>", "C\na  b"),
    "hidden": ("<div hidden>x</div><p style='display : none'>x</p><i style=visibility:hidden>x<b style=visibility:visible>seen</b></i>", "seen"),
    "style sheet": ("<style>.no, #gone {display:none}</style><p class='a no'>x<p id=gone>x<p class=a>seen", "seen"),
    "scripts and comments": ("a<script>var x='</p><b>';</script><!-- <b>no --><style>p{}</style>b<template>x</template>", "ab"),
    "title is not in the page": ("<head><title>T</title></head><body>text", "text"),
    "head without end": ("<html><head><meta charset=utf-8><title>T</title><p>text", "text"),
    "entities": ("&lt;b&gt; &amp; &copy &nbsp;| 3 < 4 &am", "<b> & © \xa0| 3 < 4 &am"),
    "quotes in attributes": ("<a title=\"it's > ok\">link</a> <p title=it's>next", "link\n\nnext"),
    "preformatted": ("x<pre>a\n   b\n\nc</pre>y", "x\n\na\n   b\n\nc\n\ny"),
    "quotation": ("<blockquote>one<p>two</blockquote>", "> one\n\n> two"),
    "details": ("<details><summary>S</summary>no</details><details open><summary>T</summary>yes</details>", "S\nT\nyes"),
    "definition list": ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n    d\nu\n    e"),
    "inline words stay together": ("<b>a</b><i>b</i> c<span> d</span>", "ab c d"),
    "text in tables without cells": ("<table>loose<tr><td>a</table>", "loose\na"),
    "select and button": ("<select><option>a<option>b</select><button>ok</button>", "a\nb\nok"),
    "unclosed": ("<div><p>a<b>b", "ab"),
    "plain": ("just text", "just text"),
    "broken": ("< b <<p>x</ p> <3", "< b <\n\nx <3"),
}


@pytest.mark.parametrize("name", CASES)
def test_layout(name):
    html, text = CASES[name]
    assert render(html) == text


def test_edges():
    assert render(None) == render("") == render(" \n ") == render("<p></p>") == render("<!-- never closed") == ""
    assert render("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert render("<p>word " * 50_000).count("word") == 50_000
    assert render("<a " + "x=1 " * 50_000 + ">t") == "t"
    assert render('<a href="' + "x" * 100_000 + "t").strip() != None  # noqa: E711  an attribute that never ends
    assert render("<" * 50_000) == "<" * 50_000
    for part in ("</", "<a ", "<!", "<a '", '<a x="', "<title>", "<!--x", "<![CDATA[", "&", "<a b=<", "<table>", "<ul><li>", "a </p>"):
        render(part * 100_000)  # in linear time


def test_no_visible_text_is_lost():
    words = [f"w{k}" for k in range(200)]
    tags = "p div li td tr table ul b h1 dd section blockquote pre option tbody a".split()
    import random

    for seed in range(60):
        rng, html = random.Random(seed), ""
        for w in words:
            html += rng.choice([f"<{rng.choice(tags)}>", f"</{rng.choice(tags)}>", ""]) + w + " "
        assert sorted(render(html).replace("-", " ").replace(">", " ").split()) == sorted(words), seed


def test_spark(spark):
    df = spark.createDataFrame([(1, "<p>a"), (2, None), (3, ""), (1, "<p>a")], "page_id long, html string").selectExpr("*", "'old' AS visible_text")
    assert sorted((r["page_id"], r["visible_text"]) for r in extract(df).collect()) == [(1, "a"), (1, "a"), (2, ""), (3, "")]
    assert extract(df.limit(0)).count() == 0


def test_tree_of_implied_tags():
    table = parse("<table><td>a<td>b<tr><td>c").children[0]
    assert [[c.tag for c in row.children] for row in table.children] == [["td", "td"], ["td"]]


SHEETS = {
    "print": ("@media print{.c{display:none}}", True),
    "print among others": ("p{margin:0}@media print { p{color:red} .c , .d {display:none} } .x{display:none}", True),
    "narrow screen": ("@media (max-width:600px){.c{display:none}}", True),
    "narrow screen in em": ("@media only screen and (max-width: 40em){.c{display:none}}", True),
    "wide screen": ("@media screen and (min-width:600px){.c{display:none}}", False),
    "screen or print": ("@media print, screen{.c{display:none}}", False),
    "not print": ("@media not print{.c{display:none}}", False),
    "not screen": ("@media not screen{.c{display:none}}", True),
    "unknown condition": ("@media (prefers-color-scheme:dark){.c{display:none}}", True),
    "nested blocks": ("@media screen{@media print{.c{display:none}}}", True),
    "nested and shown": ("@media screen{@supports (display:grid){.c{display:none}}}", False),
    "unsupported": ("@supports not (display:grid){.c{display:none}}", True),
    "after a print block": ("@media print{.c{display:block}}.c{display:none}", False),
    "shown again": (".c{display:none}.c{color:red;display:block}", True),
    "hidden at last": (".c{display:block}.c{display:none}", False),
    "rule inside a rule": (".a{.c{display:none}}", True),
    "line break before the condition": ("@media\n(max-width:600px){.c{display:none}}", True),
    "important": (".c{display:none!important}.c{display:block}", False),
    "kind of selector": ("#i{display:block}.c{display:none}", True),
    "shown again for a screen": (".c{display:none}@media screen{.c{display:block}}", True),
    "shown again in print only": (".c{display:none}@media print{.c{display:block}}", False),
    "comment": ("/* .c{display:none} */.d{display:none}", True),
    "import before": ("@import 'x.css';.c{display:none}", False),
    "braces in a string": ("p::before{content:'}'}.c{display:none}", False),
    "key frames": ("@keyframes k{from{display:none}to{display:block}}", True),
    "never closed": (".c{display:none", False),
}


@pytest.mark.parametrize("name", SHEETS)
def test_style_sheets(name):
    css, shows = SHEETS[name]
    assert render(f"<style>{css}</style><p id=i class='b c'>text<p>more") == ("text\n\nmore" if shows else "more")


def test_more_style_sheets():
    hides = ".c{display:none}"
    assert render(f"<style media=print>{hides}</style><p class=c>text") == "text"
    assert render(f"<style media=screen>{hides}</style><p class=c>text") == ""
    assert render(f"<style>{hides}</style><style>.c{{display:block}}</style><p class=c>text") == "text"
    assert render(f"<style>{hides}</style><p class=c style=display:block>text") == "text"
    for part in ("@media print{", "a", "a{", "}", "/*", "@x;", "'", "display:none;", ".c{display:none}", "a,", " ", "@media ("):
        render(f"<style>{part * 100_000}</style>text")  # in linear time


def slow_table(rows):
    """A table of (text, colspan, rowspan) on a grid of single squares, each of which knows its cell."""
    squares, height = {}, len(rows)
    for y, row in enumerate(rows):
        x = 0
        for text, wide, high in row:
            while (x, y) in squares:
                x += 1
            for dx in range(wide):
                for dy in range(min(high, height - y)):
                    squares.setdefault((x + dx, y + dy), text if dx == dy == 0 else "")
            x += wide
    width = {}
    own = {y: [x for x, yy in squares if yy == y] for y in range(height)}
    last = {y: max(own[y], default=-1) for y in range(height)}
    shown = [y for y in range(height) if any(squares[(x, y)] for x in own[y])]
    for y in shown:
        for x in own[y]:
            width[x] = max(width.get(x, 0), len(squares[(x, y)]))
    return "\n".join("".join(squares.get((x, y), "").ljust(width.get(x, 0) + 2) for x in range(last[y] + 1)).rstrip() for y in shown)


cells = st.tuples(st.text("abcxyz", min_size=1, max_size=5), st.integers(1, 3), st.integers(1, 3))


@given(st.lists(st.lists(cells, min_size=2, max_size=4), min_size=1, max_size=5))
@settings(max_examples=200, deadline=None)
def test_tables_against_a_grid_of_squares(rows):
    html = "".join("<tr>" + "".join(f"<td colspan={w} rowspan={h}>{t}" for t, w, h in row) for row in rows)
    got = render(f"<table>{html}</table>")
    assert got.split("\n") == slow_table(rows).split("\n")


def list_html(x):
    if isinstance(x, str):
        return x
    kind, start, back, inner = x
    given_ = f" start={start}" + " reversed" * back if kind == "ol" else ""
    return f"<{kind}{given_}>" + "".join("<li>" + list_html(y) for y in inner) + f"</{kind}>"


def list_lines(x):
    """Lines of a list: every item starts with its marker, what follows is indented as far."""
    if isinstance(x, str):
        return [x]
    kind, start, back, inner = x
    out = []
    for k, y in enumerate(inner):
        sign = "- " if kind == "ul" else f"{start + (-k if back else k)}. "
        lines = list_lines(y)
        out.append(sign + lines[0])
        out += [" " * len(sign) + z for z in lines[1:]]
    return out


@given(st.tuples(st.sampled_from(["ul", "ol"]), st.integers(0, 20), st.booleans(), st.lists(st.one_of(st.text("abc", min_size=1, max_size=4), st.tuples(st.sampled_from(["ul", "ol"]), st.integers(0, 20), st.booleans(), st.lists(st.text("abc", min_size=1, max_size=4), min_size=1, max_size=3)).map(lambda t: ("item", t))), min_size=1, max_size=5)))
@settings(max_examples=200, deadline=None)
def test_lists_against_plain_recursion(x):
    kind, start, back, inner = x
    html, want = "", []
    for k, y in enumerate(inner):
        sign = "- " if kind == "ul" else f"{start + (-k if back else k)}. "
        if isinstance(y, str):
            html += f"<li>{y}"
            want.append(sign + y)
        else:
            html += f"<li>head{list_html(y[1])}"
            want.append(sign + "head")
            want += [" " * len(sign) + z for z in list_lines(y[1])]
    given_ = f" start={start}" + " reversed" * back if kind == "ol" else ""
    assert render(f"<{kind}{given_}>{html}</{kind}>").split("\n") == want
