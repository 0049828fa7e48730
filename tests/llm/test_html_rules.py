"""Style rules, numbers, tables and hostile markup of the HTML extraction;
letters of the language ID."""

from __future__ import annotations

import time

import pytest

from veeduria.llm import html_text, langid
from veeduria.llm.common import has_letter

LONG = "9" * 5000


@pytest.mark.parametrize("markup, text", [
    (f"<ol start={LONG}><li>a</ol>", "2147483647. a"), (f"<ol><li value={LONG}>a<li>b</ol>", "2147483647. a\n2147483648. b"),
    ("<ol start=007><li>a</ol>", "7. a"), ("<ol start=-3><li>a</ol>", "1. a"), ("<ol start=²><li>a</ol>", "1. a"),
    (f"<table><tr><td colspan={LONG}>a<td>b</table>", "a | b"), (f"<table><tr><td rowspan={LONG}>a<td>b<tr><td>c</table>", "a | b\n  | c"),
    (f"x&#{LONG};y", "x�y"), (f"x&#x{'f' * 5000};y", "x�y"), (f"x&#{'0' * 5000}65;y", "xAy"), ("&#x000041;&#65;", "AA"),
    ("&#0a", "�a"),
])
def test_long_numbers(markup, text):
    assert html_text.visible_text(markup) == text


HIDE = "<style>{} {{display:none}}</style>"


@pytest.mark.parametrize("selector, body, text", [
    ("div.x", "<div class='y x'>a</div><div>b</div><p class=x>c</p>", "b\n\nc"),
    (".a .b", "<div class=a><div><p class=b>x</p>y</div></div><p class=b>z", "y\n\nz"),
    (".a > .b", "<div class=a><i class=b>x</i> <div><i class=b>y</i></div></div>", "y"),
    (".a>.b", "<div class=a><i class=b>x</i> <div><i class=b>y</i></div></div>", "y"),
    ("div .a > p.c", "<div><section class=a><p class=c>x<p>y</section></div><section class=a><p class=c>z</section>", "y\n\nz"),
    ("#m.k[data-q]", "<i id=m class=k data-q>x</i><i id=m class=k>y</i>", "y"),
    ("[lang|=en]", "<i lang=en-GB>x</i><i lang=english>y</i>", "y"), ("a[href^='ad']", "<a href=ads>x</a><a href=b>y</a>", "y"),
    ("[title~=off]", "<i title='on off'>x</i><i title=offer>y</i>", "y"), ("*.h", "<i class=h>x</i>y", "y"),
    ("p:hover", "<p>x", "x"), ("h1 + p", "<h1>t</h1><p>x", "t\n\nx"), ("h1 ~ p", "<h1>t</h1><p>x", "t\n\nx"),
    (".a, :hover, i", "<b class=a>x</b><i>y</i>z", "z"), ("", "<p>x", "x"), ("> p", "<p>x", "x"), ("[", "x", "x"),
])
def test_selectors(selector, body, text):
    assert html_text.visible_text(HIDE.format(selector) + "<body>" + body) == text


@pytest.mark.parametrize("css, text", [
    ("i.a{display:none} .a{display:inline}", ""), (".a{display:none} i.a{display:inline}", "x"),
    ("#q{display:inline} .w .a{display:none}", "x"), (".a{display:none!important} #q{display:inline}", ""),
    (".a{display:none} .a{display:inline}", "x"), (".a{display:none!important} .a{display:inline}", ""),
    ("i.a{visibility:hidden} .a{visibility:visible}", ""),
])
def test_the_most_specific_rule_counts(css, text):
    assert html_text.visible_text(f"<style>{css}</style><div class=w><i class=a id=q>x</i></div>") == text


def test_cells_are_wrapped_and_aligned():
    words = " ".join(["abcdefgh"] * 10)                          # 89 characters
    got = html_text.visible_text(f"<table><tr><td>{words}<td>b<tr><td>c<td>d</table>").split("\n")
    assert got == [" ".join(["abcdefgh"] * 6).ljust(53) + " | b", " ".join(["abcdefgh"] * 4).ljust(53) + " |", "c".ljust(53) + " | d"]
    long = "x" * 70
    got = html_text.visible_text(f"<table><tr><td>{long}<td>b<tr><td>c<td>d</table>").split("\n")
    assert got[0].startswith(long) and "b" in got[0] and got[1] == "c | d"


def test_rowspans_over_many_rows():
    rows = "".join(f"<tr><td>{i}" for i in range(1200))
    got = html_text.visible_text(f"<table><tr><td rowspan=1150>a<td>b{rows}</table>").split("\n")
    assert got[1149] == "     | 1148" and got[1150] == "1149"


@pytest.mark.parametrize("markup", [
    '<a "' * 50000, '<a ="' * 50000, "<div>" * 50000, "<i>" * 50000 + "x <b>" * 1000, "<a " * 50000, "<" * 200000,
    "<!--" * 50000, "<title>" * 30000, "<textarea>x" * 30000, "<ul><li>" * 20000, "<p><b>" * 30000,
    "<b>" * 30000 + "</p>" * 30000, "<style>.a .b{display:none}</style>" + "<div class=a>" * 30000,
    "<style>" + "a," * 30000 + "a{display:none}</style><a>", "<style>" + "@media{" * 10000 + "</style>x",
    "<table><tr>" + "<td colspan=1000 rowspan=65534>x" * 1000 + "<tr><td>y" * 500, "<select>" + "<option>" * 30000,
], ids=range(17))
def test_hostile_pages_take_seconds(markup):
    start = time.time()
    html_text.visible_text(markup)
    assert time.time() - start < 15


def test_edge_rows(spark):
    schema = "page_id long, html string, text string, url string"
    rows = [(1, None, "t", "u"), (1, "", "t", "u"), (None, "<p>a", "t", "u"), (None, "<p>a", "t", "u"), (2, "<p>b" * 20000, "t", "u")]
    df = spark.createDataFrame(rows, schema)
    got = sorted(((r.page_id or 0, r.text[:5]) for r in html_text.extract(df).collect()))
    assert got == [(0, "a"), (0, "a"), (1, ""), (1, ""), (2, "b\n\nb\n")]
    assert html_text.extract(df.limit(0)).collect() == []


def test_letters():
    assert not any(map(has_letter, ("", "² ½ 3", "12 %", "_", "①", "٣")))
    assert all(map(has_letter, ("a", "1é", "ß", "ж", "中", "ª")))


def test_signs_without_letters_have_no_language(spark):
    rows = [(i, t, "en") for i, t in enumerate(["the cat and the dog"] * 8 + ["² ½ 3", "42"])]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[8] == got[9] == ("und", 0.0) and got[0][0] == "en"
