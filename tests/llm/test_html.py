"""HTML extraction: depth, odd tags, grids, styles, and trees held to what they show."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.llm import html

x = html.extract


def test_depth_changes_nothing():
    for depth in (10, 250, 10_000):
        assert x("<div>" * depth + "<div hidden>secret</div>shown") == "shown"
        assert x("<section>" * depth + "<table><tr><td>a<td>b<tr><td>long<td>c</table>") == "a     b\nlong  c"
        assert x("<table><tr><td>" * depth + "in") == "in"
        assert x("<table><tr>" + "<form>" * depth + "<td>a<td>b") == "a  b"
    assert x("<ul><li>" * 3 + "a") == "- \n  - \n    - a".replace("- \n", "-\n")


@pytest.mark.parametrize("page", ["<a " * 330_000 + '"', "<a b=\"'" * 125_000, "<" * 1_000_000, "<section><p>" * 80_000, "<b>" * 140_000 + "</i>" * 140_000, "<b>a</b> " * 110_000, "<!--" * 250_000, "<style>.n{" * 100_000, "<style>" + ".n{display:none}" * 30_000 + "</style>" + "<p class=n>x" * 30_000, "<table><tr>" + "<td rowspan=65534>x" * 10_000 + "<tr><td>y" * 10_000, "<table>" + "<tr>" + "<td colspan=1000>x" * 50_000], ids=range(11))
def test_odd_pages_take_linear_time(page):
    began = time.process_time()
    x(page)
    assert time.process_time() - began < 15  # quadratic work takes minutes


def test_grids():
    assert x("<table><tr><td rowspan=2>R<td>1<tr><td>2</table>") == "R  1\n   2"
    assert x("<table><tr><td>a<td rowspan=0>all<td>c<tr><td>b<td>d<tr><td>e<td>f</table>") == "a  all  c\nb       d\ne       f"
    assert x("<table><tr><td colspan=2>heading<td>x<tr><td>a<td>b<td>c</table>") == "heading  x\na  b     c"
    assert x("<table><tr><td rowspan=2 colspan=2>ab<td>1<tr><td>2<tr><td>c<td>d<td>3</table>") == "ab    1\n      2\nc  d  3"
    assert x("<table><tr><td>漢字<td>b<tr><td>abcdef<td>c</table>") == "漢字    b\nabcdef  c"
    assert x("<table><tr><td>é<td>b<tr><td>ab<td>c</table>") == "é   b\nab  c"
    long = "q" * 5000
    assert x(f"<table><tr><td>{long}<td>b<tr><td>a<td>c</table>") == f"{long}  b\na  c"


def test_what_is_hidden():
    assert x("a<dialog>no</dialog><dialog open>yes</dialog>") == "a\nyes"
    assert x("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>") == "yes"
    assert x("<style>.n{display:none} p.m{visibility:hidden}</style><p class=n>no<p class='m x'>no<b style='visibility:visible'>yes</b>") == "yes"
    assert x("<style>/* p{display:none} */ @media print{p{display:none}} @media screen{i,#q{display:none}}</style><p>a<i>no</i><b id=q>no</b>") == "a"
    assert x("<style>p{display:none}#s{display:block}.q{display:none !important}</style><p>no<p id=s>yes<p id=s class=q style='display:block'>no") == "yes"
    assert x("<style>div p{display:none}</style><div><p>kept</div>") == "kept"
    assert x("<table><tr style='display:none'><td>no<tr><td>a<td style=display:none>no<td>b</table>") == "a  b"


def test_odd_references():
    assert x("&#" + "9" * 6000 + ";&#0000000000000065;&#x41;&amp&nosuch;") == "�AA&&nosuch;"


@pytest.mark.parametrize("seed", range(8))
def test_shows_all_that_is_visible_in_order(seed):
    """Random trees with a word in each element; which words show is told while building."""
    rng = random.Random(seed)
    shown, n = [], 0

    def build(depth: int, dead: bool, seen: bool) -> str:
        nonlocal n
        out = []
        for _ in range(rng.randrange(1, 5)):
            n += 1
            tag = rng.choice(["div", "section", "span", "b", "article", "em"])
            how = rng.choice(["", "", "", " hidden", " style='display:none'", " style='visibility:hidden'", " style='visibility:visible'", " class=gone", ' title="a>b"'])
            gone = dead or how in (" hidden", " style='display:none'", " class=gone")
            here = {" style='visibility:hidden'": False, " style='visibility:visible'": True}.get(how, seen)
            if here and not gone:
                shown.append(f"w{n}")
            out.append(f"<{tag}{how}>w{n} " + (build(depth - 1, gone, here) if depth else "") + f"</{tag}> ")
        return "".join(out)

    page = "<style>.gone{display:none}</style>" + build(4, False, True)
    assert x(page).split() == shown


def test_rows(spark):
    rows = [(1, "<p>a"), (1, "<p>a"), (None, "b"), (2, None), (3, ""), (None, None)]
    pages = spark.createDataFrame(rows, "page_id long, html string").select("*", F.lit("t").alias("text"), F.lit(1).alias("id_"), F.lit(2).alias("url"))
    got = sorted(((r.page_id, r.text) for r in html.extract_text(pages).collect()), key=str)
    assert got == sorted([(1, "a"), (1, "a"), (None, "b"), (2, ""), (3, ""), (None, "")], key=str)
    assert html.extract_text(pages.limit(0)).columns == ["page_id", "text"] and html.extract_text(pages.limit(0)).count() == 0
