"""H1's element scanner against texts written by hand."""

import time

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.markup import page_text, pages_to_text
from ledgerlens.operators import filings as FL

PAGES = {
    # ends that the page leaves out
    "<p>one<p>two<li>three": "one\n two\n three",
    "<table><tr><td>1<td>2<tr><td>3</table>": "1 2\n 3",
    "<ul><li>a<li>b</ul>after": "a\n b\n after",
    "<p>intro<table><tr><td>x</td></tr></table>": "intro\n x",
    "<div><p>in</div>out": "in\n\n out",
    "<h1>head<p>body": "head body",
    # quoted attributes, raw text, comments
    '<a title="x > y">link</a>': "link",
    "<a title='x > y'>link</a>": "link",
    "a<script>var x=1;": "a",
    "a<script>if (1 < 2) x = '<p>';</script >b": "a b",
    "<style>p > a {}</style>text<noscript>no</noscript>": "text",
    "a<!-- open b": "a",
    "a<!-- <p>b</p> -->c": "a c",
    "<svg/>shown<svg><text>no</text></svg>": "shown",
    "<!DOCTYPE html><?xml x?>body": "body",
    # plain pages, references and what is no tag
    "<p>a</p><p>b</p>": "a\n b",
    "x<br>y<br/>z<img src=a>w": "x\n y\n z w",
    "1 < 2 &amp; 3 > 2": "1 < 2 & 3 > 2",
    "&lt;p&gt;q&lt;/p&gt;r": "q\n r",
    "<b": "",
    "": "",
}


def test_pages(spark):
    df = spark.createDataFrame([*PAGES.items()], "page string, want string").withColumn("text", F.col("page"))
    got = {r.page: r.text for r in pages_to_text(df, "text").collect()}
    assert got == PAGES


def test_null_page(spark):
    assert pages_to_text(spark.createDataFrame([(None,)], "t string"), "t").first().t is None


@pytest.mark.parametrize("page", ["<a " + "x" * 400_000, "<" * 400_000, "<p>" * 200_000, "<table><tr><td>" * 20_000, "<a title='" * 50_000, "<!--" * 100_000])
def test_hostile_pages_take_time_in_proportion(page):
    t = time.time()
    page_text(page)
    assert time.time() - t < 10


def test_filings_read_their_pages_by_elements(spark):
    raw = ("<SEC-HEADER>\nCONFORMED SUBMISSION TYPE:\t8-K\n</SEC-HEADER>\n<DOCUMENT>\n<TYPE>8-K\n<TEXT>\n<html><body>"
           '<p>one<p>two<table><tr><td>1<td title="a > b">2<tr><td>3</table><script>no</body></html>\n</TEXT>\n</DOCUMENT>')
    df = spark.createDataFrame([("f", raw)], "f string, raw string")
    body = FL.kept_sections(df).first().body
    assert [x.strip() for x in body.split("\n") if x.strip()] == ["one", "two", "1 2", "3"]
    assert FL.clean_filings(df).first().clean_text.endswith(body)
