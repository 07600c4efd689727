"""Tables on pages against the standard library's parser, and pages that few would write."""

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from millrace.functions import html


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression.alias("y")).first().y


class Plain(HTMLParser):
    """Rows of the first table of a class, as lists of (text, link) of its own cells."""

    def __init__(self, css_class):
        super().__init__()
        self.css_class, self.depth, self.done, self.rows, self.link = css_class, 0, False, [], None

    def handle_starttag(self, tag, attrs):
        if tag == "table" and not self.done:
            if self.depth or self.css_class in (dict(attrs).get("class") or "").split():
                self.depth += 1
        elif self.depth == 1:
            if tag == "tr":
                self.rows.append([])
            elif tag == "td" and self.rows:
                self.rows[-1].append([[], None])
            elif tag == "p":
                self.handle_data(" ")  # paragraphs part words
            elif tag == "a" and self.rows and self.rows[-1] and self.rows[-1][-1][1] is None:
                self.rows[-1][-1][1] = self.link = []

    def handle_endtag(self, tag):
        if tag == "table" and self.depth:
            self.depth -= 1
            self.done = self.depth == 0
        elif tag in ("a", "td", "tr") and self.depth == 1:
            self.link = None

    def handle_data(self, data):
        if self.depth == 1 and self.rows and self.rows[-1] and not self.cdata_elem:
            self.rows[-1][-1][0].append(data)
            if self.link is not None:
                self.link.append(data)

    def found(self):
        squeeze = lambda parts: " ".join("".join(parts).split())
        return [[(squeeze(text), None if link is None else squeeze(link)) for text, link in row] for row in self.rows]


def page(rng, depth=0):
    """A random page around random tables, some in cells of others, with comments, scripts and references."""
    word = lambda: rng.choice(["x", "two words", "a &amp; b", "&lt;i&gt;", "&#233;", "&#x1F600;", "1 &gt; 0", "naïve", "", " \n ", "a&nbsp;b"])
    noise = lambda: rng.choice(["", "", "<!-- <tr><td><a>no</a></td></tr> -->", "<script>var t = '</td>';</script>", "<b>", "</b>", "<!-- > -->"])
    link = lambda: f"<a href='#' title=\"a > b\">{word()}</a>"
    out = [noise(), "<p>", word()]
    for _ in range(rng.choice([1, 1, 2]) if depth else rng.choice([0, 1, 3])):
        css = rng.choice(['class="standard"', "class='wide standard big'", "class=standard", 'class="substandard"', "", 'data-class="standard"'])
        out += [f"<{rng.choice(['table', 'TABLE'])} {css}>", "\n"]
        for _ in range(rng.choice([0, 1, 3])):
            out += ["<tr>", noise()]
            for _ in range(rng.choice([0, 1, 2])):
                inner = page(rng, depth + 1) if depth < 2 and rng.random() < 0.3 else ""
                out += [rng.choice(["<td>", "<td colspan='2'>"]), word(), noise(), link() if rng.random() < 0.5 else "", inner, link() if rng.random() < 0.2 else "", noise(), "</td>"]
            out += ["</tr>", "\n"]
        out += ["</table>", word()]
    return "".join(out)


def test_tables_equal_the_parsers(spark):
    rng = random.Random(2)
    pages = [page(rng) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(pages)), "k int, x string").select("k", html.table_rows(F.col("x"), "standard").alias("r")).orderBy("k").collect()
    some = 0
    for text, got in zip(pages, rows):
        plain = Plain("standard")
        plain.feed(text)
        plain.close()
        assert [[(c.text, c.link) for c in r.cells] for r in got.r] == plain.found(), text
        some += bool(got.r)
    assert some > 80


def test_nested_table_and_references(spark):
    text = """<table class="standard"><tr><td><table><tr><td><a>inner</a></td></tr></table><a>A &amp; B</a></td></tr><tr><td><!-- <a>no</a> --><a>yes</a></td></tr></table>"""
    assert one(spark, text, html.table_links(F.col("x"), "standard")) == ["A & B", "yes"]


@pytest.mark.parametrize(
    "text, want",
    [
        (None, []),
        ("", []),
        ("<table class=standard>", []),
        ("<table class=standard><tr><td><a>open", ["open"]),
        ("<table class=standard><tr><td><a>one<tr><td><a>two</table>", ["one", "two"]),
        ("<table class=standard><tr><td><a>own</a><table><tr><td><a>never closed", ["own"]),
        ("<table class=standard><thead><tr><td><a>head<tbody><tr><th><a>row's name</a><td>x</table>", ["row's name"]),
        ("<table class=standard><thead><tr><td><a>head</thead><tr><td><a>body</table>", ["body"]),
        ("<table class=standard><tr><th><a>head</a></th></tr><tr><td><a>1</a> <a>2</a></table>", ["1"]),
        ("<!-- <table class=standard><tr><td><a>no --><table class=other><tr><td><a>no</table>", []),
        ("</table></tr><table class=standard><tr><td>a < b <a>c</a></table>", ["c"]),
        ("<table class=standard><tr><td><a></a></td></tr></table>", []),
    ],
)
def test_odd_pages(spark, text, want):
    assert one(spark, text, html.table_links(F.col("x"), "standard")) == want


def test_any_table(spark):
    assert one(spark, "<p><table id=t><tr><td><a>x</a></table>", html.table_links(F.col("x"))) == ["x"]


def test_long_pages(spark):
    """Linear in the page's length: no pattern backtracks and no fold copies what it has gathered of every row."""
    text = "<table class=standard>" + "".join(f"<tr><td>{k}<td><a>row {k}</a></td></tr>" for k in range(3000)) + "<!--" + "-" * 200_000 + "<" * 1000 + '<a title="' + "x>" * 100_000
    got = one(spark, text, html.table_links(F.col("x"), "standard"))
    assert len(got) == 3000 and got[-1] == "row 2999"


@pytest.mark.parametrize("text, want", [("&amp;lt;", "&lt;"), ("&#0;&#xD800;&#99999999;", "�" * 3), ("&unknown; & &", "&unknown; & &"), ("&#128512;", "😀"), (None, None), ("", "")])
def test_references(spark, text, want):
    assert one(spark, text, html.decoded(F.col("x"))) == want
