"""Table parsing against the language's own parser, and text forms."""

import html as python_html
import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from billgrain.functions import html


class Reader(HTMLParser):
    """Rows of cell texts of balanced tables."""

    def __init__(self):
        super().__init__()
        self.rows, self.row, self.cell = [], None, None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.row = []
        if tag in ("td", "th"):
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.row.append("".join(self.cell).strip())
            self.cell = None
        if tag == "tr" and self.row:
            self.rows.append(self.row)

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def expected_rows(text):
    reader = Reader()
    reader.feed(text)
    reader.close()
    return reader.rows


def random_tables(count):
    rnd = random.Random(7)
    bits = ["a", "1,5", " ", "&amp;", "&lt;b&gt;", "&#8364;", "&nbsp;", "<b>x</b>", "<br/>", '<i title="a>b">y</i>', "ñ", "a < b", "&copy 2", "&notit;", "\n", "&#x41;", "&#150;", "<!-- c -->"]
    tables = []
    for _ in range(count):
        rows = ""
        for _ in range(rnd.randint(0, 4)):
            cells = ""
            for _ in range(rnd.randint(0, 4)):
                tag = rnd.choice(["td", "th", "TD", 'td colspan="2"'])
                cells += f"<{tag}>{''.join(rnd.choice(bits) for _ in range(rnd.randint(0, 4)))}</{tag.split()[0]}>"
            rows += f"<tr>{cells}</tr>"
        tables.append(f"<table>{rows}</table>")
    return tables


def test_rows_like_the_parser(spark):
    tables = random_tables(400)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tables)], "i int, html string")
    rows = F.transform(html.cells(F.col("html")), html.texts)
    for r in df.select("i", "html", rows.alias("rows")).collect():
        assert r.rows == expected_rows(r.html), r.html


def test_unescape_like_the_language(spark):
    rnd = random.Random(3)
    bits = ["&", "amp", ";", "lt", "&gt;", "#", "#x", "41", "8364", "110000", "D800", "x", " ", "&notin;", "&notit;", "&copy", "&#0;", "&#128;", "&#xFFFE;", "&#11;", "&#99999999999999999999;", "&#x80;", "<", "&Aacute", "&ampx", "&&"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 6))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", html.unescape(F.col("t")).alias("u")).collect():
        assert r.u == python_html.unescape(r.t), r.t


@pytest.fixture(scope="module")
def toon(spark):
    def run(text, table_no=1, page_no=2):
        df = spark.createDataFrame([(text,)], "html string")
        table = html.structure(html.toon_rows(F.col("html")))
        return df.select(html.toon(table, F.lit(table_no), F.lit(page_no))).first()[0]

    return run


def test_last_header_row_wins_and_headers_keep_commas(toon):
    text = "<tr><th>a</th></tr><tr><td>1,5</td><td>x</td></tr><tr><th>b,c</th><td>d</td></tr>"
    assert toon(text) == "TABLE 1 (Page 2) [1]\n{b,c, d}\n1\\,5, x"


def test_header_only_is_empty(toon):
    assert toon("<tr><th>a</th></tr>") == "TABLE 1 (Page 2): Empty table"


def test_rows_are_padded_and_cut(toon):
    text = "<tr><td>a</td><td>b</td></tr><tr><td>c</td></tr><tr><td>d</td><td>e</td><td>f</td></tr>"
    assert toon(text) == "TABLE 1 (Page 2) [3]\n{col1, col2}\na, b\nc, \nd, e"


def test_compact_form_decodes_twice(toon):
    text = "<tr><td>&lt;i&gt;x&lt;/i&gt;&amp;lt;</td></tr>"
    assert toon(text).endswith("\nx<")


def entity(spark, text):
    df = spark.createDataFrame([(text,)], "html string")
    return df.select(html.entity_text(F.col("html"), html.cells(F.col("html")))).first()[0]


def test_entity_text(spark):
    text = "<tr><td>b</td><td>a</td><td>b</td><td>x@y</td></tr><tr><td>x@y.es</td><td>x@y.es</td><td>TEL: 123456</td><td>es12 3456</td></tr>"
    assert entity(spark, text) == "[VENDOR_INFO - Has contact details]\nx@y.es\nx@y.es\nTEL: 123456\n\n[DOCUMENT_CONTENT]\nb\na\nx@y\nes12 3456"
    assert entity(spark, "<p>no  table</p>") == "no table"
    assert entity(spark, "") == ""


@pytest.mark.parametrize(
    "headers, kind",
    [
        (["Concepto", "Honorarios", "Suplidos"], "expense_category_table"),
        (["Concepto", "Honorarios", "Total"], "generic"),
        (["Concepto", "Cantidad", "Precio"], "standard_line_items"),
        ([], "generic"),
    ],
)
def test_table_type(spark, headers, kind):
    df = spark.createDataFrame([(headers,)], "h array<string>")
    assert df.select(html.table_type(F.col("h"))).first()[0] == kind


def test_malformed_is_marked(spark):
    df = spark.createDataFrame([("<tr><td>a<td>b</td></tr>",), ("<tr><td>a</td></tr>",)], "html string")
    assert [r[0] for r in df.select(html.malformed(F.col("html"))).collect()] == [True, False]


def test_script_text_is_no_markup(spark):
    text = '<script>var t="<tr><td>no</td></tr>";</script><tr><td>yes</td></tr>'
    df = spark.createDataFrame([(text,)], "html string")
    assert df.select(F.transform(html.cells(F.col("html")), html.texts)).first()[0] == [["yes"]]
