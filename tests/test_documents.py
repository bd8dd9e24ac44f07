"""Pages as rows: page text, document text and requests."""

import json
import random

from pyspark.sql import functions as F

from billgrain.functions import schema
from billgrain.operators import pages, responses


def test_items_to_pages_to_documents(spark):
    rng = random.Random(1)
    items = [(doc, page, pos, f"t{doc}.{page}.{pos}", rng.choice([0.2, 0.5, 0.9])) for doc in range(3) for page in range(1, 4) for pos in range(rng.randrange(1, 9))]
    expected = {}
    for doc in range(3):
        texts = [" ".join(t for d, p, _, t, c in items if (d, p) == (doc, page) and c > 0.5) for page in range(1, 4)]
        expected[doc] = "\n\n".join(f"[INICIO PÁGINA {n}]\n{t}\n[FIN PÁGINA {n}]" for n, t in enumerate(texts, 1))
    rng.shuffle(items)
    rows = spark.createDataFrame(items, "doc_id int, page_number int, pos int, text string, confidence double").repartition(4)
    got = pages.assemble_rows(pages.page_texts(rows)).collect()
    assert {r.doc_id: r.text for r in got} == expected and {r.n_pages for r in got} == {3}


def test_a_document_of_many_pages_is_joined_in_parts(spark):
    numbers = list(range(1, 1200)) + [None, None]
    random.Random(2).shuffle(numbers)
    rows = [(1, n, None if n == 7 else f"page {n}") for n in numbers] + [(2, 1, "b"), (2, 1, "a"), (None, 3, "c")]
    got = {r.doc_id: (r.n_pages, r.text) for r in pages.assemble_rows(spark.createDataFrame(rows, "doc_id int, page_number int, text string").repartition(7)).collect()}
    shown = lambda n, t: f"[INICIO PÁGINA {n}]\n{t}\n[FIN PÁGINA {n}]"
    assert got[1] == (1201, "\n\n".join([shown(n, "" if n == 7 else f"page {n}") for n in range(1, 1200)] + [shown("N/A", "page None")] * 2))
    assert got[2] == (2, shown(1, "a") + "\n\n" + shown(1, "b")) and got[None] == (1, shown(3, "c"))


def test_no_pages(spark):
    assert pages.assemble_rows(spark.createDataFrame([], "doc_id int, page_number int, text string")).count() == 0


def test_answers_keep_nulls_and_name_the_type_of_an_issue(spark):
    issue = ("total", "total_mismatch", "text", "warning", None, 2.0)
    row = (1, (None,), (True, [], [], 100.0), (False, [issue], 0), None, "{}")
    df = spark.createDataFrame(
        [row],
        f"doc_id int, invoice struct<notes:string>, semantic struct<is_valid:boolean,errors:array<string>,warnings:array<string>,quality_score:double>,"
        f"math struct<is_valid:boolean,issues:array<{schema.ISSUE}>,corrections_applied:int>, document_hash string, raw string",
    )
    done = responses.results(df, {"ocr_time": F.lit(1.5)}, "some-model", F.col("raw"))
    body = json.loads(responses.envelopes(done, "user").first().response)
    assert body["invoice"] == {"notes": None} and body["user"] == "user" and body["job_id"]
    results = body["processing_results"]
    assert results["model"] == "some-model" and results["raw_json_length"] == 2
    assert results["mathematical_validation"]["issues"] == [
        {"field": "total", "type": "total_mismatch", "message": "text", "severity": "warning", "expected": None, "actual": 2.0}
    ]


REGION = "struct<type:string,bbox:array<double>,res_kind:string,html:string,text:string,items:array<struct<text:string,confidence:double,bbox:array<double>,pos:int>>>"
PAGE = f"doc_id int, page_number int, height double, width double, regions array<{REGION}>"


def page(doc, number, *regions):
    return (doc, number, 1000.0, 800.0, [(kind, [0.0, 0.0, 9.0, 9.0], "dict", html, text, None) for kind, html, text in regions])


def test_tables_are_numbered_among_other_regions(spark):
    rng = random.Random(2)
    kinds = [[rng.choice(["table", "text", None]) for _ in range(n)] for n in (0, 1, 5, 300)]
    rows = [page(i, 1, *((k, None, "x") for k in row)) for i, row in enumerate(kinds)]
    got = sorted(tuple(r) for r in pages.numbered_tables(spark.createDataFrame(rows, PAGE)).collect())
    expected = [(i, 1, at, row[: at + 1].count("table")) for i, row in enumerate(kinds) for at in range(len(row)) if row[at] == "table"]
    assert got == sorted(expected)


def test_only_short_pages_are_read_in_table_mode(spark):
    long, table = "w" * 250, "<table><tr><td>name</td><td>n</td></tr><tr><td>part</td><td>1</td></tr></table>"
    layout = [page(1, 1, ("text", None, long)), page(1, 2, ("text", None, "y")), page(2, 1), page(3, 1, ("text", None, "z")), page(4, None, ("text", None, "a"))]
    other = [page(1, 1, ("table", table * 20, None)), page(1, 2, ("table", table, None)), page(2, 1, ("table", table, None)), page(4, None, ("table", table, None)), page(9, 1)]
    layout, other = (spark.createDataFrame(rows, PAGE) for rows in (layout, other))
    whole = pages.choose_mode(pages.page_results(layout, "layout"), pages.page_results(other, "table"))
    got = pages.adaptive(layout, other)
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))
    modes = {(r.doc_id, r.page_number): r.extraction_mode for r in got.collect()}
    assert modes == {(1, 1): "layout", (1, 2): "table", (2, 1): "table", (3, 1): "layout", (4, None): "layout"}
    none = spark.createDataFrame([], PAGE)
    assert pages.adaptive(none, other).count() == 0 and pages.adaptive(layout, none).count() == 5
