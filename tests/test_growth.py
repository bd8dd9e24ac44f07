"""What keeps tasks, moved rows and repeated work from growing faster than the input."""

from pyspark.sql import functions as F

from billgrain.functions import html, json_text, pages, schema, text, zones
from billgrain.operators import corrections
from billgrain.operators import pages as operators
from billgrain.plans import corpora

PAGE = f"page_number int, height double, width double, regions array<{schema.REGION}>"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_large_row_group_is_the_work_of_many_tasks(spark, tmp_path):
    rows = 260_000
    path = str(tmp_path / "orders.parquet")
    spark.range(rows).repartition(1).write.parquet(path)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    kept = {name: spark.conf.get(name) for name in names}
    try:
        for name in names:
            spark.conf.set(name, "16384")
        read = spark.read.parquet(path)
        assert read.rdd.getNumPartitions() >= 8  # many splits, but one of them holds all rows
        spread = corpora.spread(read)
        sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == rows and max(sizes) < 2 * corpora.TASK_ROWS
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)


def test_small_splits_are_read_as_they_are_and_no_rows_are_no_fault(spark):
    rows = spark.range(0, 8_000, 1, 16)
    assert corpora.spread(rows) is rows
    assert corpora.spread(spark.range(0)).count() == 0


def test_only_numbers_of_some_window_are_moved(spark, monkeypatch):
    moved = []
    ranked = corrections._best_by_rank
    monkeypatch.setattr(corrections, "_best_by_rank", lambda d, n: (moved.append(sorted(r["value"] for r in n.collect())), ranked(d, n))[1])
    lines = spark.createDataFrame([(1, 1, "a", 10.0, 5.0, 900.0), (1, 2, "b", 2.0, 300.0, 1.0)], "doc_id int, line_no int, description string, quantity double, unit_price double, line_total double")
    texts = spark.createDataFrame([(1, 1, "7 24 25 49 52 700"), (1, 2, "1 599 630 631"), (2, 1, "50")], "doc_id int, line_order int, text string")
    got = {r.line_no: (r.line_total, r.repaired) for r in corrections.repaired_lines(lines, texts).collect()}
    assert moved == [[25.0, 49.0, 52.0, 599.0, 630.0]]
    assert got == {1: (49.0, True), 2: (599.0, True)}


def test_a_text_is_worked_out_once(spark):
    df = spark.createDataFrame([], PAGE)
    plan = _plan(df.select(pages.routed(F.col("regions"), F.col("page_number"), F.col("height"), F.col("width")).alias("r")))
    assert plan.count("[VENDOR_HEADER]") == 1 and plan.count("[VENDOR_INFO") == 1
    answers = spark.createDataFrame([], "raw string")
    assert _plan(answers.select(json_text.strip_fence(F.col("raw")).alias("t"))).count("trim(") == 2


def test_a_mark_in_a_number_looks_back_only_from_the_mark(spark):
    answer = '{"notes":"a_1","items":[{"quantity":"1_0_0","unit_price":"2_5.5","line_total":"x_1"}],"extensions":{"amount":"1_0"}}'
    df = spark.createDataFrame([(answer,)], "raw string").select(F.regexp_replace("raw", json_text._SPACED_NUMBER, "").alias("t"))
    assert df.first().t == answer.replace("1_0_0", "100").replace("2_5.5", "25.5").replace('"1_0"', '"10"')


def test_places_of_violations(spark):
    rows = [
        '{"parties":{"vendor":3,"customer":{"name":null}},"financial_details":null,"items":[{"quantity":-1,"unit_price":true,"line_total":{}},null,[]]}',
        '{"parties":[],"items":null,"metadata":null,"extensions":[],"notes":2}',
        "[]",
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, raw string")
    got = {r.i: list(r.v) for r in df.select("i", json_text.violations(F.try_parse_json("raw")).alias("v")).collect()}
    assert got[0] == [
        "parties.vendor: type", "parties.customer.name: type", "financial_details: type",
        "items[0].quantity: negative", "items[0].line_total: type", "items[1]: type", "items[2]: type",
    ]
    assert got[1] == ["notes: type", "parties: type", "financial_details: missing", "items: type", "extensions: type"]
    assert got[2] == [": type"]


def test_only_short_pages_are_joined_and_kinds_alone_are_numbered(spark):
    long, other = [(1, 1, 9.0, 9.0, [("text", None, "str", None, "w" * 250, None)])], [(1, 1, 9.0, 9.0, [])]
    rows, tables = (spark.createDataFrame(r, f"doc_id int, {PAGE}") for r in (long, other))
    plan = _plan(operators.adaptive(rows, tables)).split("\n")
    assert plan[0].startswith("Union") and sum("Join LeftOuter" in line for line in plan) == 1
    routed = pages.routed(F.col("regions"), F.col("page_number"), F.col("height"), F.col("width"))
    assert "AS region" not in _plan(spark.createDataFrame([], PAGE).select(routed.alias("r"))).replace("AS regions", "")


def test_patterns_read_anew_for_each_value_are_short_and_ascii():
    patterns = (text.SPACE, zones.CURRENCY, zones.PURE_NUMBER)
    assert all(p.isascii() and len(p) < 160 for p in patterns) and len(text.SPACE) < 30


def test_space_class_and_words_between_spaces(spark):
    signs = spark.range(0x3100).where("id NOT BETWEEN 55296 AND 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    found = {r.id for r in signs.where(F.col("c").rlike(text.SPACE)).collect()}
    assert found == {i for i in range(0x3100) if chr(i).isspace()}
    rows = [("iva", True), ("x iva", True), ("iva x", True), ("\U0001f388iva", False), ("iva\U0001f388", False), ("ñiva", False), ("iva.", False), (".iva", False), ("ivan iva", True), ("", False)]
    df = spark.createDataFrame(rows, "t string, has boolean")
    assert df.where(text.has_word(F.col("t"), zones.PRICE_WORDS) != F.col("has")).count() == 0


def test_a_cell_begins_after_its_last_opening_tag(spark):
    markup = [
        ("<tr><th>a<td>b</td></tr>", [[("b", True)]]),
        ("<tr><td>a<td </td><td>c</td></tr>", [[("", False), ("c", False)]]),
        ("<tr><td>a</td><tr><th x='>'>b</th></tr><tr><td <td>d</td></tr>", [[("'>b", True)], [("d", False)]]),
        ("<tr><td>a</td><tr </tr><tr>b</tr>", []),
    ]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(markup)], "i int, html string")
    got = {r.i: [[tuple(c) for c in row] for row in r.cells] for r in df.select("i", html.cells(F.col("html")).alias("cells")).collect()}
    assert got == {i: rows for i, (_, rows) in enumerate(markup)}
    assert _plan(df.select(html.entity_text(F.col("html"), html.cells(F.col("html"))).alias("t"))).count("{6,}") == 1
