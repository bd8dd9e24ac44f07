"""Invoice-shaped inputs derived from the given tables, one whole table at a time.

The given tables hold orders, lines, documents, pages and events but no invoices, so
every corpus below maps each input row to an invoice-shaped record with integer
arithmetic only. Nothing is sampled. The nested corpora need no shuffle; the line
corpus is one aggregation with map-side combine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billgrain.functions.pin import pin
from billgrain.functions.schema import INVOICE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task of costly row-wise work.
TASK_ROWS = 25_000


def spread(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """Give costly row-wise work all cores, and tasks that do not grow with the table.

    How many splits a file has says nothing about its row groups: one of millions of rows is the
    work of one task, and the other splits are empty. So the rows of the splits are counted (from
    the footers alone). Rows are dealt out where a split holds more than four tasks' worth or
    fewer splits than cores hold any; a table of small splits is read as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("n"))
    held = splits.agg(F.count(F.lit(1)).alias("splits"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    if held["splits"] >= cores and held["most"] <= 4 * rows:
        return df
    return df.repartition(max(cores, -(-held["rows"] // rows)))


# --- invoices, one row per order --------------------------------------------------

ITEM_COUNT = "CASE WHEN k % 37 = 0 THEN 0 ELSE 1 + k % 4 END"
ITEM_CENTS = """
  CASE WHEN k % 37 = 0 THEN array() ELSE transform(sequence(1L, 1 + k % 4), i -> named_struct(
    'i', i,
    'q', (1 + (k * 7 + i * 3) % 9)
         * CASE WHEN (k + i) % 71 = 0 THEN 0 WHEN (k + i) % 83 = 0 THEN -1 ELSE 1 END,
    'p', CASE WHEN k % 17 = 0 THEN element_at(array(0L, 300L, 700L, 1500L, 2100L), cast((k + i) % 5 AS int) + 1)
              ELSE 101 + (k * 13 + i * 29 + c) % 9000 END)) END
"""
ITEM_TOTALS = """
  transform(raw, x -> named_struct('i', x.i, 'q', x.q, 'p', x.p, 't',
    CASE WHEN (k + x.i) % 5 = 0 THEN ((k + x.i) % 9 + 1) * 100
         WHEN (k + x.i) % 53 = 0 THEN -(x.q * x.p)
         ELSE x.q * x.p END))
"""


def order_items(orders: DataFrame) -> DataFrame:
    """k, c, day and the items in cents (array of i, q, p, t) of every order."""
    rows = orders.select(
        F.col("o_orderkey").alias("k"),
        F.col("o_custkey").alias("c"),
        F.col("o_orderdate").cast("date").alias("day"),
    ).withColumn("raw", F.expr(ITEM_CENTS))
    return pin(rows, it=F.expr(ITEM_TOTALS)).drop("raw")


def order_amounts(orders: DataFrame) -> DataFrame:
    """The items plus all header amounts in cents. NULL means the part is absent."""
    rows = pin(order_items(orders), st=F.expr("aggregate(it, 0L, (a, x) -> a + x.t)"))
    return rows.selectExpr(
        "*",
        "st + CASE WHEN k % 7 = 0 THEN 500 ELSE 0 END + CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END"
        " + CASE WHEN k % 26 = 0 THEN 2 ELSE 0 END AS stated",
        "CASE WHEN k % 19 = 0 THEN 150 WHEN k % 21 = 0 THEN 0 WHEN k % 33 = 0 THEN -4 ELSE 21 END AS rate",
        "(st - st % 5) div 5 AS tax",
        "CASE WHEN k % 4 = 0 THEN 216L END AS extra",
        "CASE WHEN k % 23 = 0 THEN abs(st) + 1000 WHEN k % 3 = 0 THEN 150L END AS disc",
        "CASE WHEN k % 5 = 0 THEN 250L END AS sur",
        "CASE WHEN k % 29 = 0 THEN -300L WHEN k % 6 = 1 THEN 300L END AS wh",
    ).withColumn(
        "base",
        F.expr("st + tax + coalesce(extra, 0) - coalesce(disc, 0) + coalesce(sur, 0) - coalesce(wh, 0)"),
    ).withColumn(
        "total",
        F.expr(
            "CASE WHEN k % 31 = 0 THEN -abs(base) ELSE base + CASE WHEN k % 11 = 0 THEN 3000 ELSE 0 END"
            " + CASE WHEN k % 12 = 0 THEN 5 ELSE 0 END + CASE WHEN k % 13 = 0 THEN 2 ELSE 0 END END"
        ),
    )


INVOICE_SQL = """
      named_struct(
        'metadata', named_struct(
          'invoice_number', concat('2025/', cast(k AS string)),
          'issue_date', CASE WHEN k % 10 = 0 THEN NULL WHEN k % 14 = 0 THEN '' ELSE date_format(day, 'yyyy-MM-dd') END,
          'due_date', CASE WHEN k % 4 = 1 THEN date_format(date_add(day, 30), 'yyyy-MM-dd') WHEN k % 4 = 2 THEN '30 days' END,
          'order_number', CAST(NULL AS string)),
        'notes', CAST(NULL AS string),
        'parties', named_struct(
          'vendor', named_struct(
            'name', CASE WHEN k % 41 = 0 THEN '' ELSE concat('Supplier ', cast(k % 100 AS string)) END,
            'tax_id', CASE WHEN k % 8 = 0 THEN NULL WHEN k % 9 = 0 THEN ''
                           ELSE concat('B', lpad(cast(k * 7919 % 100000000 AS string), 8, '0')) END,
            'contact', named_struct('email', concat('info@proveedor', cast(k % 100 AS string), '.es'),
                                    'phone', CAST(NULL AS string), 'fax', CAST(NULL AS string)),
            'address', named_struct('street', 'Calle Mayor 1', 'city', 'Oviedo', 'state', CAST(NULL AS string),
                                    'postal_code', CAST(NULL AS string), 'country', 'ES')),
          'customer', named_struct(
            'name', CASE WHEN k % 59 = 0 THEN '' ELSE concat('Customer#', lpad(cast(c AS string), 9, '0')) END,
            'tax_id', CAST(NULL AS string),
            'contact', CAST(NULL AS struct<email:string,phone:string,fax:string>),
            'address', CAST(NULL AS struct<street:string,city:string,state:string,postal_code:string,country:string>))),
        'financial_details', named_struct(
          'currency', CASE WHEN k % 15 = 0 THEN NULL WHEN k % 2 = 0 THEN 'EUR' ELSE 'USD' END,
          'subtotal', CASE WHEN k % 47 = 0 THEN double('NaN') ELSE cast(stated AS double) / 100 END,
          'discount', CASE WHEN disc IS NOT NULL THEN named_struct('description', 'Dto.', 'rate', CAST(NULL AS double),
                                                                   'amount', cast(disc AS double) / 100) END,
          'tax', named_struct('type', 'IVA', 'rate', cast(rate AS double), 'amount', cast(tax AS double) / 100,
                              'taxable_base', CAST(NULL AS double)),
          'additional_taxes', CASE WHEN extra IS NULL THEN CAST(array() AS array<struct<type:string,rate:double,amount:double,taxable_base:double>>)
             ELSE array(named_struct('type', 'Impuesto electricidad', 'rate', 0D, 'amount', cast(extra AS double) / 100,
                                     'taxable_base', CAST(NULL AS double))) END,
          'withholding', CASE WHEN wh IS NOT NULL THEN named_struct('type', 'IRPF', 'rate', 15D, 'amount', cast(wh AS double) / 100) END,
          'surcharges', CASE WHEN sur IS NULL THEN CAST(array() AS array<struct<description:string,amount:double>>)
             ELSE array(named_struct('description', 'Recargo', 'amount', cast(sur AS double) / 100)) END,
          'total_amount', cast(total AS double) / 100,
          'payment', named_struct('method', 'BANK_TRANSFER', 'number', CAST(NULL AS string))),
        'items', transform(it, x -> named_struct(
          'item_id', concat('SKU-', cast(x.i AS string)),
          'description', concat('Part ', cast((k * 31 + x.i) % 200 AS string)),
          'quantity', cast(x.q AS double),
          'unit_price', cast(x.p AS double) / 100,
          'line_total', cast(x.t AS double) / 100)),
        'extensions', parse_json(CASE
            WHEN k % 43 = 0 THEN '{"multi_period_invoice":{"has_regularizations":true}}'
            WHEN k % 61 = 0 THEN '{"multi_period_invoice":null}'
            WHEN k % 67 = 0 THEN '{"multi_period_invoice":{"has_regularizations":""}}' END))
"""


def invoice_column() -> Column:
    """The invoice struct over a row of order amounts; NULL where structuring failed."""
    return F.expr(f"CASE WHEN k % 97 <> 0 THEN {INVOICE_SQL} END").cast(INVOICE)


def invoices_from(orders: DataFrame) -> DataFrame:
    """doc_id and the invoice struct of every order; works on a stream as well."""
    rows = pin(order_amounts(orders), invoice=invoice_column())
    return rows.select(F.col("k").alias("doc_id"), "invoice")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"))


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invoices_from(orders(spark, sf_dir))


# --- lines, one row per order line ------------------------------------------------


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One invoice line per (order, line number), all rows of a line added up.

    The aggregation combines on the map side, so an order holding a large share of
    the table arrives at its reducer as a handful of partial sums.
    """
    src = table(spark, sf_dir, "lineitem")
    summed = (
        src.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line_no"))
        .agg(
            F.sum(F.round("l_quantity").cast("bigint")).alias("qty"),
            F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("net"),
            F.min("l_partkey").alias("partkey"),
            F.max(F.round(F.col("l_discount") * 100).cast("bigint")).alias("disc"),
            F.max(F.round(F.col("l_tax") * 100).cast("bigint")).alias("tax"),
        )
    )
    return summed.selectExpr(
        "doc_id", "line_no", "partkey", "disc", "tax", "net",
        "concat('Part ', cast(partkey AS string)) AS description",
        "CASE WHEN (doc_id + line_no) % 97 = 0 THEN -qty ELSE qty END AS qty",
        "CASE WHEN doc_id % 17 = 0 THEN element_at(array(0L, 300L, 700L, 1500L, 2100L), cast((doc_id + line_no) % 5 AS int) + 1)"
        "     ELSE net div greatest(qty, 1) END AS price",
        "CASE WHEN (doc_id + line_no) % 5 = 0 THEN disc * 100"
        "     WHEN (doc_id + line_no) % 53 = 0 THEN -net ELSE net END AS total",
    )


def line_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as amounts: doc_id, line_no, description, quantity, unit_price, line_total."""
    return lines(spark, sf_dir).selectExpr(
        "doc_id", "line_no", "description",
        "cast(qty AS double) AS quantity",
        "cast(price AS double) / 100 AS unit_price",
        "cast(total AS double) / 100 AS line_total",
    )


def line_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated subtotal of every order, 0.00 without lines; some are off by 5.00, 0.02 or 0.01."""
    sums = lines(spark, sf_dir).groupBy("doc_id").agg(F.sum("total").alias("st"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_custkey")
    return orders.join(sums, "doc_id", "left").withColumn("st", F.coalesce("st", F.lit(0))).selectExpr(
        "doc_id",
        "o_custkey AS custkey",
        "cast(st + CASE WHEN doc_id % 7 = 0 THEN 500 ELSE 0 END + CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END"
        " + CASE WHEN doc_id % 26 = 0 THEN 2 ELSE 0 END AS double) / 100 AS subtotal",
    )


def line_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The printed row of every line: doc_id, line_no, text. Some documents print no totals."""
    def amount(cents: str) -> str:
        return f"concat(cast(({cents}) div 100 AS string), ',', lpad(cast(({cents}) % 100 AS string), 2, '0'))"

    printed = f"CASE WHEN doc_id % 13 = 0 THEN '' ELSE concat({amount('net')}, ' ') END"
    return lines(spark, sf_dir).selectExpr(
        "doc_id", "line_no",
        f"concat(description, ' ', cast(abs(qty) AS string), ',000 ', {amount('price')}, ' ', cast(disc AS string), ',00 ',"
        f" {printed}, cast(tax AS string), ',0') AS text",
    )
