"""Derived document texts, OCR items, pages with regions, HTML tables and model answers.

Each order becomes one document; the lines of the given documents and the given HTML
pages are used as they are. All of it is row-wise, so nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billgrain.functions.pin import pin
from billgrain.plans import corpora


def _amount(cents: str, mark: str = ",") -> str:
    """SQL for a non-negative amount in cents with two decimals."""
    return f"concat(cast(({cents}) div 100 AS string), '{mark}', lpad(cast(({cents}) % 100 AS string), 2, '0'))"


TEXT_LINES = f"""
concat(
  array(
    concat('Proveedor ', cast(k % 100 AS string), ' S.L.'),
    CASE cast(k % 6 AS int)
      WHEN 0 THEN concat('info@proveedor-', cast(k % 100 AS string), '.es')
      WHEN 1 THEN 'Tel 922.272.555'
      WHEN 2 THEN 'Teléfono de atención: Tel. 922 272 555'
      WHEN 3 THEN concat('www.proveedor', cast(k % 100 AS string), '.com')
      WHEN 4 THEN 'IBAN ES91 2100 0418 4502 0005 1332'
      ELSE 'ñandú@acme.es' END,
    CASE cast(k % 4 AS int)
      WHEN 0 THEN concat('Cliente: Customer#', lpad(cast(c AS string), 9, '0'))
      WHEN 1 THEN 'FACTURAR A: Receptor S.A.'
      WHEN 2 THEN concat('Destinatario ', cast(c AS string))
      ELSE 'Sr. D. ' END,
    CASE cast(k % 3 AS int)
      WHEN 0 THEN concat('Calle Mayor ', cast(k % 200 AS string), ', Madrid')
      WHEN 1 THEN concat(cast(38000 + k % 1000 AS string), ' Santa Cruz de Tenerife')
      ELSE 'Urbanización Sol' END,
    CASE cast(k % 5 AS int)
      WHEN 0 THEN concat('N.I.F: B', lpad(cast(k * 7919 % 100000000 AS string), 8, '0'))
      WHEN 1 THEN concat('CIF A-', lpad(cast(k * 31 % 10000000 AS string), 7, '0'), '-', cast(k % 10 AS string))
      WHEN 2 THEN concat('DNI ', lpad(cast(k * 7919 % 100000000 AS string), 8, '0'),
                         substr('TRWAGMYFPDXBNJZSQVHLCKE', cast(k * 7919 % 100000000 % 23 + 1 AS int), 1))
      WHEN 3 THEN concat('NIE X', lpad(cast(k * 7919 % 10000000 AS string), 7, '0'), 'A')
      ELSE 'Inscrita en el Registro Mercantil, CIF B38247367' END,
    CASE cast(k % 4 AS int)
      WHEN 0 THEN concat('Fecha: ', cast(day(day) AS string), ' de ', cast(month(day) AS string), ' de ', cast(year(day) AS string))
      WHEN 1 THEN concat('Fecha: ', cast(day(day) AS string), '.', cast(month(day) AS string), '.', cast(year(day) AS string))
      WHEN 2 THEN concat('Fecha: ', cast(day(day) AS string), '/', cast(month(day) AS string), '/', cast(year(day) AS string))
      ELSE 'Fecha: 31/2/2024' END),
  transform(it, x -> concat('SKU-', cast(x.i AS string), ' Part ', cast((k * 31 + x.i) % 200 AS string), ' ',
     cast(abs(x.q) AS string), ',000 ', {_amount('x.p')}, ' ', cast((k + x.i) % 9 + 1 AS string), ',00 ',
     CASE WHEN k % 13 = 0 THEN '' ELSE concat({_amount('abs(x.q * x.p)')}, ' ') END, '21,0')),
  array(
    CASE cast(k % 5 AS int)
      WHEN 0 THEN concat('IVA 21%: ', {_amount('abs(tax)')}, '€')
      WHEN 1 THEN 'IGIC 7%'
      WHEN 2 THEN concat('VAT (20%): £', {_amount('abs(tax)', '.')})
      WHEN 3 THEN concat('GST (8.5%): $', {_amount('abs(tax)', '.')})
      ELSE 'Exento' END,
    CASE WHEN k % 8 = 0 THEN 'Impuesto electricidad: 2,16€' ELSE 'Gracias por su visita' END,
    CASE WHEN k % 6 = 2 THEN concat(cast(k % 20 + 1 AS string), '.', cast(k % 900 + 100 AS string), ' kW × ', cast(k % 28 + 1 AS string),
         ' días × 0.', cast(k % 9000 + 1000 AS string), ' €/kW día = ', {_amount('k % 9999')}, ' €') ELSE 'Energía consumida' END,
    CASE cast(k % 7 AS int) WHEN 0 THEN 'Recargo del 20%: 7,05' WHEN 1 THEN 'Alquiler del contador 0,72'
      WHEN 2 THEN 'Otros conceptos 1,00' ELSE 'Potencia contratada 12,50' END,
    CASE cast(k % 8 AS int) WHEN 0 THEN 'Forma de pago: Transferencia bancaria' WHEN 1 THEN 'Pago con tarjeta'
      WHEN 2 THEN 'Efectivo' WHEN 3 THEN 'Cheque nominativo' WHEN 4 THEN 'Domiciliación bancaria'
      WHEN 5 THEN 'Wire transfer' WHEN 6 THEN 'Direct debit' ELSE 'Pago aplazado' END,
    concat('TOTAL: ', {_amount('abs(total)')},
      CASE cast(k % 7 AS int) WHEN 0 THEN ' €' WHEN 1 THEN ' $' WHEN 2 THEN ' £' WHEN 3 THEN ' EUR' WHEN 4 THEN ' GBP' WHEN 5 THEN ' ¥' ELSE '' END)))
"""


def invoice_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, the order columns, ``text_lines`` and the whole ``text`` of every order."""
    rows = pin(corpora.order_amounts(corpora.orders(spark, sf_dir)), text_lines=F.expr(TEXT_LINES))
    return rows.withColumn("text", F.array_join("text_lines", "\n"))


def invoices_with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the invoice struct and the text it was read from."""
    rows = pin(invoice_texts(spark, sf_dir), invoice=corpora.invoice_column())
    return rows.select(F.col("k").alias("doc_id"), "invoice", "text")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.spread(corpora.table(spark, sf_dir, "documents"))


# Box and confidence of line number i (from 0) of document k.
ITEM = """
transform(text_lines, (t, i) -> named_struct(
  'text', t,
  'confidence', cast((k * 31 + i * 17) % 100 AS double) / 100,
  'bbox', CASE
     WHEN (k + i) % 29 = 0 THEN array(1D, 2D, 3D)
     WHEN k % 7 = 3 THEN array(x1, y1, x1 + 200, y1, x1 + 200, y1 + 20, x1, y1 + 20)
     ELSE array(x1, y1, x1 + 200, y1 + 20) END,
  'pos', i))
""".replace("x1", "cast(40 + (i % 3) * 250 AS double)").replace("y1", "cast((i * 47 + k * 13) % 980 AS double)")


def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    ours = invoice_texts(spark, sf_dir).select(F.lit("inv").alias("src"), "k", "text_lines")
    given = documents(spark, sf_dir).select(
        F.lit("doc").alias("src"), F.col("doc_id").alias("k"), F.split("text", "\n").alias("text_lines")
    )
    return ours.unionByName(given)


PAGE = ("src", "k AS doc_id", "1000D AS height", "800D AS width")


def ocr_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of text items per document: src, doc_id, height, width, items."""
    return _paged(spark, sf_dir).selectExpr(*PAGE, f"{ITEM} AS items")


def ocr_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same items, one row each."""
    items = _paged(spark, sf_dir).selectExpr(*PAGE, f"explode({ITEM}) AS item")
    return items.select("src", "doc_id", "height", "width", "item.*")


RAW_ITEMS = """
concat('[', array_join(transform(text_lines, (t, i) ->
  CASE cast((k + i) % 8 AS int)
    WHEN 0 THEN concat('{"text":"', t, '","confidence":0.9,"text_region":[[1,2],[3,4],[5,6],[7,', cast(i AS string), ']]}')
    WHEN 1 THEN concat('{"text":"', t, '","confidence":0.5,"bbox":[1.5,2,3,', cast(i AS string), ']}')
    WHEN 2 THEN concat('{"text":"', t, '"}')
    WHEN 3 THEN concat('[[[1,2],[3,4],[5,6],[7,8]],["', t, '",0.75]]')
    WHEN 4 THEN concat('[[1,2,3,4],"', t, '"]')
    WHEN 5 THEN concat('{"text":"  ","bbox":[1,2,3,4]}')
    WHEN 6 THEN '["only one"]'
    ELSE concat('{"text":"', t, '","text_region":[],"bbox":[9,9,9]}') END), ','), ']')
"""


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR items as JSON text in all the shapes they come in."""
    return invoice_texts(spark, sf_dir).select(F.col("k").alias("doc_id"), F.expr(RAW_ITEMS).alias("raw"))


# --- HTML -------------------------------------------------------------------------

HTML = f"""
concat('<table border="1"><tr class="x"><!-- top -->',
  CASE WHEN k % 10 = 3 THEN '<th>Concepto</th><th>HONORARIOS</th><th>SUPLIDOS</th><th>PROVISIONES</th></tr>'
       WHEN k % 3 = 1 THEN '</tr>'
       ELSE '<th>Descripción</th><th>Cantidad</th><th><b>Precio</b> unitario</th><th>Total, EUR</th></tr>' END,
  CASE WHEN k % 4 = 2 THEN concat('<tr><td>info@proveedor', cast(k % 100 AS string), '.es</td><td>Tel: 922272555</td><td>es91 2100</td></tr>') ELSE '' END,
  array_join(transform(it, x -> concat('<tr><td>Part, ', cast((k * 31 + x.i) % 200 AS string),
     CASE WHEN (k + x.i) % 4 = 0 THEN ' &amp; co' WHEN (k + x.i) % 4 = 1 THEN ' &lt;i&gt;n&amp;lt;' ELSE '' END, '</td>',
     CASE WHEN k % 10 = 3 THEN concat('<td>0.00</td><td>', {_amount('abs(x.t)', '.')}, '</td><td> 0.00 </td>')
          ELSE concat('<td>', cast(x.q AS string), '</td><td> ', {_amount('x.p', '.')}, ' </td>',
            CASE WHEN (k + x.i) % 6 = 0 THEN '' ELSE concat('<td>', {_amount('abs(x.t)', '.')}, '</td>') END,
            CASE WHEN (k + x.i) % 6 = 1 THEN '<td></td><td>extra</td>' ELSE '' END) END, '</tr>')), ''),
  '</table>')
"""


def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_num, table_num and the HTML of one table per order; some are empty."""
    return pin(
        corpora.order_items(corpora.orders(spark, sf_dir)),
        html=F.expr(f"CASE WHEN k % 14 = 0 THEN '' WHEN k % 38 = 1 THEN '<p>sin  tabla</p>' ELSE {HTML} END"),
    ).select(
        F.col("k").alias("doc_id"),
        (F.col("k") % 3 + 1).cast("int").alias("page_num"),
        (F.col("k") % 2 + 1).cast("int").alias("table_num"),
        "html",
    )


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.spread(corpora.table(spark, sf_dir, "pages"))


# --- pages with regions -----------------------------------------------------------

_TYPED = "struct<type:string,bbox:array<double>,res_kind:string,html:string,text:string,items:array<struct<text:string,confidence:double,bbox:array<double>,pos:int>>>"

REGIONS = f"""
CAST(concat(
  CASE WHEN k % 6 = 0 THEN array() ELSE array(
    named_struct('type', element_at(array('text', 'title', 'figure'), cast(k % 3 AS int) + 1), 'bbox', array(40D, 10D, 700D, 200D),
      'res_kind', 'list', 'html', CAST(NULL AS string), 'text', CAST(NULL AS string), 'items', items)) END,
  array(
    named_struct('type', 'table', 'bbox', CASE WHEN k % 4 = 0 THEN array(10D, 10D, 790D, 900D) WHEN k % 4 = 1 THEN array(50D, 10D, 790D, 900D) ELSE array(60D, 210D, 700D, 600D) END,
      'res_kind', 'dict', 'html', html, 'text', CAST(NULL AS string), 'items', CAST(NULL AS array<struct<text:string,confidence:double,bbox:array<double>,pos:int>>)),
    named_struct('type', 'text', 'bbox', CAST(NULL AS array<double>), 'res_kind', 'str', 'html', CAST(NULL AS string),
      'text', CASE WHEN k % 9 = 0 THEN '' ELSE text_lines[4] END, 'items', CAST(NULL AS array<struct<text:string,confidence:double,bbox:array<double>,pos:int>>)),
    named_struct('type', element_at(array('header', 'footer', 'reference', 'equation', NULL), cast(k % 5 AS int) + 1), 'bbox', array(0D, 950D, 800D, 990D),
      'res_kind', 'dict', 'html', CAST(NULL AS string), 'text', CASE WHEN k % 6 = 1 THEN '' ELSE text_lines[1] END,
      'items', CAST(NULL AS array<struct<text:string,confidence:double,bbox:array<double>,pos:int>>))),
  CASE WHEN k % 3 = 0 THEN array(named_struct('type', 'table', 'bbox', array(60D, 610D, 700D, 900D), 'res_kind', 'dict',
      'html', '<table><tr><td>IVA, 21%</td><td>' || cast(k AS string) || '</td></tr></table>', 'text', CAST(NULL AS string),
      'items', CAST(NULL AS array<struct<text:string,confidence:double,bbox:array<double>,pos:int>>))) ELSE array() END)
 AS array<{_TYPED}>)
"""


def region_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per order: doc_id, page_number, height, width, regions (array)."""
    # plain columns: what stands outside of lambdas is compiled, which a generator like that of ``pin`` is not
    rows = invoice_texts(spark, sf_dir).withColumns({
        "html": F.expr(f"CASE WHEN k % 14 = 0 THEN '' WHEN k % 38 = 1 THEN '<p>sin  tabla</p>' ELSE {HTML} END"),
        "items": F.expr(ITEM),
    })
    regions = F.expr(f"CASE WHEN k % 44 = 0 THEN CAST(array() AS array<{_TYPED}>) ELSE {REGIONS} END")
    return rows.withColumn("regions", regions).select(
        F.col("k").alias("doc_id"),
        (F.col("k") % 3 + 1).cast("int").alias("page_number"),
        F.lit(1000.0).alias("height"),
        F.lit(800.0).alias("width"),
        "regions",
    )


def table_mode_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages as a second extraction sees them: one table over the whole page."""
    region = f"""CAST(array(named_struct('type', 'table', 'bbox', array(5D, 5D, 795D, 990D), 'res_kind', 'dict', 'html', html,
      'text', CAST(NULL AS string), 'items', CAST(NULL AS array<struct<text:string,confidence:double,bbox:array<double>,pos:int>>))) AS array<{_TYPED}>)"""
    return html_tables(spark, sf_dir).select(
        "doc_id",
        F.col("page_num").alias("page_number"),
        F.lit(1000.0).alias("height"),
        F.lit(800.0).alias("width"),
        F.expr(region).alias("regions"),
    )


# --- model answers ----------------------------------------------------------------

ANSWER = f"""
concat(
  CASE WHEN k % 2 = 0 THEN '```json\\n' ELSE '  ' END,
  '{{"metadata":{{"invoice_number":"2025/', cast(k AS string), '","issue_date":',
     CASE WHEN k % 10 = 0 THEN 'null' ELSE concat('"', date_format(day, 'yyyy-MM-dd'), '"') END, '}},',
  CASE WHEN k % 3 = 0 THEN ' # número "de" control\\n' ELSE '' END,
  '"parties":{{"vendor":{{"name":"Supplier # ', cast(k % 100 AS string), '"',
     CASE WHEN k % 8 = 0 THEN '' ELSE ',"tax_id":"B12345678"' END, '}},"customer":',
     CASE WHEN k % 26 = 0 THEN 'null' WHEN k % 34 = 0 THEN '{{}}' ELSE '{{"name":"Receptor"}}' END, '}},',
  '"financial_details":{{"currency":', CASE WHEN k % 11 = 0 THEN '"euro"' WHEN k % 15 = 0 THEN 'null' ELSE '"EUR"' END,
     CASE WHEN k % 7 = 0 THEN '' ELSE concat(',"subtotal":', CASE WHEN k % 9 = 1 THEN '"' ELSE '' END,
         CASE WHEN stated < 0 THEN '-' ELSE '' END, {_amount('abs(stated)', '.')}, CASE WHEN k % 9 = 1 THEN '"' ELSE '' END) END,
     ',"tax":{{"type":', CASE WHEN k % 53 = 0 THEN '21' ELSE '"IVA"' END, ',"rate":21.0,"amount":', CASE WHEN tax < 0 THEN '-' ELSE '' END, {_amount('abs(tax)', '.')}, '}},',
     '"total_amount":', CASE WHEN k % 59 = 0 THEN '"12,5"' ELSE concat(CASE WHEN total < 0 THEN '-' ELSE '' END, {_amount('abs(total)', '.')}) END,
     CASE WHEN k % 17 = 0 THEN ',"payment":{{"method":"BARTER"}}' ELSE ',"payment":{{"method":"CARD"}}' END, '}},',
  '"items":[',
  array_join(transform(it, x -> concat('{{"description":"Part ', CASE WHEN k % 12 = 7 THEN '[' ELSE '' END, cast((k * 31 + x.i) % 200 AS string), '","quantity":', cast(x.q AS string),
     ',"unit_price":', {_amount('x.p', '.')}, ',"line_total":', CASE WHEN x.t < 0 THEN '-' ELSE '' END, {_amount('abs(x.t)', '.')}, '}}')),
     CASE WHEN k % 5 = 0 THEN ',' ELSE ', ' END),
  CASE WHEN k % 5 = 1 THEN '' WHEN k % 5 = 2 THEN ',{{"description":"cut' ELSE ']' END,
  CASE WHEN k % 5 = 1 THEN '' WHEN k % 5 = 2 THEN '' ELSE concat(CASE WHEN k % 6 = 0 THEN ',"origin":"ocr"' ELSE '' END, '}}') END,
  CASE WHEN k % 31 = 3 THEN ' trailing' ELSE '' END,
  CASE WHEN k % 4 = 0 THEN '\\n```' WHEN k % 4 = 2 THEN '```' ELSE '  \\n' END)
"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source and the raw answer text of every order."""
    return pin(corpora.order_amounts(corpora.orders(spark, sf_dir)), raw=F.expr(ANSWER)).select(
        F.col("k").alias("doc_id"), F.concat(F.lit("model"), (F.col("k") % 4).cast("string")).alias("source"), "raw"
    )
