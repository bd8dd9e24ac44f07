"""Common table expressions for the derived corpora."""

ITEMS = """
raw AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS day FROM orders),
exploded AS (SELECT k, c, unnest(range(1, 2 + k % 4)) AS i FROM raw WHERE k % 37 <> 0),
priced AS (
  SELECT k, i,
    (1 + (k * 7 + i * 3) % 9)
      * CASE WHEN (k + i) % 71 = 0 THEN 0 WHEN (k + i) % 83 = 0 THEN -1 ELSE 1 END AS q,
    CASE WHEN k % 17 = 0 THEN [0, 300, 700, 1500, 2100][CAST((k + i) % 5 AS INT) + 1]
         ELSE 101 + (k * 13 + i * 29 + c) % 9000 END AS p
  FROM exploded),
item AS (
  SELECT k, i, q, p,
    CASE WHEN (k + i) % 5 = 0 THEN ((k + i) % 9 + 1) * 100
         WHEN (k + i) % 53 = 0 THEN -(q * p) ELSE q * p END AS t,
    'Part ' || ((k * 31 + i) % 200) AS descr
  FROM priced)
"""

# One row per order with every amount of the invoice as DOUBLE.
HEADS = ITEMS + """,
sums AS (SELECT k, count(*) AS n, CAST(sum(t) AS BIGINT) AS st FROM item GROUP BY k),
amounts AS (
  SELECT raw.k, c, day, coalesce(n, 0) AS n, coalesce(st, 0) AS st,
    CASE WHEN raw.k % 19 = 0 THEN 150 WHEN raw.k % 21 = 0 THEN 0 WHEN raw.k % 33 = 0 THEN -4 ELSE 21 END AS rate,
    (coalesce(st, 0) - coalesce(st, 0) % 5) // 5 AS tax,
    CASE WHEN raw.k % 4 = 0 THEN 216 END AS extra,
    CASE WHEN raw.k % 23 = 0 THEN abs(coalesce(st, 0)) + 1000 WHEN raw.k % 3 = 0 THEN 150 END AS disc,
    CASE WHEN raw.k % 5 = 0 THEN 250 END AS sur,
    CASE WHEN raw.k % 29 = 0 THEN -300 WHEN raw.k % 6 = 1 THEN 300 END AS wh
  FROM raw LEFT JOIN sums ON raw.k = sums.k),
based AS (
  SELECT *, st + tax + coalesce(extra, 0) - coalesce(disc, 0) + coalesce(sur, 0) - coalesce(wh, 0) AS base,
    st + CASE WHEN k % 7 = 0 THEN 500 ELSE 0 END + CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END
       + CASE WHEN k % 26 = 0 THEN 2 ELSE 0 END AS stated
  FROM amounts),
head AS (
  SELECT k AS doc_id, c, day, n,
    CASE WHEN k % 41 = 0 THEN '' ELSE 'Supplier ' || (k % 100) END AS vendor,
    CASE WHEN k % 8 = 0 THEN NULL WHEN k % 9 = 0 THEN ''
         ELSE 'B' || lpad(CAST(k * 7919 % 100000000 AS VARCHAR), 8, '0') END AS vendor_tax,
    CASE WHEN k % 59 = 0 THEN '' ELSE 'Customer#' || lpad(CAST(c AS VARCHAR), 9, '0') END AS customer,
    CASE WHEN k % 10 = 0 THEN NULL WHEN k % 14 = 0 THEN '' ELSE strftime(day, '%Y-%m-%d') END AS issued,
    CASE WHEN k % 15 = 0 THEN NULL WHEN k % 2 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
    CAST(st AS DOUBLE) / 100 AS isum,
    CASE WHEN k % 47 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(stated AS DOUBLE) / 100 END AS subtotal,
    CAST(rate AS DOUBLE) AS rate, CAST(tax AS DOUBLE) / 100 AS tax,
    CAST(extra AS DOUBLE) / 100 AS extra, CAST(disc AS DOUBLE) / 100 AS disc,
    CAST(sur AS DOUBLE) / 100 AS sur, CAST(wh AS DOUBLE) / 100 AS wh,
    CAST(CASE WHEN k % 31 = 0 THEN -abs(base)
         ELSE base + CASE WHEN k % 11 = 0 THEN 3000 ELSE 0 END + CASE WHEN k % 12 = 0 THEN 5 ELSE 0 END
                   + CASE WHEN k % 13 = 0 THEN 2 ELSE 0 END END AS DOUBLE) / 100 AS total,
    CASE WHEN k % 43 = 0 THEN 'yes' WHEN k % 61 = 0 THEN 'unreadable' ELSE 'no' END AS flag,
    k % 97 = 0 AS failed
  FROM based)
"""

# Arithmetic and semantic checks, in that order.
CHECK_STEPS = """,
sub AS (
  SELECT *, n > 0 AND NOT isnan(abs(isum - subtotal)) AND abs(isum - subtotal) > 0.02 AS sub_bad FROM checked_head),
sub2 AS (SELECT *, CASE WHEN sub_bad THEN isum ELSE subtotal END AS fixed FROM sub),
calc AS (
  SELECT *,
    fixed + tax + coalesce(extra, 0) - coalesce(disc, 0) + coalesce(sur, 0) - coalesce(wh, 0) AS calculated,
    fixed - coalesce(disc, 0) + tax + coalesce(extra, 0) - abs(coalesce(wh, 0)) + coalesce(sur, 0) AS expected
  FROM sub2),
diffs AS (
  SELECT *, abs(calculated - total) AS tdiff, abs(expected - total) AS sdiff,
    CASE WHEN total > 0 THEN abs(expected - total) / total * 100 ELSE 0 END AS pct
  FROM calc),
ruled AS (
  SELECT *,
    NOT isnan(tdiff) AND tdiff > 0.02 AS tot_bad,
    rate < 0 OR rate > 100 AS rate_bad,
    coalesce(NOT isnan(fixed) AND disc > fixed, false) AS disc_bad,
    total < 0 AS neg_bad,
    CASE WHEN isnan(sdiff) OR NOT sdiff > 0.10 THEN 'ok'
         WHEN flag = 'unreadable' THEN 'unverified'
         WHEN flag = 'yes' OR (coalesce(abs(isum - fixed) <= 0.10 AND NOT isnan(fixed), false) AND pct < 30) THEN 'excused'
         ELSE 'error' END AS outcome
  FROM diffs),
texts AS (
  SELECT *,
    concat_ws(' | ',
      CASE WHEN vendor = '' THEN 'Vendor name is missing.' END,
      CASE WHEN customer = '' THEN 'Customer name is required' END,
      CASE WHEN total <= 0 THEN 'Total amount must be greater than zero' END,
      CASE WHEN n = 0 THEN 'At least one line item is required' END) AS req,
    CAST(vendor = '' AS INT) + CAST(customer = '' AS INT) + CAST(total <= 0 AS INT) + CAST(n = 0 AS INT) AS n_req,
    concat_ws(' | ',
      CASE WHEN coalesce(issued, '') = '' THEN 'Invoice date is missing' END,
      CASE WHEN coalesce(vendor_tax, '') = '' THEN 'Vendor tax ID is missing' END,
      CASE WHEN currency IS NULL THEN 'Currency is not specified' END) AS dq,
    CAST(coalesce(issued, '') = '' AS INT) + CAST(coalesce(vendor_tax, '') = '' AS INT)
      + CAST(currency IS NULL AS INT) AS n_dq,
    printf('Math error: expected %.2f ≠ actual %.2f (difference: %.2f, %.1f%%)', expected, total, sdiff, pct) AS math_text
  FROM ruled)
"""

CHECKS = HEADS + ", checked_head AS (SELECT * FROM head)" + CHECK_STEPS

NEGATIVE = """
neg AS (
  SELECT k AS doc_id, i, o, field, code, descr, value FROM (
    SELECT k, i, descr, unnest([
      {o: 1, field: 'line_total', code: 'negative_amount', value: CAST(t AS DOUBLE) / 100},
      {o: 2, field: 'unit_price', code: 'negative_price', value: CAST(p AS DOUBLE) / 100},
      {o: 3, field: 'quantity', code: 'negative_quantity', value: CAST(q AS DOUBLE)}], recursive := true)
    FROM item WHERE k % 97 <> 0) WHERE value < 0)
"""

LINES = """
merged AS (
  SELECT l_orderkey AS doc_id, l_linenumber AS line_no,
    CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS qty,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS net,
    min(l_partkey) AS partkey,
    max(CAST(round(l_discount * 100) AS BIGINT)) AS disc,
    max(CAST(round(l_tax * 100) AS BIGINT)) AS tax
  FROM lineitem GROUP BY 1, 2),
line AS (
  SELECT doc_id, line_no, partkey, disc, tax, net, 'Part ' || partkey AS description,
    CASE WHEN (doc_id + line_no) % 97 = 0 THEN -qty ELSE qty END AS qty_c,
    CASE WHEN doc_id % 17 = 0 THEN [0, 300, 700, 1500, 2100][CAST((doc_id + line_no) % 5 AS INT) + 1]
         ELSE net // greatest(CASE WHEN (doc_id + line_no) % 97 = 0 THEN qty ELSE qty END, 1) END AS price_c,
    CASE WHEN (doc_id + line_no) % 5 = 0 THEN disc * 100
         WHEN (doc_id + line_no) % 53 = 0 THEN -net ELSE net END AS total_c
  FROM merged),
rec AS (
  SELECT doc_id, line_no, description, partkey, disc, tax, net, total_c, price_c, qty_c,
    CAST(qty_c AS DOUBLE) AS quantity, CAST(price_c AS DOUBLE) / 100 AS unit_price,
    CAST(total_c AS DOUBLE) / 100 AS line_total
  FROM line),
facts AS (
  SELECT doc_id, count(*) AS n_items, CAST(CAST(sum(total_c) AS BIGINT) AS DOUBLE) / 100 AS items_sum,
    count(*) FILTER (WHERE price_c IN (0, 300, 700, 1500, 2100)) AS n_rate_like, CAST(sum(total_c) AS BIGINT) AS st
  FROM line GROUP BY doc_id),
stated AS (
  SELECT o_orderkey AS doc_id, o_custkey AS custkey, n_items, items_sum, n_rate_like,
    CAST(coalesce(st, 0) + CASE WHEN o_orderkey % 7 = 0 THEN 500 ELSE 0 END + CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END
       + CASE WHEN o_orderkey % 26 = 0 THEN 2 ELSE 0 END AS DOUBLE) / 100 AS subtotal
  FROM orders LEFT JOIN facts ON o_orderkey = doc_id)
"""


def with_ctes(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + select.strip()


def amount(cents: str, mark: str = ",") -> str:
    return f"(({cents}) // 100) || '{mark}' || lpad(CAST(({cents}) % 100 AS VARCHAR), 2, '0')"


TEXTS = HEADS + f""",
item_lines AS (
  SELECT k, list('SKU-' || i || ' Part ' || ((k * 31 + i) % 200) || ' ' || abs(q) || ',000 ' || {amount('p')}
      || ' ' || ((k + i) % 9 + 1) || ',00 '
      || CASE WHEN k % 13 = 0 THEN '' ELSE {amount('abs(q * p)')} || ' ' END || '21,0' ORDER BY i) AS rows
  FROM item GROUP BY k),
totals AS (
  SELECT *, CASE WHEN k % 31 = 0 THEN -abs(base) ELSE base + CASE WHEN k % 11 = 0 THEN 3000 ELSE 0 END
    + CASE WHEN k % 12 = 0 THEN 5 ELSE 0 END + CASE WHEN k % 13 = 0 THEN 2 ELSE 0 END END AS total_c
  FROM based),
lined AS (
  SELECT t.k, c, day, t.tax AS tax_c, total_c, stated, st,
    list_concat([
      'Proveedor ' || (t.k % 100) || ' S.L.',
      CASE t.k % 6 WHEN 0 THEN 'info@proveedor-' || (t.k % 100) || '.es' WHEN 1 THEN 'Tel 922.272.555'
        WHEN 2 THEN 'Teléfono de atención: Tel. 922 272 555' WHEN 3 THEN 'www.proveedor' || (t.k % 100) || '.com'
        WHEN 4 THEN 'IBAN ES91 2100 0418 4502 0005 1332' ELSE 'ñandú@acme.es' END,
      CASE t.k % 4 WHEN 0 THEN 'Cliente: Customer#' || lpad(CAST(c AS VARCHAR), 9, '0')
        WHEN 1 THEN 'FACTURAR A: Receptor S.A.' WHEN 2 THEN 'Destinatario ' || c ELSE 'Sr. D. ' END,
      CASE t.k % 3 WHEN 0 THEN 'Calle Mayor ' || (t.k % 200) || ', Madrid'
        WHEN 1 THEN (38000 + t.k % 1000) || ' Santa Cruz de Tenerife' ELSE 'Urbanización Sol' END,
      CASE t.k % 5 WHEN 0 THEN 'N.I.F: B' || lpad(CAST(t.k * 7919 % 100000000 AS VARCHAR), 8, '0')
        WHEN 1 THEN 'CIF A-' || lpad(CAST(t.k * 31 % 10000000 AS VARCHAR), 7, '0') || '-' || (t.k % 10)
        WHEN 2 THEN 'DNI ' || lpad(CAST(t.k * 7919 % 100000000 AS VARCHAR), 8, '0')
           || substr('TRWAGMYFPDXBNJZSQVHLCKE', CAST(t.k * 7919 % 100000000 % 23 + 1 AS INT), 1)
        WHEN 3 THEN 'NIE X' || lpad(CAST(t.k * 7919 % 10000000 AS VARCHAR), 7, '0') || 'A'
        ELSE 'Inscrita en el Registro Mercantil, CIF B38247367' END,
      CASE t.k % 4 WHEN 0 THEN 'Fecha: ' || day(day) || ' de ' || month(day) || ' de ' || year(day)
        WHEN 1 THEN 'Fecha: ' || day(day) || '.' || month(day) || '.' || year(day)
        WHEN 2 THEN 'Fecha: ' || day(day) || '/' || month(day) || '/' || year(day)
        ELSE 'Fecha: 31/2/2024' END],
      coalesce(rows, []),
      [CASE t.k % 5 WHEN 0 THEN 'IVA 21%: ' || {amount('abs(t.tax)')} || '€' WHEN 1 THEN 'IGIC 7%'
         WHEN 2 THEN 'VAT (20%): £' || {amount('abs(t.tax)', '.')} WHEN 3 THEN 'GST (8.5%): $' || {amount('abs(t.tax)', '.')}
         ELSE 'Exento' END,
       CASE WHEN t.k % 8 = 0 THEN 'Impuesto electricidad: 2,16€' ELSE 'Gracias por su visita' END,
       CASE WHEN t.k % 6 = 2 THEN (t.k % 20 + 1) || '.' || (t.k % 900 + 100) || ' kW × ' || (t.k % 28 + 1) || ' días × 0.'
         || (t.k % 9000 + 1000) || ' €/kW día = ' || {amount('t.k % 9999')} || ' €' ELSE 'Energía consumida' END,
       CASE t.k % 7 WHEN 0 THEN 'Recargo del 20%: 7,05' WHEN 1 THEN 'Alquiler del contador 0,72'
         WHEN 2 THEN 'Otros conceptos 1,00' ELSE 'Potencia contratada 12,50' END,
       CASE t.k % 8 WHEN 0 THEN 'Forma de pago: Transferencia bancaria' WHEN 1 THEN 'Pago con tarjeta'
         WHEN 2 THEN 'Efectivo' WHEN 3 THEN 'Cheque nominativo' WHEN 4 THEN 'Domiciliación bancaria'
         WHEN 5 THEN 'Wire transfer' WHEN 6 THEN 'Direct debit' ELSE 'Pago aplazado' END,
       'TOTAL: ' || {amount('abs(total_c)')} || CASE t.k % 7 WHEN 0 THEN ' €' WHEN 1 THEN ' $' WHEN 2 THEN ' £'
         WHEN 3 THEN ' EUR' WHEN 4 THEN ' GBP' WHEN 5 THEN ' ¥' ELSE '' END]) AS text_lines
  FROM totals t LEFT JOIN item_lines l ON t.k = l.k),
text_line AS (SELECT k AS doc_id, unnest(text_lines) AS line, unnest(range(len(text_lines))) AS i FROM lined)
"""

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WC = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"

OCR = TEXTS + """,
pg AS (
  SELECT 'inv' AS src, k, text_lines FROM lined
  UNION ALL SELECT 'doc', doc_id, string_split(text, chr(10)) FROM documents),
numbered AS (
  SELECT src, k, unnest(text_lines) AS text, unnest(range(len(text_lines))) AS i FROM pg),
boxed AS (
  SELECT src, k AS doc_id, CAST(i AS INT) AS pos, text,
    CAST((k * 31 + i * 17) % 100 AS DOUBLE) / 100 AS confidence,
    (k + i) % 29 <> 0 AS valid,
    CAST(40 + (i % 3) * 250 AS DOUBLE) AS x1, CAST((i * 47 + k * 13) % 980 AS DOUBLE) AS y1
  FROM numbered),
geo AS (
  SELECT src, doc_id, pos, text, confidence, valid,
    CASE WHEN valid THEN x1 ELSE 0 END AS x1, CASE WHEN valid THEN y1 ELSE 0 END AS y1,
    CASE WHEN valid THEN x1 + 200 ELSE 0 END AS x2, CASE WHEN valid THEN y1 + 20 ELSE 0 END AS y2,
    CASE WHEN valid THEN x1 + 100 ELSE 400 END AS x, CASE WHEN valid THEN y1 + 10 ELSE 500 END AS y
  FROM boxed)
"""

# Words and phrases of the zone rules.
_ADDRESS = (
    "calle", "c/", "av.", "avda", "plaza", "street", "road",
    "paseo", "carretera", "urbanización", "edif", "edificio",
    "piso", "puerta", "pta", "bajo", "local",
)
_CUSTOMER = ("cliente", "customer", "bill to", "ship to", "facturar a", "destinatario", "comprador", "buyer")
_PRICE = [
    "precio", "price", "pvp", "importe", "amount", "total", "subtotal",
    "base", "cuota", "iva", "igic", "tax", "dto", "descuento",
]


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


SIGNALS = OCR + rf""",
low AS (
  SELECT *, lower(text) AS lo, regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') AS st FROM geo),
sig AS (
  SELECT *,
    regexp_matches(text, '[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_.-]+\.{WC}+')
      OR regexp_matches(text, '(?i)[A-Z]{{2}}\p{{Nd}}{{2}}{WS}?\p{{Nd}}{{4}}{WS}?\p{{Nd}}{{4}}{WS}?\p{{Nd}}{{4}}{WS}?\p{{Nd}}{{4}}')
      OR regexp_matches(text, '(?i)www\.[\p{{L}}\p{{N}}_.-]+\.{WC}+')
      OR (regexp_matches(text, '\p{{Nd}}{{3}}({WS}|[.-])?\p{{Nd}}{{3}}({WS}|[.-])?\p{{Nd}}{{3,4}}')
          AND (contains(lo, 'tel') OR contains(lo, 'tfno'))) AS has_vendor_contact,
    st <> '' AND (
      regexp_matches(st, '^{WS}*[\p{{Nd}}.,]+{WS}*[€$£%]?{WS}*$')
      OR (length(st) < 20 AND regexp_matches(st, '[\p{{Nd}}.,]+{WS}*[€$£]|[€$£]{WS}*[\p{{Nd}}.,]+|\p{{Nd}}+[.,]\p{{Nd}}{{2}}'))
      OR (length(st) < 30 AND len(list_intersect(string_split_regex(lower(st), '{WS}+'), {_PRICE!r})) > 0)) AS is_numeric_price,
    {_any('lo', _ADDRESS)}
      OR (length(text) > 15 AND regexp_matches(text, '(^|{NW})\p{{Nd}}{{5}}($|{NW})')) AS has_address,
    {_any('lo', _CUSTOMER)} AS has_customer_keyword,
    regexp_matches(text, '(?i)(^|{NW})[A-Z]-?\p{{Nd}}{{7,8}}-?[A-Z0-9]?($|{NW})') AS has_tax_id
  FROM low)
"""


def zoned(region_type: str = "NULL") -> str:
    return SIGNALS + f""",
typed AS (SELECT *, {region_type} AS rt FROM sig WHERE st <> ''),
zoned AS (
  SELECT *, CASE
    WHEN NOT valid THEN 'CONTENT'
    WHEN is_numeric_price THEN 'CONTENT'
    WHEN has_vendor_contact THEN CASE WHEN y > 1000 * 0.85::DOUBLE THEN 'FOOTER' ELSE 'HEADER' END
    WHEN has_customer_keyword THEN 'CUSTOMER'
    WHEN rt = 'header' THEN 'HEADER' WHEN rt = 'footer' THEN 'FOOTER' WHEN rt = 'table' THEN 'CONTENT'
    WHEN x > 800 * 0.55::DOUBLE AND y < 1000 * 0.35::DOUBLE AND y > 1000 * 0.18::DOUBLE * 0.5::DOUBLE
      THEN CASE WHEN has_address OR has_tax_id THEN 'CUSTOMER' ELSE 'CONTENT' END
    WHEN y < 1000 * 0.18::DOUBLE THEN 'HEADER'
    WHEN y > 1000 * 0.85::DOUBLE THEN 'FOOTER' ELSE 'CONTENT' END AS zone
  FROM typed)
"""

TABLES = f"""
td_rows AS (
  SELECT k, string_agg('<tr><td>Part, ' || ((k * 31 + i) % 200)
     || CASE (k + i) % 4 WHEN 0 THEN ' &amp; co' WHEN 1 THEN ' &lt;i&gt;n&amp;lt;' ELSE '' END || '</td>'
     || CASE WHEN k % 10 = 3 THEN '<td>0.00</td><td>' || {amount('abs(t)', '.')} || '</td><td> 0.00 </td>'
        ELSE '<td>' || q || '</td><td> ' || {amount('p', '.')} || ' </td>'
          || CASE WHEN (k + i) % 6 = 0 THEN '' ELSE '<td>' || {amount('abs(t)', '.')} || '</td>' END
          || CASE WHEN (k + i) % 6 = 1 THEN '<td></td><td>extra</td>' ELSE '' END END || '</tr>', '' ORDER BY i) AS body
  FROM item GROUP BY k),
tab AS (
  SELECT raw.k AS doc_id, CAST(raw.k % 3 + 1 AS INT) AS page_num, CAST(raw.k % 2 + 1 AS INT) AS table_num,
    CASE WHEN raw.k % 14 = 0 THEN '' WHEN raw.k % 38 = 1 THEN '<p>sin  tabla</p>' ELSE
      '<table border="1"><tr class="x"><!-- top -->'
      || CASE WHEN raw.k % 10 = 3 THEN '<th>Concepto</th><th>HONORARIOS</th><th>SUPLIDOS</th><th>PROVISIONES</th></tr>'
           WHEN raw.k % 3 = 1 THEN '</tr>'
           ELSE '<th>Descripción</th><th>Cantidad</th><th><b>Precio</b> unitario</th><th>Total, EUR</th></tr>' END
      || CASE WHEN raw.k % 4 = 2 THEN '<tr><td>info@proveedor' || (raw.k % 100) || '.es</td><td>Tel: 922272555</td><td>es91 2100</td></tr>' ELSE '' END
      || coalesce(body, '') || '</table>' END AS html
  FROM raw LEFT JOIN td_rows ON raw.k = td_rows.k)
"""


def decoded(text: str) -> str:
    return f"replace(replace(replace({text}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


def cells(name: str, source: str, html: str, row: str = "tr", cell: str = "td|th", keys: str = "doc_id") -> str:
    """CTE ``name`` with one row per cell of the tables in ``source``."""
    visible = f"regexp_replace({html}, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g')"
    return rf"""
{name}_r AS (
  SELECT {keys}, unnest(a) AS h, unnest(range(len(a))) AS r
  FROM (SELECT {keys}, regexp_extract_all({visible}, '(?is)<{row}(?:\s[^>]*)?>.*?</{row}>') AS a FROM {source})),
{name}_c AS (
  SELECT {keys}, r, unnest(a) AS h, unnest(range(len(a))) AS c
  FROM (SELECT {keys}, r, regexp_extract_all(h, '(?is)<(?:{cell})(?:\s[^>]*)?>.*?</(?:{cell})>') AS a FROM {name}_r)),
{name}_t AS (
  SELECT {keys}, r, c, h LIKE '<th%' AS th,
    regexp_replace({decoded("regexp_replace(h, '<[^>]*>', '', 'g')")}, '^{WS}+|{WS}+$', '', 'g') AS text FROM {name}_c),
{name} AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY {keys} ORDER BY r) - 1 AS INT) AS row_no FROM {name}_t)"""


VENDOR_CELL = (
    r"(contains(text, '@') AND contains(split_part(text, '@', -1), '.') OR regexp_matches(text, '(?i)Tel[:\s]*[0-9]{6,}')"
    r" OR regexp_matches(text, 'ES[0-9]{2}\s*[0-9]{4}'))"
)


def entity(name: str, source: str, cell: str) -> str:
    """CTE ``name``: text with contact cells first, for every table of ``source``."""
    return rf"""
{name}_v AS (
  SELECT doc_id, string_agg(text, chr(10) ORDER BY r, c) AS body FROM {cell} WHERE text <> '' AND {VENDOR_CELL} GROUP BY doc_id),
{name}_o AS (
  SELECT doc_id, string_agg(text, chr(10) ORDER BY r, c) AS body FROM (
    SELECT doc_id, text, r, c, row_number() OVER (PARTITION BY doc_id, text ORDER BY r, c) AS nth
    FROM {cell} WHERE text <> '' AND NOT {VENDOR_CELL}) WHERE nth = 1 GROUP BY doc_id),
{name} AS (
  SELECT s.doc_id, CASE WHEN s.html = '' THEN ''
      WHEN s.doc_id NOT IN (SELECT doc_id FROM {cell}) THEN trim(regexp_replace(regexp_replace(s.html, '<[^>]+>', ' ', 'g'), '{WS}+', ' ', 'g'))
      ELSE concat_ws(chr(10) || chr(10), '[VENDOR_INFO - Has contact details]' || chr(10) || v.body,
        '[DOCUMENT_CONTENT]' || chr(10) || o.body) END AS text
  FROM {source} s LEFT JOIN {name}_v v ON s.doc_id = v.doc_id LEFT JOIN {name}_o o ON s.doc_id = o.doc_id)"""


# Headers, data rows and compact text of every table; cells come from text decoded twice.
STRUCTURE = cells("tc", "tab", decoded("html")) + """,
header_row AS (SELECT doc_id, max(r) AS r FROM tc WHERE th GROUP BY doc_id),
head_rows AS (SELECT DISTINCT doc_id, r FROM tc WHERE th),
data AS (SELECT t.* FROM tc t LEFT JOIN head_rows h ON t.doc_id = h.doc_id AND t.r = h.r WHERE h.r IS NULL),
headers AS (
  SELECT t.doc_id, list(t.text ORDER BY t.c) AS headers FROM tc t JOIN header_row h ON t.doc_id = h.doc_id AND t.r = h.r GROUP BY t.doc_id
  UNION ALL
  SELECT d.doc_id, list('col' || (d.c + 1) ORDER BY d.c) FROM data d
  JOIN (SELECT doc_id, min(r) AS r FROM data GROUP BY doc_id) f ON d.doc_id = f.doc_id AND d.r = f.r
  WHERE d.doc_id NOT IN (SELECT doc_id FROM header_row) GROUP BY d.doc_id),
data_row AS (SELECT doc_id, r, list(text ORDER BY c) AS cells FROM data GROUP BY doc_id, r),
struct_tab AS (
  SELECT tab.doc_id, tab.page_num, tab.table_num, coalesce(h.headers, []) AS headers, coalesce(d.n, 0) AS n, d.rows
  FROM tab LEFT JOIN headers h ON tab.doc_id = h.doc_id
  LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(array_to_string(cells, ' ¦ '), chr(10) ORDER BY r) AS rows
             FROM data_row GROUP BY doc_id) d ON tab.doc_id = d.doc_id),
toon_lines AS (
  SELECT d.doc_id, string_agg(array_to_string(list_transform(range(len(h.headers)),
      lambda i: replace(coalesce(d.cells[i + 1], ''), ',', '\\,')), ', '), chr(10) ORDER BY d.r) AS body
  FROM data_row d JOIN headers h ON d.doc_id = h.doc_id GROUP BY d.doc_id)"""


def toon(table_no: str, page_no: str) -> str:
    return f"""CASE WHEN s.n = 0 THEN 'TABLE ' || {table_no} || ' (Page ' || {page_no} || '): Empty table'
      ELSE 'TABLE ' || {table_no} || ' (Page ' || {page_no} || ') [' || s.n || ']' || chr(10) || '{{' || array_to_string(s.headers, ', ')
        || '}}' || chr(10) || tl.body END"""


TOKEN = r"\p{Nd}+(?:[,.]\p{Nd}+)?"


def tokens(name: str, source: str, text: str, order: str, keys: str = "doc_id") -> str:
    """CTE ``name``: the numbers of each text line, in order."""
    return f"""
{name} AS (
  SELECT {keys}, o, j, TRY_CAST(replace(tok, ',', '.') AS DOUBLE) AS v FROM (
    SELECT {keys}, {order} AS o, unnest(a) AS tok, unnest(range(len(a))) AS j
    FROM (SELECT *, regexp_extract_all({text}, '{TOKEN}') AS a FROM {source})))"""


def repaired(name: str, items: str, tokens: str) -> str:
    """CTE ``name``: items (doc_id, i, q, p, t as DOUBLE) with the better total, if any."""
    return f"""
{name}_best AS (
  SELECT i.doc_id, i.i, first(v ORDER BY abs(v - q * p), o, j) AS better
  FROM {items} i JOIN {tokens} x ON x.doc_id = i.doc_id AND v >= q * p * 0.5::DOUBLE AND v <= q * p * 1.05::DOUBLE
  WHERE q > 0 AND p > 0 AND abs(t - q * p) / (q * p) > 0.5
    AND abs(v - q) >= 0.00005 AND abs(v - p) >= 0.00005 AND abs(v - t) >= 0.00005
  GROUP BY i.doc_id, i.i),
{name} AS (
  SELECT i.*, coalesce(better, t) AS fixed_t, better IS NOT NULL AS was_fixed
  FROM {items} i LEFT JOIN {name}_best b ON i.doc_id = b.doc_id AND i.i = b.i)"""


ITEM_D = """
item_d AS (
  SELECT k AS doc_id, i, descr, CAST(q AS DOUBLE) AS q, CAST(p AS DOUBLE) / 100 AS p, CAST(t AS DOUBLE) / 100 AS t FROM item)"""

ANSWERS = HEADS + f""",
answer_items AS (
  SELECT k, CASE WHEN k % 5 = 0 THEN string_agg(one, ',' ORDER BY i) ELSE string_agg(one, ', ' ORDER BY i) END AS body
  FROM (SELECT k, i, '{{"description":"Part ' || CASE WHEN k % 12 = 7 THEN '[' ELSE '' END || ((k * 31 + i) % 200) || '","quantity":' || q
    || ',"unit_price":' || {amount('p', '.')} || ',"line_total":' || CASE WHEN t < 0 THEN '-' ELSE '' END || {amount('abs(t)', '.')} || '}}' AS one
    FROM item) GROUP BY k),
amounts_c AS (
  SELECT *, CASE WHEN k % 31 = 0 THEN -abs(base) ELSE base + CASE WHEN k % 11 = 0 THEN 3000 ELSE 0 END
    + CASE WHEN k % 12 = 0 THEN 5 ELSE 0 END + CASE WHEN k % 13 = 0 THEN 2 ELSE 0 END END AS total FROM based),
answer AS (
  SELECT b.k AS doc_id, 'model' || (b.k % 4) AS source, n, stated, total,
    CASE WHEN b.k % 2 = 0 THEN '```json' || chr(10) ELSE '  ' END
    || '{{"metadata":{{"invoice_number":"2025/' || b.k || '","issue_date":'
    || CASE WHEN b.k % 10 = 0 THEN 'null' ELSE '"' || strftime(day, '%Y-%m-%d') || '"' END || '}},'
    || CASE WHEN b.k % 3 = 0 THEN ' # número "de" control' || chr(10) ELSE '' END
    || '"parties":{{"vendor":{{"name":"Supplier # ' || (b.k % 100) || '"'
    || CASE WHEN b.k % 8 = 0 THEN '' ELSE ',"tax_id":"B12345678"' END || '}},"customer":'
    || CASE WHEN b.k % 26 = 0 THEN 'null' WHEN b.k % 34 = 0 THEN '{{}}' ELSE '{{"name":"Receptor"}}' END || '}},'
    || '"financial_details":{{"currency":' || CASE WHEN b.k % 11 = 0 THEN '"euro"' WHEN b.k % 15 = 0 THEN 'null' ELSE '"EUR"' END
    || CASE WHEN b.k % 7 = 0 THEN '' ELSE ',"subtotal":' || CASE WHEN b.k % 9 = 1 THEN '"' ELSE '' END
         || CASE WHEN stated < 0 THEN '-' ELSE '' END || {amount('abs(stated)', '.')} || CASE WHEN b.k % 9 = 1 THEN '"' ELSE '' END END
    || ',"tax":{{"type":' || CASE WHEN b.k % 53 = 0 THEN '21' ELSE '"IVA"' END || ',"rate":21.0,"amount":'
    || CASE WHEN tax < 0 THEN '-' ELSE '' END || {amount('abs(tax)', '.')} || '}},"total_amount":'
    || CASE WHEN b.k % 59 = 0 THEN '"12,5"' ELSE CASE WHEN total < 0 THEN '-' ELSE '' END || {amount('abs(total)', '.')} END
    || CASE WHEN b.k % 17 = 0 THEN ',"payment":{{"method":"BARTER"}}' ELSE ',"payment":{{"method":"CARD"}}' END || '}},"items":['
    || coalesce(body, '')
    || CASE WHEN b.k % 5 = 1 THEN '' WHEN b.k % 5 = 2 THEN ',{{"description":"cut' ELSE ']' END
    || CASE WHEN b.k % 5 IN (1, 2) THEN '' ELSE CASE WHEN b.k % 6 = 0 THEN ',"origin":"ocr"' ELSE '' END || '}}' END
    || CASE WHEN b.k % 31 = 3 THEN ' trailing' ELSE '' END
    || CASE WHEN b.k % 4 = 0 THEN chr(10) || '```' WHEN b.k % 4 = 2 THEN '```' ELSE '  ' || chr(10) END AS raw
  FROM amounts_c b LEFT JOIN answer_items a ON b.k = a.k),
opened AS (
  SELECT *, CASE WHEN s LIKE '```%' AND contains(s, chr(10)) THEN substr(s, instr(s, chr(10)) + 1) ELSE s END AS body
  FROM (SELECT *, regexp_replace(raw, '^{WS}+|{WS}+$', '', 'g') AS s FROM answer)),
fenced AS (
  SELECT doc_id, source, n, stated, total, regexp_replace(CASE WHEN body LIKE '%```' AND contains(body, chr(10) || '```')
      THEN regexp_extract(body, '(?s)^(.*)\n```', 1) ELSE body END, '^{WS}+|{WS}+$', '', 'g') AS unfenced FROM opened),
comment_lines AS (
  SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS i FROM (SELECT doc_id, string_split(unfenced, chr(10)) AS a FROM fenced)),
cleaned AS (
  SELECT doc_id, string_agg(CASE WHEN contains(line, '#')
      THEN regexp_replace(regexp_extract(line, '^((?:[^#"'']|"[^"]*"|''[^'']*'')*(?:["''].*)?)', 1), '{WS}+$', '') ELSE line END,
    chr(10) ORDER BY i) AS text FROM comment_lines GROUP BY doc_id),
parsed AS (
  SELECT f.*, text, CASE WHEN json_valid(text) THEN 'parsed'
      WHEN n > 0 AND (f.doc_id % 5 = 2 OR f.doc_id % 12 = 7) THEN 'failed' ELSE 'repaired' END AS parse
  FROM fenced f JOIN cleaned c ON f.doc_id = c.doc_id),
item_codes AS (
  SELECT k, string_agg(code, ', ' ORDER BY i, o) AS codes, count(*) AS n_codes FROM (
    SELECT k, i, 1 AS o, 'items[' || (i - 1) || '].quantity: negative' AS code FROM item WHERE q < 0
    UNION ALL SELECT k, i, 2, 'items[' || (i - 1) || '].line_total: negative' FROM item WHERE t < 0) GROUP BY k),
outcome AS (
  SELECT p.*, len(list_filter(l, lambda x: x IS NOT NULL)) + coalesce(n_codes, 0) AS n_violations,
    coalesce(array_to_string(list_append(l, codes), ', '), '') AS violations
  FROM (SELECT *, [
      CASE WHEN doc_id % 26 = 0 THEN 'parties.customer: type' WHEN doc_id % 34 = 0 THEN 'parties.customer.name: missing' END,
      CASE WHEN doc_id % 11 = 0 THEN 'financial_details.currency: pattern' END,
      CASE WHEN doc_id % 7 = 0 THEN 'financial_details.subtotal: missing' END,
      CASE WHEN doc_id % 53 = 0 THEN 'financial_details.tax.type: type' END,
      CASE WHEN doc_id % 59 = 0 THEN 'financial_details.total_amount: type' END,
      CASE WHEN doc_id % 17 = 0 THEN 'financial_details.payment.method: enum' END] AS l FROM parsed) p
  LEFT JOIN item_codes c ON c.k = p.doc_id),
stat AS (
  SELECT *, CASE WHEN parse = 'failed' THEN 'JSON parse error' WHEN n_violations > 0 THEN 'Validation error' ELSE 'success' END AS status
  FROM outcome)
"""
