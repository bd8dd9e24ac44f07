"""Expected results of the table and page queries."""

from billgrain.functions.html import HINTS
from billgrain.functions.schema import INVOICE
from billgrain.operators.pages import PROMPT
from billgrain.plans.oracle.base import (
    ITEMS, OCR, STRUCTURE, TABLES, VENDOR_CELL, WS, cells, entity, toon, with_ctes, zoned,
)

_ONCE = cells("hc", "tab", "html")
_ENTITY = entity("ent", "tab", "hc")

# Header words per table kind.
_EXPENSE = (
    "HONORARIOS", "SUPLIDOS", "PROVISIONES", "PROV.FONDOS",
    "RETENCION", "BASE IMP", "BASE IMPONIBLE",
)
_ITEM = (
    "DESCRIPCION", "DESCRIPTION", "CONCEPTO", "ITEM",
    "CANTIDAD", "QUANTITY", "QTY", "UNITS", "UNIDADES",
    "PRECIO", "PRICE", "PVP", "UNIT PRICE", "PRECIO UNITARIO",
    "TOTAL", "IMPORTE", "AMOUNT", "LINE TOTAL",
)


def _matching(words) -> str:
    found = " OR ".join(f"contains(upper(h), '{w}')" for w in words)
    return f"len(list_filter(headers, lambda h: {found}))"


_KIND = f"""
kinds AS (
  SELECT *, CASE WHEN {_matching(_EXPENSE)} >= 2 THEN 'expense_category_table'
    WHEN {_matching(_ITEM)} >= 3 THEN 'standard_line_items' ELSE 'generic' END AS structure_type FROM struct_tab)"""

# Regions of every page, one row each, with the text each one gives.
_REGIONS = rf"""
zsec AS (
  SELECT doc_id, zone, string_agg(text, chr(10) ORDER BY y, x, pos) AS body FROM zoned WHERE src = 'inv' GROUP BY ALL),
ztext AS (
  SELECT doc_id, concat_ws(chr(10) || chr(10),
    max(CASE WHEN zone = 'HEADER' THEN '[VENDOR_HEADER]' || chr(10) || body END),
    max(CASE WHEN zone = 'CUSTOMER' THEN '[CUSTOMER_INFO]' || chr(10) || body END),
    max(CASE WHEN zone = 'CONTENT' THEN '[INVOICE_CONTENT]' || chr(10) || body END),
    max(CASE WHEN zone = 'FOOTER' THEN '[VENDOR_FOOTER]' || chr(10) || body END)) AS text
  FROM zsec GROUP BY doc_id),
pieces AS (
  SELECT k, 0 AS o, ['text', 'title', 'figure'][CAST(k % 3 AS INT) + 1] AS type, 'list' AS kind, NULL AS html, NULL AS plain, 40 AS bx, len(text_lines) AS n_items, 4 AS n_box
    FROM lined WHERE k % 44 <> 0 AND k % 6 <> 0
  UNION ALL SELECT k, 1, 'table', 'dict', tab.html, NULL, CASE k % 4 WHEN 0 THEN 10 WHEN 1 THEN 50 ELSE 60 END, 0, 4
    FROM lined JOIN tab ON tab.doc_id = k WHERE k % 44 <> 0
  UNION ALL SELECT k, 2, 'text', 'str', NULL, CASE WHEN k % 9 = 0 THEN '' ELSE text_lines[5] END, NULL, 0, 0 FROM lined WHERE k % 44 <> 0
  UNION ALL SELECT k, 3, CASE k % 5 WHEN 0 THEN 'header' WHEN 1 THEN 'footer' WHEN 2 THEN 'reference' WHEN 3 THEN 'equation' END,
    'dict', NULL, CASE WHEN k % 6 = 1 THEN '' ELSE text_lines[2] END, 0, 0, 4 FROM lined WHERE k % 44 <> 0
  UNION ALL SELECT k, 4, 'table', 'dict', '<table><tr><td>IVA, 21%</td><td>' || k || '</td></tr></table>', NULL, 60, 0, 4
    FROM lined WHERE k % 44 <> 0 AND k % 3 = 0),
regions AS (
  SELECT k, CAST(k % 3 + 1 AS INT) AS page_number, o, type, kind, html, plain, bx, n_items, n_box,
    CAST(row_number() OVER (PARTITION BY k ORDER BY o) - 1 AS INT) AS idx,
    CAST(count(*) FILTER (WHERE type = 'table') OVER (PARTITION BY k ORDER BY o) AS INT) AS tno,
    type = 'table' AND o = 1 AND k % 4 = 0 AS full_page
  FROM pieces)"""

_ROUTED = rf"""
given AS (
  SELECT g.*, CASE
    WHEN type = 'table' AND html = '' THEN NULL
    WHEN type = 'table' AND full_page THEN nullif(ent.text, '')
    WHEN type = 'table' AND o = 1 THEN {toon('tno', 'page_number')}
    WHEN type = 'table' THEN 'TABLE ' || tno || ' (Page ' || page_number || ') [1]' || chr(10) || '{{col1, col2}}' || chr(10) || 'IVA\, 21%, ' || k
    WHEN o = 0 THEN nullif(z.text, '')
    WHEN o = 2 THEN '[DOCUMENT TEXT]' || chr(10) || nullif(plain, '')
    WHEN type IN ('header', 'footer', 'reference') THEN '[' || upper(type) || ']' || chr(10) || nullif(plain, '')
    ELSE nullif(plain, '') END AS part
  FROM regions g LEFT JOIN ent ON ent.doc_id = k LEFT JOIN struct_tab s ON s.doc_id = k
  LEFT JOIN toon_lines tl ON tl.doc_id = k LEFT JOIN ztext z ON z.doc_id = k),
routed AS (
  SELECT raw.k AS doc_id, CAST(raw.k % 3 + 1 AS INT) AS page_number, coalesce(string_agg(part, chr(10) || chr(10) ORDER BY o), '') AS text,
    coalesce(string_agg(nullif(html, ''), chr(10) ORDER BY o), '') AS html,
    CAST(count(*) FILTER (WHERE type = 'table') AS INT) AS table_count, CAST(count(o) AS INT) AS region_count
  FROM raw LEFT JOIN given ON raw.k = given.k GROUP BY raw.k)"""

_FALLBACK = rf"""
itemtext AS (SELECT k, array_to_string(text_lines, chr(10)) AS body FROM lined),
fparts AS (
  SELECT g.k, o, '[' || upper(coalesce(type, 'unknown')) || ' ' || (idx + 1) || ']' || chr(10) || CASE
    WHEN o = 0 THEN t.body WHEN kind = 'str' THEN plain ELSE nullif(plain, '') END AS part
  FROM regions g JOIN itemtext t ON t.k = g.k),
fallback AS (
  SELECT raw.k AS doc_id, CASE WHEN coalesce(string_agg(part, '' ORDER BY o), '') = ''
      THEN '[PAGE ' || (raw.k % 3 + 1) || ' - NO TEXT EXTRACTED]'
      ELSE string_agg(part, chr(10) || chr(10) ORDER BY o) END AS text
  FROM raw LEFT JOIN fparts ON fparts.k = raw.k GROUP BY raw.k),
layout AS (
  SELECT r.* EXCLUDE (text), CASE WHEN r.text = '' AND r.region_count > 0 THEN f.text ELSE r.text END AS text
  FROM routed r JOIN fallback f ON r.doc_id = f.doc_id),
tmode AS (
  SELECT tab.doc_id, tab.html, CASE WHEN coalesce(ent.text, '') = '' THEN '[PAGE ' || page_num || ' - NO TEXT EXTRACTED]' ELSE ent.text END AS text
  FROM tab JOIN ent ON ent.doc_id = tab.doc_id)"""

_DOCUMENTS = """
page_text AS (
  SELECT src, doc_id, coalesce(string_agg(text, ' ' ORDER BY pos) FILTER (WHERE confidence > 0.5), '') AS text FROM geo GROUP BY src, doc_id),
assembled AS (
  SELECT src, doc_id // 3 AS doc_id, CAST(count(*) AS BIGINT) AS n_pages, string_agg(
      '[INICIO PÁGINA ' || (doc_id % 3 + 1) || ']' || chr(10) || text || chr(10) || '[FIN PÁGINA ' || (doc_id % 3 + 1) || ']',
      chr(10) || chr(10) ORDER BY doc_id) AS text
  FROM page_text GROUP BY src, doc_id // 3)"""

_PAGE = (zoned(), TABLES, _ONCE, _ENTITY, STRUCTURE, _REGIONS, _ROUTED)

SQL = {
    "html_rows": with_ctes(
        ITEMS, TABLES, _ONCE, cells("wc", "(SELECT page_id AS doc_id, html FROM pages)", "html", "ul", "li"), select="""
      SELECT 'inv' AS src, doc_id, row_no, CAST(count(*) AS INT) AS n_cells, string_agg(text, ' ¦ ' ORDER BY c) AS cells
      FROM hc GROUP BY doc_id, row_no
      UNION ALL
      SELECT 'web', doc_id, row_no, CAST(count(*) AS INT), string_agg(text, ' ¦ ' ORDER BY c) FROM wc GROUP BY doc_id, row_no"""),
    "html_table_text": with_ctes(ITEMS, TABLES, _ONCE, """
lines AS (SELECT doc_id, r, string_agg(text, ' | ' ORDER BY c) AS line FROM hc WHERE text <> '' GROUP BY doc_id, r),
joined AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY r) AS text FROM lines GROUP BY doc_id)""", select="""
      SELECT tab.doc_id, coalesce(text, '') AS text, false AS malformed FROM tab LEFT JOIN joined ON tab.doc_id = joined.doc_id"""),
    "html_entity_text": with_ctes(ITEMS, TABLES, _ONCE, _ENTITY, select="SELECT doc_id, text FROM ent"),
    "html_table_struct": with_ctes(ITEMS, TABLES, STRUCTURE, select="""
      SELECT doc_id, array_to_string(headers, ' ¦ ') AS headers, CAST(n AS INT) AS n_rows, coalesce(rows, '') AS rows FROM struct_tab"""),
    "table_to_toon": with_ctes(ITEMS, TABLES, STRUCTURE, select=f"""
      SELECT s.doc_id, {toon('s.table_num', 's.page_num')} AS toon FROM struct_tab s LEFT JOIN toon_lines tl ON s.doc_id = tl.doc_id"""),
    "table_type": with_ctes(ITEMS, TABLES, STRUCTURE, _KIND, select=f"""
      SELECT doc_id, structure_type, CASE structure_type
          WHEN 'expense_category_table' THEN '{HINTS["expense_category_table"]}'
          WHEN 'standard_line_items' THEN '{HINTS["standard_line_items"]}' ELSE '' END AS hint,
        array_to_string(headers, ' ¦ ') AS headers, CAST(n AS INT) AS row_count FROM kinds"""),
    "cell_party_split": with_ctes(ITEMS, TABLES, _ONCE, select=f"""
      SELECT doc_id, row_no, CAST(c AS INT) AS cell_no, text AS cell, {VENDOR_CELL} AS is_vendor FROM hc WHERE text <> ''"""),
    "expense_rows": with_ctes(ITEMS, TABLES, STRUCTURE, _KIND, """
cat_priced AS (
  SELECT d.doc_id, d.r, d.cells, k.headers,
    list_filter(list_transform(range(2, len(d.cells) + 1), lambda j: {a: TRY_CAST(d.cells[j] AS DOUBLE), c: k.headers[j]}),
      lambda s: s.a <> 0)[1] AS hit
  FROM data_row d JOIN kinds k ON d.doc_id = k.doc_id WHERE k.structure_type = 'expense_category_table'),
counted AS (SELECT doc_id, r, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY r) - 1 AS INT) AS row_no FROM data_row)""",
        select="""
      SELECT p.doc_id, n.row_no, cells[1] AS description, hit.c AS category, 1.0::DOUBLE AS quantity, hit.a AS unit_price, hit.a AS line_total
      FROM cat_priced p JOIN counted n ON p.doc_id = n.doc_id AND p.r = n.r WHERE hit IS NOT NULL"""),
    "strip_tags": with_ctes(ITEMS, TABLES, select=f"""
      SELECT src, doc_id, regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '{WS}+', ' ', 'g'), '^ | $', '', 'g') AS text
      FROM (SELECT 'inv' AS src, doc_id, html FROM tab UNION ALL SELECT 'web', page_id, html FROM pages)"""),
    "region_scan": with_ctes(zoned(), TABLES, _REGIONS, select="""
      SELECT raw.k AS doc_id, CAST(raw.k % 3 + 1 AS INT) AS page_number, idx AS region_idx,
        CASE WHEN idx IS NOT NULL THEN coalesce(type, 'Unknown') END AS type, CAST(coalesce(n_box, 0) AS INT) AS bbox_size,
        coalesce(kind, 'dict') AS res_kind, CAST(coalesce(n_items, 0) AS INT) AS n_items
      FROM raw LEFT JOIN regions g ON raw.k = g.k"""),
    "full_page_tables": with_ctes(zoned(), TABLES, _REGIONS, select="""
      SELECT k AS doc_id, idx AS region_idx, full_page AS is_full_page FROM regions WHERE type = 'table'"""),
    "table_numbering": with_ctes(zoned(), TABLES, _REGIONS, select="""
      SELECT k AS doc_id, page_number, idx AS region_idx, tno AS table_num FROM regions WHERE type = 'table'"""),
    "region_route": with_ctes(*_PAGE, select="SELECT doc_id, page_number, text, html, table_count FROM routed"),
    "region_fallback_text": with_ctes(*_PAGE, _FALLBACK, select="SELECT doc_id, text FROM fallback"),
    "adaptive_mode": with_ctes(*_PAGE, _FALLBACK, select="""
      SELECT l.doc_id, l.page_number,
        CASE WHEN swap THEN t.text ELSE l.text END AS text, CASE WHEN swap THEN t.html ELSE l.html END AS html,
        CASE WHEN swap THEN 1 ELSE l.table_count END AS table_count, CASE WHEN swap THEN 1 ELSE l.region_count END AS region_count,
        1.0::DOUBLE AS structure_score, CASE WHEN swap THEN 'table' ELSE 'layout' END AS extraction_mode
      FROM (SELECT l.*, length(l.text) < 200 AND length(t.text) > length(l.text) AS swap FROM layout l JOIN tmode t ON l.doc_id = t.doc_id) l
      JOIN tmode t ON l.doc_id = t.doc_id"""),
    "doc_ocr_summary": with_ctes(*_PAGE, _FALLBACK, select="""
      SELECT doc_id // 3 AS doc_id, count(*) AS n_pages, CAST(sum(table_count) AS BIGINT) AS n_tables,
        CAST(sum(region_count) AS BIGINT) AS n_regions, CAST(sum(length(text)) AS BIGINT) AS n_chars
      FROM layout GROUP BY doc_id // 3"""),
    "page_assembly": """
      SELECT doc_id, string_agg('[INICIO PÁGINA ' || (i + 1) || ']' || chr(10) || t || chr(10) || '[FIN PÁGINA ' || (i + 1) || ']',
        chr(10) || chr(10) ORDER BY i) AS text
      FROM (SELECT doc_id, unnest(a) AS t, unnest(range(len(a))) AS i
            FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)) GROUP BY doc_id""",
    "document_pages": with_ctes(OCR, _DOCUMENTS, select="SELECT src, doc_id, n_pages, text FROM assembled"),
    "document_requests": with_ctes(OCR, _DOCUMENTS, select=f"""
      SELECT src || '-' || doc_id AS doc_id, '{PROMPT.replace("{schema}", INVOICE)}' || CASE WHEN length(text) > 150000
        THEN left(text, 100000) || chr(10) || chr(10) || '[... MIDDLE CONTENT TRUNCATED ...]' || chr(10) || chr(10) || right(text, 50000)
        ELSE text END AS prompt FROM assembled"""),
    "prompt_rows": f"""
      SELECT doc_id, '{PROMPT.replace("{schema}", INVOICE)}' || text AS prompt FROM documents""",
    "truncate_middle": """
      SELECT doc_id, CASE WHEN length(text) > 1500 THEN left(text, 1000) || chr(10) || chr(10) || '[... MIDDLE CONTENT TRUNCATED ...]'
        || chr(10) || chr(10) || right(text, 500) ELSE text END AS text FROM documents""",
}
