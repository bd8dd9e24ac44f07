"""Expected results of the OCR item queries."""

from billgrain.plans.oracle.base import NW, OCR, SIGNALS, TEXTS, with_ctes, zoned

_SECTIONS = """
sections AS (
  SELECT src, doc_id, zone, string_agg(text, chr(10) ORDER BY y, x, pos) AS body FROM zoned GROUP BY ALL)
"""

SQL = {
    "zone_signals": with_ctes(SIGNALS, select="""
      SELECT src, doc_id, pos, has_vendor_contact, is_numeric_price, has_address, has_customer_keyword, has_tax_id
      FROM sig"""),
    "item_geometry": with_ctes(OCR, select="""
      SELECT src, doc_id, pos, valid, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2,
        CAST(y2 AS DOUBLE) AS y2, CAST(x AS DOUBLE) AS x_center, CAST(y AS DOUBLE) AS y_center FROM geo"""),
    "zone_classify": with_ctes(
        zoned("CASE doc_id % 6 WHEN 0 THEN 'header' WHEN 1 THEN 'footer' WHEN 2 THEN 'table' ELSE 'text' END"),
        select="SELECT src, doc_id, pos, zone FROM zoned"),
    "reading_order": with_ctes(zoned(), select="""
      SELECT src, doc_id, CAST(row_number() OVER (PARTITION BY src, doc_id ORDER BY y, x, pos) - 1 AS INT) AS rank, pos, zone
      FROM zoned"""),
    "zone_text": with_ctes(zoned(), _SECTIONS, """
texts AS (
  SELECT src, doc_id, concat_ws(chr(10) || chr(10),
    max(CASE WHEN zone = 'HEADER' THEN '[VENDOR_HEADER]' || chr(10) || body END),
    max(CASE WHEN zone = 'CUSTOMER' THEN '[CUSTOMER_INFO]' || chr(10) || body END),
    max(CASE WHEN zone = 'CONTENT' THEN '[INVOICE_CONTENT]' || chr(10) || body END),
    max(CASE WHEN zone = 'FOOTER' THEN '[VENDOR_FOOTER]' || chr(10) || body END)) AS text
  FROM sections GROUP BY ALL)""", select="""
      SELECT pg.src, pg.k AS doc_id, coalesce(t.text, '') AS text
      FROM pg LEFT JOIN texts t ON pg.src = t.src AND pg.k = t.doc_id"""),
    "zone_distribution": with_ctes(zoned(), select="SELECT zone, count(*) AS n_items FROM zoned GROUP BY zone"),
    "party_by_zone": with_ctes(zoned(), rf"""
ided AS (
  SELECT *, CASE WHEN zone = 'FOOTER' THEN regexp_extract(text, '(?i)(?:^|{NW})([A-Z]-?\p{{Nd}}{{7,8}}-?[A-Z0-9]?)(?:$|{NW})', 1) ELSE '' END AS tid
  FROM zoned)""", select="""
      SELECT src, doc_id,
        first(text ORDER BY y, x, pos) FILTER (WHERE zone = 'HEADER') AS vendor,
        first(text ORDER BY y, x, pos) FILTER (WHERE zone = 'CUSTOMER') AS customer,
        first(tid ORDER BY y, x, pos) FILTER (WHERE tid <> '') AS vendor_tax_id
      FROM ided GROUP BY src, doc_id"""),
    "confident_text": with_ctes(OCR, """
kept AS (
  SELECT src, doc_id, string_agg(text, ' ' ORDER BY pos) AS text FROM geo WHERE confidence > 0.5 GROUP BY ALL)""",
        select="""
      SELECT pg.src, pg.k AS doc_id, coalesce(kept.text, '') AS text
      FROM pg LEFT JOIN kept ON pg.src = kept.src AND pg.k = kept.doc_id"""),
    "ocr_item_normalise": with_ctes(TEXTS, select="""
      SELECT doc_id, CAST(i AS INT) AS pos, line AS text,
        CASE (doc_id + i) % 8 WHEN 0 THEN 0.9 WHEN 1 THEN 0.5 WHEN 3 THEN 0.75 ELSE 0 END::DOUBLE AS confidence,
        CASE (doc_id + i) % 8 WHEN 0 THEN '1.0 2.0 3.0 4.0 5.0 6.0 7.0 ' || i || '.0' WHEN 1 THEN '1.5 2.0 3.0 ' || i || '.0'
          WHEN 2 THEN '0.0 0.0 0.0 0.0 0.0 0.0 0.0 0.0' WHEN 3 THEN '1.0 2.0 3.0 4.0 5.0 6.0 7.0 8.0'
          WHEN 4 THEN '1.0 2.0 3.0 4.0' ELSE '9.0 9.0 9.0' END AS bbox
      FROM text_line WHERE (doc_id + i) % 8 NOT IN (5, 6)"""),
}
