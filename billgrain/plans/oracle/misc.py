"""Expected results of admission, reuse, stream, extraction and page quality queries."""

from billgrain.plans.oracle import responses, validation
from billgrain.plans.oracle.base import (
    ANSWERS, CHECK_STEPS, CHECKS, LINES, NW, TEXTS, with_ctes,
)

_UPLOADS = """
types AS (SELECT ['application/pdf', 'image/jpeg', 'image/png', 'image/jpg', 'image/webp', 'image/bmp', 'image/tiff',
  'image/heic', 'image/heif', 'text/plain', 'application/zip'] AS t),
up AS (
  SELECT doc_id, t[CAST(doc_id % 11 + 1 AS INT)] AS content_type, CASE WHEN doc_id % 23 = 0 THEN '' ELSE text END AS body
  FROM documents, types)"""

_STORE = """
pdf AS (
  SELECT doc_id, sha256(text) AS hash, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id % 48 AS BIGINT)) AS came,
    '{"metadata":{"invoice_number":"D-' || doc_id || '","issue_date":null,"due_date":null},"notes":'
      || CASE WHEN doc_id % 3 = 0 THEN coalesce('"' || lang || '"', 'null') ELSE 'null' END
      || ',"parties":{"vendor":{"name":' || coalesce('"' || source || '"', 'null')
      || ',"tax_id":null}},"financial_details":{"currency":"EUR","total_amount":' || (CAST(n_chars AS DOUBLE) / 100)
      || ',"discount":null},"items":[]}' AS invoice
  FROM documents),
store AS (
  SELECT hash, max(came) AS cached_at, max(came) + INTERVAL 24 HOUR AS expires_at, arg_max(invoice, {'c': came, 'i': invoice}) AS invoice
  FROM pdf GROUP BY hash)"""
_NOW = "TIMESTAMP '2024-01-02 12:00:00'"

_HITS = with_ctes(_STORE, select=f"""
      SELECT doc_id, pdf.hash, store.invoice, 'cache_hit' AS processing_method, true AS is_valid, '' AS errors, '' AS warnings,
        100.0::DOUBLE AS quality_score
      FROM pdf JOIN store ON pdf.hash = store.hash WHERE {_NOW} < expires_at""")

_TTL = """
a AS (SELECT user_id || event_type AS hash, ts, event_id FROM events),
nxt AS MATERIALIZED (
  SELECT a.hash, a.event_id, b.event_id AS next_id FROM a ASOF LEFT JOIN a b ON a.hash = b.hash AND a.ts + INTERVAL 24 HOUR <= b.ts),
chain AS (
  SELECT hash, arg_min(event_id, (ts, event_id)) AS event_id FROM a GROUP BY hash
  UNION ALL
  SELECT n.hash, n.next_id FROM chain c JOIN nxt n ON n.event_id = c.event_id WHERE n.next_id IS NOT NULL),
flagged AS (SELECT event_id AS arrival_id, ts, event_id NOT IN (SELECT event_id FROM chain) AS is_hit FROM a)"""


def _recursive(select: str) -> str:
    return with_ctes(_TTL, select=select).replace("WITH ", "WITH RECURSIVE ", 1)


_TITLE = "array_to_string(list_transform(string_split(d, '-'), lambda w: upper(w[1]) || lower(w[2:])), ' ')"

_TAX = f"(?i)(^|{NW})(Tax|VAT|IVA|GST|IGIC|MwSt|TVA|BTW|MOMS|Sales Tax|Impuesto|Steuer)($|{NW})"


def _amount_of(text: str) -> str:
    return f"coalesce(TRY_CAST(replace({text}, ',', '.') AS DOUBLE), 0)"


_NO_ITEM = (
    "Recargo|Alquiler|Otros|Impuesto|Surcharge|Rental|Other|Fee|Tax|VAT|IVA|GST|IGIC|MwSt|TVA|BTW|MOMS|Sales Tax|Steuer|Descuento|Dto|Discount"
)

_METRICS = """
m AS (
  SELECT l_orderkey, l_linenumber, l_quantity * 6 AS sharpness, CAST(l_linenumber * 13 % 90 AS DOUBLE) AS contrast,
    CAST(l_suppkey % 9 - 4 AS DOUBLE) AS rotation, CAST(l_partkey % 60 AS DOUBLE) AS noise FROM lineitem),
s AS (
  SELECT *, CAST(sharpness > 150 AS INT) + CAST(contrast > 60 AS INT) + CAST(noise < 15 AS INT) >= 2 AS is_scan FROM m),
rated AS (
  SELECT *, least(100.0::DOUBLE, greatest(0.0::DOUBLE, 100.0::DOUBLE
    - CASE WHEN sharpness < 100 THEN (100 - sharpness) / 2 ELSE 0 END
    - CASE WHEN contrast < 50 THEN (50 - contrast) / 2 ELSE 0 END
    - CASE WHEN abs(rotation) > 2 THEN abs(rotation) * 2 ELSE 0 END
    - CASE WHEN noise > 30 THEN noise - 30 ELSE 0 END + CASE WHEN is_scan THEN 10 ELSE 0 END)) AS score FROM s)"""

_GARBLED = r"""
misread AS (
  SELECT doc_id, line_no, CASE WHEN (doc_id + line_no) % 3 = 0 THEN translate(text, '0158', 'OlSB') ELSE translate(text, '0', 'O') END AS text
  FROM line_text),
tokens AS (SELECT doc_id, line_no, unnest(string_split(text, ' ')) AS t, unnest(range(len(string_split(text, ' ')))) AS i FROM misread),
fixed AS (
  SELECT *, CASE WHEN regexp_matches(t, '^[0-9OolISB.,]+$') AND length(regexp_replace(t, '[^0-9]', '', 'g')) > 0
      AND length(regexp_replace(t, '[^0-9]', '', 'g')) >= length(regexp_replace(t, '[^OolISB]', '', 'g'))
      AND regexp_matches(t, '^[0-9]|[.,]') THEN translate(t, 'OolISB', '001158') ELSE t END AS f FROM tokens)"""

_IDS = rf"""
ids AS (
  SELECT doc_id, replace(regexp_extract(line, '(?:^|{NW})([0-9]{{8}}[A-Z]|[XYZ][0-9]{{7}}[A-Z]|[A-HJNP-SUVW]-?[0-9]{{7}}-?[0-9A-J])(?:$|{NW})', 1), '-', '') AS tax_id
  FROM text_line),
kinds AS (
  SELECT *, CASE WHEN regexp_matches(tax_id, '^[0-9]') THEN 'NIF' WHEN regexp_matches(tax_id, '^[XYZ]') THEN 'NIE' ELSE 'CIF' END AS kind,
    CAST(translate(left(tax_id, 8), 'XYZABCDEFGHJNPQRSUVW', '01200000000000000000') AS BIGINT) AS num,
    list_transform(range(2, 9), lambda i: CAST(substr(tax_id, i, 1) AS INT)) AS d
  FROM ids WHERE tax_id <> ''),
control AS (
  SELECT *, (10 - (CASE WHEN kind = 'CIF' THEN d[2] + d[4] + d[6] + list_sum(list_transform([d[1], d[3], d[5], d[7]], lambda x: x * 2 // 10 + x * 2 % 10)) ELSE 0 END) % 10) % 10 AS c FROM kinds)"""

_WORDS = "factura invoice total iva igic vat cif n.i.f importe".split() + ["forma de pago"]

SQL = {
    "doc_intake": with_ctes(_UPLOADS, select="""
      SELECT doc_id, content_type, octet_length(encode(body)) AS length,
        CASE WHEN content_type = 'application/pdf' THEN sha256(body) END AS hash FROM up"""),
    "doc_sha256": "SELECT doc_id, sha256(text) AS hash FROM documents",
    "admit_documents": with_ctes(_UPLOADS, select="""
      SELECT doc_id, CASE WHEN content_type IN ('text/plain', 'application/zip') THEN 'unsupported_type'
        WHEN body = '' THEN 'empty' WHEN octet_length(encode(body)) > 5000 THEN 'too_large' END AS reject_reason FROM up"""),
    "dedup_exact": with_ctes(_STORE, select="SELECT hash, min(doc_id) AS doc_id, count(*) AS n_copies FROM pdf GROUP BY hash"),
    "cache_store": with_ctes(_STORE, select="""
      SELECT hash, invoice, strftime(cached_at, '%Y-%m-%d %H:%M:%S') AS cached_at, strftime(expires_at, '%Y-%m-%d %H:%M:%S') AS expires_at,
        strftime(cached_at, '%Y-%m-%d') AS cached_date FROM store"""),
    "cache_hits": _HITS,
    "store_lookup": _HITS,
    "cache_misses": with_ctes(_STORE, select=f"""
      SELECT doc_id, hash FROM pdf WHERE hash NOT IN (SELECT hash FROM store WHERE {_NOW} < expires_at)"""),
    "cache_invalidate": with_ctes(_STORE, select="""
      SELECT count(*) FILTER (WHERE cached_at < TIMESTAMP '2024-01-02') AS deleted_count,
        count(*) FILTER (WHERE cached_at >= TIMESTAMP '2024-01-02') AS kept_count FROM store"""),
    "all_results": with_ctes(*responses._CHAIN, """
came AS (
  SELECT *, sha256(text) AS hash, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id % 48 AS BIGINT)) AS came FROM scored),
live AS (SELECT hash FROM came GROUP BY hash HAVING TIMESTAMP '2024-01-02 12:00:00' < max(came) + INTERVAL 24 HOUR)""", select="""
      SELECT doc_id, CASE WHEN hit THEN 'cache_hit' ELSE 'paddleocr_gemini_text' END AS processing_method,
        hit OR n_err = 0 AS is_valid, CASE WHEN hit THEN 100.0::DOUBLE ELSE greatest(0, 100.0::DOUBLE - 20 * n_err - 5 * n_warn) END AS quality_score
      FROM (SELECT *, hash IN (SELECT hash FROM live) AS hit FROM came)"""),
    "ttl_dedup": _recursive("SELECT arrival_id, is_hit FROM flagged"),
    "cache_stats": _recursive("""
      SELECT count(*) FILTER (WHERE is_hit) AS hits, count(*) FILTER (WHERE NOT is_hit) AS misses,
        CAST(count(*) FILTER (WHERE is_hit) AS DOUBLE) / count(*) AS hit_ratio FROM flagged"""),
    "stream_ttl_dedup": _recursive("SELECT arrival_id, is_hit FROM flagged"),
    "stream_dedup": "SELECT DISTINCT sha256(user_id || event_type) AS hash FROM events",
    "stream_validate": validation.SQL["invoice_validation"],
    "stream_arrival_counts": _recursive("""
      SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, count(*) FILTER (WHERE is_hit) AS hits,
        count(*) FILTER (WHERE NOT is_hit) AS misses
      FROM flagged GROUP BY 1"""),
    "spanish_dates": with_ctes(TEXTS, r"""
d AS (
  SELECT doc_id, line, regexp_extract(line, '([0-9]{1,2})( de |\.|/)([0-9]{1,2})( de |\.|/)([0-9]{4})', ['d', 's', 'm', 't', 'y']) AS p
  FROM text_line WHERE line LIKE 'Fecha%')""", select="""
      SELECT doc_id, line, strftime(TRY_CAST(p.y || '-' || lpad(p.m, 2, '0') || '-' || lpad(p.d, 2, '0') AS DATE), '%Y-%m-%d') AS iso_date FROM d"""),
    "currency_norm": with_ctes(TEXTS, select=f"""
      SELECT * FROM (
        SELECT doc_id, CAST(i AS INT) AS line_no, CASE WHEN contains(line, '€') THEN 'EUR' WHEN contains(line, '$') THEN 'USD'
          WHEN contains(line, '£') THEN 'GBP' WHEN contains(line, '¥') THEN 'JPY' WHEN contains(line, '₹') THEN 'INR'
          ELSE nullif(regexp_extract(line, '(?:^|{NW})(EUR|USD|GBP|CAD|AUD|INR|JPY)(?:$|{NW})', 1), '') END AS currency FROM text_line)
      WHERE currency IS NOT NULL"""),
    "payment_method": with_ctes(TEXTS, select="""
      SELECT k AS doc_id, CASE k % 8 WHEN 0 THEN 'BANK_TRANSFER' WHEN 1 THEN 'CARD' WHEN 2 THEN 'CASH' WHEN 3 THEN 'CHECK'
        WHEN 4 THEN 'DIRECT_DEBIT' WHEN 5 THEN 'BANK_TRANSFER' WHEN 6 THEN 'DIRECT_DEBIT' END AS method FROM lined"""),
    "vendor_from_email": with_ctes(TEXTS, r"""
mails AS (SELECT k AS doc_id, regexp_extract(array_to_string(text_lines, chr(10)), '@([\p{L}\p{N}_-]+)\.', 1) AS d FROM lined)""",
        select=f"SELECT doc_id, CASE WHEN d <> '' THEN {_TITLE} END AS vendor FROM mails"),
    "tax_lines": with_ctes(TEXTS, rf"""
t AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS seq, line
  FROM text_line WHERE regexp_matches(line, '{_TAX}'))""", select=rf"""
      SELECT doc_id, seq, CASE WHEN seq = 0 THEN 'primary' ELSE 'additional' END AS role,
        trim(regexp_extract(line, '^([^0-9(:%]*)', 1)) AS type,
        {_amount_of(r"regexp_extract(line, '([0-9]+(?:[.,][0-9]+)?)\s*%', 1)")} AS rate,
        {_amount_of(r"regexp_extract(line, ':\s*[€$£]?\s*([0-9]+(?:[.,][0-9]+)?)', 1)")} AS amount FROM t"""),
    "pattern_c_rows": with_ctes(TEXTS, r"""
r AS (
  SELECT doc_id, line, list_transform(string_split(trim(regexp_extract(line, '^[A-Z]+-[0-9]+ .*?((?: [0-9]+,[0-9]+){3,})$', 1)), ' '),
    lambda x: CAST(replace(x, ',', '.') AS DOUBLE)) AS n
  FROM text_line WHERE regexp_matches(line, '^SKU-'))""", select=r"""
      SELECT doc_id, regexp_extract(line, '^([A-Z]+-[0-9]+)', 1) AS item_id, regexp_extract(line, '^[A-Z]+-[0-9]+ (Part [0-9]+)', 1) AS description,
        n[1] AS quantity, n[2] AS unit_price,
        list_filter(n[3:], lambda c: c >= n[1] * n[2] * 0.5::DOUBLE AND c <= n[1] * n[2] * 1.05::DOUBLE)[1] AS line_total FROM r"""),
    "utility_lines": with_ctes(TEXTS, r"""
u AS (
  SELECT doc_id, list_transform(regexp_extract_all(line, '[0-9]+(?:[.,][0-9]+)?'), lambda x: CAST(replace(x, ',', '.') AS DOUBLE)) AS n
  FROM text_line WHERE contains(line, ' kW × '))""", select="""
      SELECT doc_id, n[1] * n[2] AS quantity, n[3] AS unit_price, n[4] AS line_total FROM u"""),
    "item_exclusions": with_ctes(TEXTS, select=f"""
      SELECT doc_id, CAST(i AS INT) AS line_no,
        regexp_matches(line, '(?i)(^|{NW})({_NO_ITEM})(e?s)?($|{NW})') AS excluded FROM text_line"""),
    "null_defaults": with_ctes(ANSWERS, select="""
      SELECT doc_id, CASE WHEN doc_id % 26 = 0 OR doc_id % 34 = 0 THEN 'Unknown' ELSE 'Receptor' END AS customer,
        CASE WHEN doc_id % 53 = 0 THEN '21' ELSE 'IVA' END AS tax_type,
        CASE WHEN doc_id % 7 = 0 THEN 0 ELSE CAST(stated AS DOUBLE) / 100 END AS subtotal,
        CASE WHEN doc_id % 59 = 0 THEN 0 ELSE CAST(total AS DOUBLE) / 100 END AS total, CAST(i - 1 AS INT) AS item_no,
        CAST(q AS DOUBLE) AS quantity, CAST(p AS DOUBLE) / 100 AS unit_price, CAST(t AS DOUBLE) / 100 AS line_total
      FROM parsed LEFT JOIN item ON k = doc_id WHERE parse <> 'failed'"""),
    "item_defaults": with_ctes(ANSWERS, select="""
      SELECT doc_id, CAST(i - 1 AS INT) AS item_no, CAST(q AS DOUBLE) AS quantity, CAST(p AS DOUBLE) / 100 AS unit_price,
        CAST(t AS DOUBLE) / 100 AS line_total
      FROM parsed JOIN item ON k = doc_id WHERE parse <> 'failed'"""),
    "ocr_digit_fix": with_ctes(LINES, responses._LINE_TEXT, _GARBLED, select="""
      SELECT doc_id, line_no, string_agg(f, ' ' ORDER BY i) AS text FROM fixed GROUP BY doc_id, line_no"""),
    "page_quality": with_ctes(_METRICS, select="SELECT *, score < 70 AS needs_preparation FROM rated"),
    "preprocess_plan": with_ctes(_METRICS, select="""
      SELECT CASE WHEN score < 70 THEN concat_ws('>', CASE WHEN abs(rotation) > 2 THEN 'deskew' END, CASE WHEN noise > 30 THEN 'denoise' END,
        CASE WHEN contrast < 50 THEN 'contrast' END, CASE WHEN NOT is_scan THEN 'crop' END) ELSE '' END AS plan, count(*) AS n_pages
      FROM rated GROUP BY 1"""),
    "format_checks": with_ctes(CHECKS, select="""
      SELECT coalesce(currency, 'none') AS currency, count(*) AS n_docs, count(*) FILTER (WHERE TRY_CAST(issued AS DATE) IS NOT NULL) AS n_dates,
        count(*) FILTER (WHERE doc_id % 4 = 1) AS n_due_dates, count(*) FILTER (WHERE doc_id % 4 = 2) AS n_bad_due_dates,
        count(currency) AS n_codes FROM head WHERE NOT failed GROUP BY 1"""),
    "tax_id_check": with_ctes(TEXTS, _IDS, select="""
      SELECT doc_id, tax_id, kind, CASE WHEN kind = 'CIF' THEN right(tax_id, 1) IN (CAST(c AS VARCHAR), substr('JABCDEFGHI', CAST(c + 1 AS INT), 1))
        ELSE right(tax_id, 1) = substr('TRWAGMYFPDXBNJZSQVHLCKE', CAST(num % 23 + 1 AS INT), 1) END AS is_valid FROM control"""),
    "completeness": with_ctes(CHECKS, select="""
      SELECT doc_id, CAST(11 + CAST(coalesce(issued, '') <> '' AS INT) + CAST(doc_id % 4 IN (1, 2) AS INT) + CAST(vendor <> '' AS INT)
        + CAST(coalesce(vendor_tax, '') <> '' AS INT) + CAST(customer <> '' AS INT) + CAST(currency IS NOT NULL AS INT)
        + 2 * CAST(disc IS NOT NULL AS INT) + 3 * CAST(extra IS NOT NULL AS INT) + 3 * CAST(wh IS NOT NULL AS INT)
        + 2 * CAST(sur IS NOT NULL AS INT) + 5 * CAST(n > 0 AS INT)
        + CAST(doc_id % 43 = 0 OR doc_id % 61 = 0 OR doc_id % 67 = 0 AS INT) AS DOUBLE) / 52 AS share
      FROM head WHERE NOT failed"""),
    "is_invoice": with_ctes(TEXTS, """
both_texts AS (
  SELECT 'inv' AS src, k AS doc_id, lower(array_to_string(text_lines, chr(10))) AS t FROM lined
  UNION ALL SELECT 'doc', doc_id, lower(text) FROM documents)""", select=f"""
      SELECT src, doc_id, score, score >= 3 AS is_invoice
      FROM (SELECT src, doc_id, {' + '.join(f"CAST(contains(t, '{w}') AS INT)" for w in _WORDS)} AS score FROM both_texts)"""),
    "quality_metrics": with_ctes(
        ANSWERS + ", checked_head AS (SELECT * FROM head)" + CHECK_STEPS, validation._SEMANTIC, """
scored AS (
  SELECT 'model' || (doc_id % 4) AS source,
    sum(CASE WHEN failed THEN 0 ELSE greatest(0, 100 - 20 * n_err - 5 * n_warn) END) AS points FROM result GROUP BY 1),
rates AS (SELECT source, count(*) AS n_docs, count(*) FILTER (WHERE status = 'success') AS ok FROM stat GROUP BY source)""", select="""
      SELECT r.source, n_docs, CAST(ok AS DOUBLE) / n_docs AS success_rate, CAST(points AS DOUBLE) / n_docs AS mean_score
      FROM rates r JOIN scored s ON r.source = s.source"""),
}
