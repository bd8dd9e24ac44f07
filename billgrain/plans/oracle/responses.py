"""Expected results of the model answer, correction and processing queries."""

from billgrain.plans.oracle.base import (
    ANSWERS, CHECK_STEPS, HEADS, ITEM_D, LINES, NEGATIVE, TEXTS, amount, repaired, tokens, with_ctes,
)

_NESTED = (ITEM_D, tokens("tok", "text_line", "line", "i"), repaired("fixed", "item_d", "tok"))

_LINE_TEXT = f"""
line_text AS (
  SELECT doc_id, line_no, description || ' ' || abs(qty_c) || ',000 ' || {amount('price_c')} || ' ' || disc || ',00 '
    || CASE WHEN doc_id % 13 = 0 THEN '' ELSE {amount('net')} || ' ' END || tax || ',0' AS text FROM rec),
line_d AS (
  SELECT doc_id, line_no AS i, description, quantity AS q, unit_price AS p, line_total AS t FROM rec)"""

_AFTER = """, checked_head AS (
  SELECT h.* EXCLUDE (isum), coalesce(f.isum, 0) AS isum FROM head h LEFT JOIN (
    SELECT doc_id, CAST(sum(CAST(fixed_t AS DECIMAL(38, 6))) AS DOUBLE) AS isum FROM fixed GROUP BY doc_id) f ON h.doc_id = f.doc_id)"""

_CHAIN = (
    TEXTS, *_NESTED[:-1], _NESTED[-1] + _AFTER + CHECK_STEPS,
    """
negatives AS (
  SELECT doc_id, CAST(sum(CAST(fixed_t < 0 AS INT) + CAST(p < 0 AS INT) + CAST(q < 0 AS INT)) AS BIGINT) AS n_neg FROM fixed GROUP BY doc_id),
scored AS (
  SELECT t.*, coalesce(n_neg, 0) AS n_neg, n_req + CAST(outcome = 'error' AS INT) AS n_err,
    n_dq + CAST(outcome = 'unverified' AS INT) AS n_warn, array_to_string(text_lines, chr(10)) AS text
  FROM texts t JOIN lined ON lined.k = t.doc_id LEFT JOIN negatives n ON n.doc_id = t.doc_id WHERE NOT failed)""",
)

_TIMES = """
times AS (
  SELECT o_orderkey AS doc_id, unnest([
    {stage: 'ocr_time', ms: o_orderkey % 900 + 100}, {stage: 'structuring_time', ms: o_orderkey % 400 + 50},
    {stage: 'correction_time', ms: o_orderkey % 7}, {stage: 'mathematical_validation_time', ms: o_orderkey % 5},
    {stage: 'validation_time', ms: o_orderkey % 3}], recursive := true) FROM orders)"""

SQL = {
    "json_strip_fence": with_ctes(ANSWERS, select="SELECT doc_id, unfenced AS text FROM fenced"),
    "json_strip_comments": with_ctes(ANSWERS, select="SELECT doc_id, text FROM cleaned"),
    "json_repair": with_ctes(ANSWERS, select="SELECT doc_id, parse FROM parsed"),
    "schema_violations": with_ctes(ANSWERS, select="""
      SELECT doc_id, CAST(n_violations AS INT) AS n_violations, violations FROM stat WHERE parse <> 'failed'"""),
    "ingest_status_counts": with_ctes(ANSWERS, select="SELECT status, count(*) AS n_docs FROM stat GROUP BY status"),
    "ingest_status_rollup": with_ctes(ANSWERS, select="""
      SELECT source, status, count(*) AS n_docs FROM stat GROUP BY ROLLUP (source, status)"""),
    "structuring_failures": with_ctes(ANSWERS, select="""
      SELECT doc_id, false AS success, status AS error, CASE WHEN parse <> 'failed' THEN violations END AS error_detail,
        'paddleocr_gemini_text' AS processing_method FROM stat WHERE status <> 'success'"""),
    "accepted_invoices": with_ctes(ANSWERS, select="""
      SELECT doc_id, json_extract_string(text, '$.metadata.issue_date') AS issue_date, 'Supplier # ' || (doc_id % 100) AS vendor,
        CAST(stated AS DOUBLE) / 100 AS subtotal, CAST(total AS DOUBLE) / 100 AS total, CAST(n AS INT) AS n_items,
        CASE WHEN doc_id % 6 = 0 AND doc_id % 5 NOT IN (1, 2) THEN '{"origin":"ocr"}' ELSE '{}' END AS extra
      FROM (SELECT * EXCLUDE (text), CASE WHEN parse = 'parsed' THEN text
              ELSE '{"metadata":' || regexp_extract(text, '"metadata":(\\{[^}]*\\})', 1) || '}' END AS text
            FROM stat WHERE status = 'success')"""),
    "corrected_invoices": with_ctes(TEXTS, *_NESTED, select="""
      SELECT f.doc_id, level AS price_suspicion, CAST(f.i - 1 AS INT) AS item_no, fixed_t AS line_total
      FROM fixed f JOIN (
        SELECT k, CASE WHEN avg(CAST(p IN (0, 300, 700, 1500, 2100) AS INT)) > 0.8 THEN 'critical'
            WHEN avg(CAST(p IN (0, 300, 700, 1500, 2100) AS INT)) > 0.5 THEN 'warning' ELSE 'none' END AS level
        FROM item GROUP BY k) s ON s.k = f.doc_id WHERE f.doc_id % 97 <> 0"""),
    "number_tokens": with_ctes(TEXTS, tokens(
        "tok", "(SELECT 'inv' AS src, k AS doc_id, array_to_string(text_lines, chr(10)) AS text FROM lined"
               " UNION ALL SELECT 'doc', doc_id, text FROM documents)", "text", "0", "src, doc_id"), select="""
      SELECT src, doc_id, CAST(j AS INT) AS idx, v AS value FROM tok"""),
    "line_total_fix": with_ctes(LINES, _LINE_TEXT, tokens("tok", "line_text", "text", "line_no"),
        repaired("fixed", "line_d", "tok"), select="""
      SELECT doc_id, i AS line_no, left(description, 40) AS label, t AS printed, fixed_t AS line_total, was_fixed AS repaired
      FROM fixed"""),
    "invoice_assemble": with_ctes(LINES, select="""
      SELECT s.doc_id, custkey, subtotal, line_no, description, quantity, unit_price, line_total
      FROM stated s LEFT JOIN rec r ON s.doc_id = r.doc_id"""),
    "processing_results": with_ctes(*_CHAIN, select="""
      SELECT doc_id, true AS success, sha256(text) AS document_hash, 'paddleocr_gemini_text' AS processing_method,
        n_err = 0 AS is_valid, greatest(0, 100.0::DOUBLE - 20 * n_err - 5 * n_warn) AS quality_score,
        NOT sub_bad AND n_neg = 0 AND NOT disc_bad AND NOT neg_bad AS math_valid,
        CAST(CAST(sub_bad AS INT) + n_neg + CAST(tot_bad AS INT) + CAST(rate_bad AS INT) + CAST(disc_bad AS INT)
          + CAST(neg_bad AS INT) AS INT) AS n_issues,
        round((doc_id % 900 + 100 + doc_id % 400 + 50 + doc_id % 7 + doc_id % 5 + doc_id % 3) / 1000, 3) AS total_time
      FROM scored"""),
    "stage_times": with_ctes(_TIMES, select="""
      SELECT stage, count(*) AS n_docs, CAST(sum(ms) AS DOUBLE) / count(*) / 1000 AS mean_seconds,
        CAST(quantile_disc(ms, 0.5) AS DOUBLE) / 1000 AS median_seconds, CAST(max(ms) AS DOUBLE) / 1000 AS max_seconds
      FROM times GROUP BY stage"""),
}
