"""Expected results of the validation queries."""

from billgrain.plans.oracle.base import CHECKS, ITEMS, LINES, NEGATIVE, with_ctes

_SUB_MESSAGE = (
    "printf('Subtotal mismatch: sum of items is %.2f, but subtotal is %.2f', items_sum, subtotal)"
)

_FINDINGS = """
found AS (
  SELECT doc_id, 1 AS block, 0 AS a, 0 AS b, 'financial_details.subtotal' AS field, 'subtotal_mismatch' AS issue_type,
    printf('Subtotal mismatch: sum of items is %.2f, but subtotal is %.2f', isum, subtotal) AS message,
    'error' AS severity, isum AS expected, subtotal AS actual FROM texts WHERE sub_bad AND NOT failed
  UNION ALL
  SELECT doc_id, 2, i, o, 'items[' || (i - 1) || '].' || field, code,
    'Item ''' || descr || ''' has negative ' || field || ': ' || value, 'error', NULL, value FROM neg
  UNION ALL
  SELECT doc_id, 3, 0, 0, 'financial_details.total_amount', 'total_mismatch',
    printf('Total mismatch: calculated %.2f, stated %.2f (diff: %.2f)', calculated, total, tdiff),
    'warning', calculated, total FROM texts WHERE tot_bad AND NOT failed
  UNION ALL
  SELECT doc_id, 4, 0, 0, 'financial_details.tax.rate', 'unreasonable_tax_rate',
    'Tax rate ' || rate || '% is outside reasonable range (0-100%)', 'warning', NULL, rate
    FROM texts WHERE rate_bad AND NOT failed
  UNION ALL
  SELECT doc_id, 5, 0, 0, 'financial_details.discount.amount', 'excessive_discount',
    'Discount ' || disc || ' exceeds subtotal ' || fixed, 'error', fixed, disc FROM texts WHERE disc_bad AND NOT failed
  UNION ALL
  SELECT doc_id, 6, 0, 0, 'financial_details.total_amount', 'negative_total',
    'Total amount is negative: ' || total, 'error', NULL, total FROM texts WHERE neg_bad AND NOT failed),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block, a, b) - 1 AS INT) AS seq FROM found)
"""

_SEMANTIC = """
result AS (
  SELECT doc_id, failed,
    CASE WHEN failed THEN 'FATAL: Invoice object is None, indicating a catastrophic failure in parsing.'
         ELSE concat_ws(' | ', CASE WHEN req <> '' THEN req END, CASE WHEN outcome = 'error' THEN math_text END) END AS errors,
    CASE WHEN failed THEN '' ELSE concat_ws(' | ',
      CASE WHEN outcome = 'unverified'
           THEN 'Could not verify mathematical consistency: unreadable multi-period extension' END,
      CASE WHEN dq <> '' THEN dq END) END AS warnings,
    n_req + CAST(outcome = 'error' AS INT) AS n_err, n_dq + CAST(outcome = 'unverified' AS INT) AS n_warn
  FROM texts)
"""

SQL = {
    "subtotal_issues": with_ctes(LINES, select=f"""
      SELECT doc_id, 'financial_details.subtotal' AS field, 'subtotal_mismatch' AS issue_type,
        {_SUB_MESSAGE} AS message, 'error' AS severity, items_sum AS expected, subtotal AS actual
      FROM stated WHERE abs(items_sum - subtotal) > 0.02"""),
    "subtotal_corrected": with_ctes(LINES, select="""
      SELECT doc_id, subtotal AS stated,
        CASE WHEN abs(items_sum - subtotal) > 0.02 THEN items_sum ELSE subtotal END AS subtotal,
        CASE WHEN abs(items_sum - subtotal) > 0.02 THEN 1 ELSE 0 END AS corrections_applied
      FROM stated"""),
    "negative_amount_issues": with_ctes(LINES, select="""
      SELECT doc_id, 'items[' || (line_no - 1) || '].' || field AS field, code AS issue_type,
        'Item ''' || description || ''' has negative ' || field || ': ' || value AS message,
        'error' AS severity, CAST(NULL AS DOUBLE) AS expected, value AS actual
      FROM (SELECT doc_id, line_no, description, unnest([
              {field: 'line_total', code: 'negative_amount', value: line_total},
              {field: 'unit_price', code: 'negative_price', value: unit_price},
              {field: 'quantity', code: 'negative_quantity', value: quantity}], recursive := true) FROM rec)
      WHERE value < 0"""),
    "unit_price_suspicion": with_ctes(LINES, select="""
      SELECT doc_id, n_items, n_rate_like,
        CASE WHEN n_rate_like / n_items > 0.8 THEN 'critical'
             WHEN n_rate_like / n_items > 0.5 THEN 'warning' ELSE 'none' END AS level
      FROM facts"""),
    "total_issues": with_ctes(CHECKS, select="""
      SELECT doc_id, calculated AS expected, total AS actual,
        printf('Total mismatch: calculated %.2f, stated %.2f (diff: %.2f)', calculated, total, tdiff) AS message
      FROM texts WHERE tot_bad AND NOT failed"""),
    "reasonableness_issues": with_ctes(CHECKS, NEGATIVE, _FINDINGS, select="""
      SELECT doc_id, field, issue_type, message, severity, expected, actual FROM found WHERE block IN (4, 5, 6)"""),
    "math_findings": with_ctes(CHECKS, NEGATIVE, _FINDINGS, select="""
      SELECT doc_id, seq, field, issue_type, message, severity, expected, actual FROM ranked"""),
    "math_validation": with_ctes(CHECKS, NEGATIVE, _FINDINGS, select="""
      SELECT t.doc_id, coalesce(f.n_err, 0) = 0 AS is_valid, coalesce(f.n, 0) AS n_issues,
        coalesce(f.kinds, '') AS issue_types, CAST(t.sub_bad AS INT) AS corrections_applied, t.fixed AS subtotal
      FROM texts t LEFT JOIN (
        SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE severity = 'error') AS n_err,
          string_agg(issue_type, ',' ORDER BY seq) AS kinds FROM ranked GROUP BY doc_id) f ON t.doc_id = f.doc_id
      WHERE NOT failed"""),
    "required_field_errors": with_ctes(CHECKS, select="""
      SELECT doc_id, n_req AS n_errors, req AS errors FROM texts WHERE NOT failed AND n_req > 0"""),
    "semantic_total_errors": with_ctes(CHECKS, select="""
      SELECT doc_id, outcome, expected, total AS actual, CASE WHEN outcome = 'error' THEN math_text END AS message
      FROM texts WHERE NOT failed AND outcome <> 'ok'"""),
    "data_quality_warnings": with_ctes(CHECKS, select="""
      SELECT doc_id, n_dq AS n_warnings, dq AS warnings FROM texts WHERE NOT failed AND n_dq > 0"""),
    "invoice_validation": with_ctes(CHECKS, _SEMANTIC, select="""
      SELECT doc_id, errors = '' AS is_valid, errors, warnings,
        CASE WHEN failed THEN 0.0::DOUBLE ELSE greatest(0, 100.0::DOUBLE - 20 * n_err - 5 * n_warn) END AS quality_score
      FROM result"""),
    "quick_validation": with_ctes(CHECKS, select="""
      SELECT doc_id, NOT failed AND n_req = 0 AS is_valid,
        CASE WHEN failed THEN 'FATAL: Invoice object is None, indicating a catastrophic failure in parsing.'
             ELSE req END AS errors,
        CASE WHEN failed THEN 0.0::DOUBLE ELSE 100.0::DOUBLE - 20 * n_req END AS quality_score
      FROM texts"""),
    "quality_score": with_ctes(CHECKS, _SEMANTIC, select="""
      SELECT CASE WHEN failed THEN 0.0::DOUBLE ELSE greatest(0, 100.0::DOUBLE - 20 * n_err - 5 * n_warn) END AS quality_score,
        count(*) AS n_docs FROM result GROUP BY 1"""),
    "suspicious_item_sample": with_ctes(ITEMS, select="""
      SELECT i.k AS doc_id, CAST(i AS INT) AS item_no, left(descr, 40) AS label, CAST(p AS DOUBLE) / 100 AS unit_price
      FROM item i JOIN (
        SELECT k FROM item GROUP BY k
        HAVING count(*) FILTER (WHERE p IN (0, 300, 700, 1500, 2100)) / count(*) > 0.8) s ON i.k = s.k
      WHERE i.k % 97 <> 0 AND i <= 5 AND p IN (0, 300, 700, 1500, 2100)"""),
}
