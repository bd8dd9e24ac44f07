"""All registered queries by name: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from billgrain.plans import extract_queries, page_queries, response_queries, reuse_queries, validation_queries, zone_queries

QUERIES = {
    **validation_queries.QUERIES,
    **zone_queries.QUERIES,
    **page_queries.QUERIES,
    **response_queries.QUERIES,
    **reuse_queries.QUERIES,
    **extract_queries.QUERIES,
}
