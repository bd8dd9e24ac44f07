"""Expected results by query name, as SQL over the given tables."""

from billgrain.plans.oracle import misc, pages, responses, validation, zones

SQL = {
    **validation.SQL,
    **zones.SQL,
    **pages.SQL,
    **responses.SQL,
    **misc.SQL,
}
