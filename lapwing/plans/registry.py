"""All queries of the library and their oracles."""

from lapwing.plans import catalog_queries, integrity_queries, report_queries, text_queries

_PARTS = (text_queries, integrity_queries, report_queries, catalog_queries)
QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLES = {k: v for p in _PARTS for k, v in p.ORACLES.items()}
