"""All core queries by name, and their SQL."""

from tallyfold.plans import estimate_queries, ledger_queries, pipeline_queries, problems, register_queries, table_queries

_PARTS = [problems, register_queries, ledger_queries, table_queries, estimate_queries, pipeline_queries]

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
