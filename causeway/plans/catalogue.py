"""Every registered query of the evidence engine, with the SQL that gives the same rows."""

from causeway.plans import evaluation_queries, evidence_queries, graph_queries

_PARTS = (graph_queries, evidence_queries, evaluation_queries)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
