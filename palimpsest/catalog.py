"""The registry of the engine's queries and of the SQL that gives the same rows."""

from .plans import corpus_queries, generic_queries

FLAGSHIP = "inspect_summary"
QUERIES = {**corpus_queries.QUERIES, **generic_queries.QUERIES}
ORACLE_SQL = {**corpus_queries.ORACLE_SQL, **generic_queries.ORACLE_SQL}
