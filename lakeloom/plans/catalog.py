"""All core queries and the SQL that checks them."""

from __future__ import annotations

from . import corpus_queries, graph_queries, prep_queries, scoring_queries, statistics_queries, store_queries  # noqa: F401  (modules add their queries to those of corpus_queries)

FLAGSHIP = "governed_claims"
QUERIES: dict = {**corpus_queries.QUERIES}
SQL: dict = {**corpus_queries.SQL}
