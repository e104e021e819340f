"""Registered queries: each pairs a Spark build with the SQL that states the same result."""

from tidemark.plans.registry import QUERIES, build, sql_text  # noqa: F401
from tidemark.plans import (  # noqa: F401  (importing registers the queries)
    source_queries,
    cleaning_queries,
    join_queries,
    summary_queries,
    window_queries,
    test_queries,
    model_queries,
    portfolio_queries,
    text_queries,
)
