"""The query modules of the core."""

from __future__ import annotations

from pairlight.plans import operator_queries, reference_queries, wide_queries

MODULES = (reference_queries, operator_queries, wide_queries)
FLAGSHIP = "overall_summary"
