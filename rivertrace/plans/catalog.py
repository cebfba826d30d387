"""All registered queries: name -> (query, equivalent SQL or None)."""

from __future__ import annotations

from rivertrace.plans import attribution_queries, detection_queries, investigation_queries, log_queries, network_queries, scenario_queries, stream_queries

QUERIES = {
    **network_queries.QUERIES,
    **detection_queries.QUERIES,
    **attribution_queries.QUERIES,
    **investigation_queries.QUERIES,
    **scenario_queries.QUERIES,
    **log_queries.QUERIES,
    **stream_queries.QUERIES,
}
