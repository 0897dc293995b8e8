"""Every query of the engine with its SQL (None where SQL can't say it)."""

from __future__ import annotations

from kymora.plans import array_queries, frame_queries, guard_queries, state_queries, stream_queries, table_queries

QUERIES: dict = {**table_queries.QUERIES, **stream_queries.QUERIES, **array_queries.QUERIES, **guard_queries.QUERIES, **frame_queries.QUERIES, **state_queries.QUERIES}
