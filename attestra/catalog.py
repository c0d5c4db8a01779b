"""Registry of the engine's queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attestra.plans import queries_decide, queries_documents, queries_graph

FLAGSHIP = "kg_candidates_v2_topk"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**queries_graph.QUERIES, **queries_decide.QUERIES, **queries_documents.QUERIES}
ORACLES: dict[str, str] = {**queries_graph.ORACLES, **queries_decide.ORACLES, **queries_documents.ORACLES}
