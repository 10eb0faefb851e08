"""All queries of the engine by name, each over the tables in a folder, with their DuckDB equivalents."""

from __future__ import annotations

from codestrata.plans import index, lineages, retrieval

QUERIES: dict = retrieval.Q | index.Q | lineages.Q
ORACLES: dict = retrieval.SQL | index.SQL | lineages.SQL
