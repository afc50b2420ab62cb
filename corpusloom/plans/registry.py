"""All registered queries and their DuckDB counterparts."""

from corpusloom.plans import flows, ingest, records, retrieval

_MODULES = (ingest, retrieval, records, flows)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
