"""All queries of the engine by name, and the SQL that must give the same rows."""

from __future__ import annotations

from maskwright.plans import flow_queries, logic_queries, rule_queries, text_queries

MODULES = (rule_queries, text_queries, logic_queries, flow_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
FLAGSHIP = logic_queries.gate_documents
