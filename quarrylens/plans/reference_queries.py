"""Queries of the reference's own operators."""

from quarrylens.plans import code_queries, more_queries, relate_queries, report_queries, stat_queries

_MODULES = [stat_queries, relate_queries, more_queries, report_queries, code_queries]
QUERIES: dict = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
