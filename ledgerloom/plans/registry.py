"""The queries a driver can run, with the SQL that states each result."""

from __future__ import annotations

from ledgerloom.plans import account_queries, case_queries, day_queries, evidence_queries, link_queries, lifecycle_queries, loop_queries, report_queries, text_queries

FLAGSHIP = "case_outcomes"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (text_queries, case_queries, link_queries, lifecycle_queries, report_queries, day_queries, evidence_queries, loop_queries, account_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
