"""All registered queries and their SQL oracles."""

from __future__ import annotations

from seqloom.plans import assembly, basics, contigs, gaps, graph, whole

QUERIES: dict = basics.QUERIES | assembly.QUERIES | graph.QUERIES | gaps.QUERIES | contigs.QUERIES | whole.QUERIES
ORACLE_SQL: dict = basics.ORACLE_SQL | assembly.ORACLE_SQL | graph.ORACLE_SQL | gaps.ORACLE_SQL | contigs.ORACLE_SQL
