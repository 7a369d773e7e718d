"""Queries by name, with the DuckDB SQL that gives the same rows where SQL can.

The small samples in ``samples`` read no table; they are tested, not registered.
"""

from tessera.plans import crafted, documents, parts, tables

QUERIES = {name: query for name, (query, _) in documents.QUERIES.items()} | tables.SCANS | tables.TABLES | parts.QUERIES | crafted.QUERIES
ORACLE_SQL = {name: sql for name, (_, sql) in documents.QUERIES.items() if sql} | parts.ORACLE_SQL | crafted.ORACLE_SQL
