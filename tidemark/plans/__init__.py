"""Registered queries: each module has QUERIES and, for DuckDB, ORACLE_SQL."""
