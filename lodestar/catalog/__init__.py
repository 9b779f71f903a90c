"""Registered queries: modules with QUERIES (name -> callable) and SQL (name -> DuckDB text)."""
