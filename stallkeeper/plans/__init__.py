"""Registered queries, each next to its DuckDB oracle."""
