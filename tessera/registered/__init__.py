"""Queries over the star-schema tables that exercise every operator, with DuckDB equivalents."""
