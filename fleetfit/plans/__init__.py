"""Composed queries: fleet inputs, the query registry and its SQL oracles."""
