"""Structured Streaming forms of validation, baselines, health and the audit ledger."""
