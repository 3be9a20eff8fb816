"""Readers, history merge, adapters over the test tables, and sinks."""
