"""Operators for preparing training text, kept apart from the rest of the library."""
