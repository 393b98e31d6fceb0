"""Registered queries: inputs derived from the given tables, plans, and their SQL twins."""
