"""Operators on tables of bars keyed by (symbol, tf)."""
