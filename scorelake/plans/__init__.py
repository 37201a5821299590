"""Dimension tables, whole evaluation plans, and the registered queries."""
