"""Readers with fixed schemas, their checks, and writers."""
