"""Column functions: text, marks, metering, identity, formats."""
