"""The answer journal as a stream."""
