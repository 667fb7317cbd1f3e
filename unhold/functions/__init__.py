"""Scalar column functions (built-in Spark expressions only)."""
