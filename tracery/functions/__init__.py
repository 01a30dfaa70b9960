"""Scalar column functions: casts, times and locations."""
