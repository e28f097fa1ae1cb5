"""Scalar functions on typed values."""
