"""Scalar Column expressions (no actions)."""
