"""Checks and benchmark queries over mail derived from the given tables."""
