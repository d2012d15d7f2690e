"""Operators of a training-data pipeline over text tables (see README)."""
