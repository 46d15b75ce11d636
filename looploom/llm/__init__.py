"""Operators of a training-data pipeline. Nothing outside this sub-package imports it."""
