"""Operators of a training-data pipeline over the synthetic corpus tables.

Nothing outside this subpackage imports it.
"""
