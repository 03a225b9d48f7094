"""Operators of a training-data pipeline over text, tokens and vectors.

Nothing else in the package imports this subpackage.
"""
