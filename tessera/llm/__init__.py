"""Operators for preparing training data: one module per operator.

Nothing else in the library imports this subpackage; it may import the
library's general helpers.  ``queries.py`` registers one query per operator.
"""
