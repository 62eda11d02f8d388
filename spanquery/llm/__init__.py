"""Operators for preparing language-model training data, each a DataFrame -> DataFrame function.

Nothing else in the library imports this subpackage.  ``queries`` registers the thirteen operators; the
corpus pipeline at the repository top is registered by the entry point.
"""
