"""Operators for large training-data corpora.

One module per operator, each a DataFrame -> DataFrame function; ``queries``
binds them to the given tables. Nothing else in the library imports this
subpackage.
"""
