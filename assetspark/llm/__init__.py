"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  ``registry`` holds the queries
that the entry module adds when the subpackage is present.
"""
