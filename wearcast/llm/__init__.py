"""Operators of a training-data pipeline over `documents`, `pages` and `benchmark`.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its general interface; `queries.py` registers one query per
operator and derives the digest columns of its contract.
"""
