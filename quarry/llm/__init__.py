"""Operators for building training corpora at scale.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface; ``queries`` registers one driver query per
operator with its production parameters.
"""
