"""Operators that prepare code and text collections for model training.

Nothing outside this subpackage imports it.
"""
