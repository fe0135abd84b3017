"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it; it can be deleted as a whole.
"""
