"""Operators that prepare catalogue data and documents for model training.

Nothing outside this subpackage imports it.
"""
