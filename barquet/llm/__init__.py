"""Operators that a large training-data pipeline needs, one module each.

Nothing outside this subpackage imports it; ``queries.py`` registers its queries.
"""
