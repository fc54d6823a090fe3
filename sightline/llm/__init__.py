"""Training-data operators: dedup, mixing, scoring, archives, tokens and search.

Nothing outside this subpackage imports it.
"""
