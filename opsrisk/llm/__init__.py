"""Training-data operators: quality rules, near-duplicate joins, dedup, scoring, mixing, tokens.

Nothing else in the library imports this subpackage.
"""
