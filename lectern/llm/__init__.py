"""Operators over training text: copies, mixing, filters, packing, tokens, personal data, search.

Nothing else in the library imports this package.
"""
