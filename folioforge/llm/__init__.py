"""Training-data operators: mixing, dedup, language, quality, packing, search, scoring.

Nothing else in the library imports this subpackage; it may import the rest.
"""
