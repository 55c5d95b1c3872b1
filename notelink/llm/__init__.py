"""Training-data operators (deduplication, packing, scoring, formatting).

Nothing else in the library imports this subpackage.
"""
