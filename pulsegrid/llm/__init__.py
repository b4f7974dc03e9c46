"""Training-data operators: language ID, packing, scoring, filtering, dedup, search and mixing.

Nothing else in the library imports this subpackage.
"""
