"""Training-data operators: deduplication, mixing, packing, search and text scoring.

Nothing else in the library imports this subpackage; ``queries.py`` registers its queries.
"""
