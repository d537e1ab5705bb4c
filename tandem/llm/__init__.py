"""Training-data operators: deduplication, filtering, scanning, tokenising.

Nothing else in the library imports this package.
"""
