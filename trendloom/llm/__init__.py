"""Training-data operators: deduplication, packing, tokens, similarity joins, scans and scores.

Nothing outside this folder imports it, so that the rest of the library works without it.
"""
