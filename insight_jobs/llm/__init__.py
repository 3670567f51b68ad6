"""Training-data operators: scoring, filtering, near-duplicates, packing, sharding, token output.

Nothing outside this subpackage imports it.
"""
