"""Training-data operators: packing, sanitising, deduplicating, mixing and scoring text tables.

Nothing outside this subpackage imports it.
"""
