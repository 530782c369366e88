"""Training-data operators: deduplication, decontamination, filtering, mixing and sharding.

Nothing outside this subpackage imports it.
"""
