"""Training-data operators: dedup, extraction, decontamination, sharding, packing and more.

Nothing else in the library imports this subpackage.
"""
