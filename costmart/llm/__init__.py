"""Training-data operators: quality, dedup, extraction, sharding, filters, packing.

Each module holds one operator with its own general interface; ``queries``
registers one query per operator.  Nothing outside this package imports it.
"""
