"""Training-data operators (search, filters, mixing, tokenizing, privacy, deduplication, sharding).

Nothing else in the library imports this subpackage; ``queries`` registers one query per operator.
"""
