"""Training-data operators: quality, deduplication, mixing, extraction, decontamination.

Nothing outside this subpackage imports it.
"""
