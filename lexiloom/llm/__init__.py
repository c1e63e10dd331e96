"""Training-data operators: deduplication, search, tokenisation, classification, mixing.

Nothing outside this subpackage imports it.
"""
