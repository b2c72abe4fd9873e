"""Training-data operators: deduplication, filters, tokenisation, packing.

Nothing outside this subpackage imports it.  Each module holds one operator with
a general interface; ``queries`` wraps them into the registered ``opN_`` queries.
"""
