"""Training-data operators: cleaning, deduplication, search, token and archive output.

Nothing outside this subpackage imports it.  ``registry`` holds the query and SQL tables.
"""
