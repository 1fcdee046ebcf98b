"""Training-data operators: deduplication, filtering, scanning and tokenising.

Nothing outside this subpackage imports it.  Every operator takes DataFrames
and column names, selects just the columns it needs (so extra columns, even
with the names of its results, never clash) and documents what it gives for
null, empty, repeated and very long rows.
"""
