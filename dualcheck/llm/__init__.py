"""Operators for preparing training data: quality, duplicates, secrets, packing,
encoding, URL filters, vector search, personal data and chat formatting.

Every operator takes the columns it needs by name and returns the id column and
its own results, so that extra columns of the input, whatever their names, can
neither break it nor be broken by it.
"""
