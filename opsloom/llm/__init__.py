"""Operators of a large training-data pipeline over text corpora.

Nothing outside this subpackage imports it; removing the folder leaves the rest
of the library working.
"""
