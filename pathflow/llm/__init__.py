"""Operators for large training-text corpora.

Every module here is self-contained within this subpackage: nothing else in
the library imports it, and it imports nothing from the rest of the library.
"""
