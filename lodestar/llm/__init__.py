"""Operators for preparing large text corpora.

Nothing outside this subpackage imports it, and it imports nothing of the
rest of the library.  Every module holds one operator with a general
interface; ``contracts`` derives the registered queries from them.
"""
