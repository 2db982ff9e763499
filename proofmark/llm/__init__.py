"""Operators for preparing language-model training corpora.

Each module holds one operator with a general DataFrame interface.  ``queries``
applies every operator to its whole table and derives the digest columns that
the registered queries return.  Nothing outside this subpackage imports it.
"""
