"""Corpus operators for language-model training data.

Nothing outside this package imports it.  ``queries.QUERIES`` and
``queries.ORACLE_SQL`` are what the entry module registers.
"""
