"""Operators of a training-data pipeline over tables of documents and pages.

Nothing else in the library imports this subpackage.  ``queries.QUERIES`` and
``queries.ORACLES`` hold the registered queries and their SQL.
"""
