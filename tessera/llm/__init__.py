"""Training-data pipeline operators.

Nothing else in the library imports this subpackage; the queries and their SQL
are in :mod:`tessera.llm.registry`.
"""
