"""Operators for preparing large language-model training data.

Nothing else in the library imports this subpackage. ``queries()`` and ``oracle_sql()``
in ``pagelens.llm.registry`` list its driver queries.
"""
