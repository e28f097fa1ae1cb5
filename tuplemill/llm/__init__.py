"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it.  Their queries are listed in
``tuplemill.llm.queries``.
"""
