"""Operators for preparing language-model training text.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame
and returns a DataFrame; the queries of the driver are in
:mod:`kerbside.llm.queries`.
"""
