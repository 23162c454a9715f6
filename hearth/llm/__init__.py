"""Operators for large training corpora; nothing else in the library imports this subpackage.

One module per operator, each a ``DataFrame -> DataFrame`` function with its own parameters;
:mod:`hearth.llm.queries` holds the registered queries and their SQL.
"""
