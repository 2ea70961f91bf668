"""Operators for building training corpora.

Nothing outside this package imports it; its queries and their SQL are in
:mod:`tabulyst.llm.queries`.
"""
