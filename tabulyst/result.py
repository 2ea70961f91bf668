"""Operator results: a named set of small tidy DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame


class Tables(dict):
    """``dict`` of name -> DataFrame with attribute access (``res.statistics``)."""

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self[name]
        except KeyError as exc:
            raise AttributeError(name) from exc

    def __repr__(self) -> str:
        return f"Tables({', '.join(self.keys())})"
