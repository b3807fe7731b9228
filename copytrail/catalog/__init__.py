"""Registered queries over the driver's tables, each with its check in SQL where SQL can state it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from copytrail.adapters import VIEWS, read_table, stream_table, view, view_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """Adapter views of one folder, read lazily: ``inputs.votes`` is the ``votes`` view."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return view(self.spark, self.folder, name)
        raise AttributeError(name)

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    def stream(self, name: str) -> DataFrame:
        """A view or a table as a stream."""
        if name in VIEWS:
            return view(self.spark, self.folder, name, streaming=True)
        return stream_table(self.spark, self.folder, name)


def quote(sql: str) -> str:
    """``at`` is a reserved word in the checking database."""
    return re.sub(r"\bat\b", '"at"', sql)


def with_views(sql: str) -> str:
    """Prefix the views a statement names as common table expressions."""
    names = [name for name in VIEWS if re.search(rf"\b{name}\b", sql)]
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    body = re.sub(r"^WITH(\s+RECURSIVE)?\s", "", body, flags=re.I) if body.upper().startswith("WITH") else None
    heads = [f"{name} AS ({view_sql(name)})" for name in names]
    heads = [quote(head) for head in heads]
    if body is not None:
        body = quote(body)
        return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(heads + [body])
    return ("WITH " + ",\n".join(heads) + "\n" if heads else "") + quote(sql.strip())


def query(name: str, oracle: str | None = None):
    """Register ``fn(inputs)`` under a name, with the equivalent statement when there is one."""

    def register(fn: Callable[[Inputs], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, folder: fn(Inputs(spark, folder))
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn

    return register


def load() -> None:
    import importlib

    for module in ("tracing", "scoring", "voting", "lifecycle", "access", "rules", "regions", "planning", "streams", "files", "reconstruction"):
        try:
            importlib.import_module(f"copytrail.catalog.{module}")
        except ModuleNotFoundError as error:
            if error.name != f"copytrail.catalog.{module}":
                raise
