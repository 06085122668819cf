"""The registry of named queries: a Spark callable and, where SQL can say it, an independent SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Collects the queries of one family. Columns need a running session, which registration does not: `prepare` makes
    those that a family's queries share, each time before one of them runs."""

    def __init__(self, prepare: Callable[[], None] | None = None) -> None:
        self.prepare = prepare
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, query: Query, oracle: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"query {name} is registered twice")
        self.queries[name] = self._prepared(query)
        if oracle is not None:
            self.oracles[name] = oracle

    def _prepared(self, query: Query) -> Query:
        if self.prepare is None:
            return query

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            self.prepare()
            return query(spark, sf_dir)

        return run

    def query(self, name: str, oracle: str | None = None) -> Callable[[Query], Query]:
        def keep(fn: Query) -> Query:
            self.add(name, fn, oracle)
            return fn

        return keep

    def update(self, other: "Registry") -> None:
        for name, fn in other.queries.items():
            self.add(name, fn, other.oracles.get(name))
