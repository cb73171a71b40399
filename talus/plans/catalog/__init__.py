"""Every registered query with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from talus.plans.bindings import Domain, with_views


@dataclass
class Catalog:
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def query(self, name: str, sql: str | None = None, **views: str):
        """Register fn(domain) under `name`; `sql` may name any view of the bindings."""

        def register(fn: Callable[[Domain], DataFrame]):
            if name in self.queries:
                raise ValueError(f"duplicate query {name}")
            self.queries[name] = lambda spark, folder: fn(Domain(spark, folder))
            if sql is not None:
                self.sql[name] = with_views(sql, **views)
            return fn

        return register


CATALOG = Catalog()


def load() -> Catalog:
    from talus.plans.catalog import (  # noqa: F401 - importing registers the queries
        aggregates, expressions, features, ingestion, lists, rasters, risk, sources, spatial, streams,
    )

    return CATALOG
