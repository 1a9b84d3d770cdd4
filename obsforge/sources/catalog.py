"""Tenant, dataset and table names resolved to DataFrames, and how the tables of a source unite."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidInput
from ..operators import lifecycle

_SLUG = re.compile(r"[a-z0-9][a-z0-9_-]*")


class Catalog:
    """A missing table is an empty result (``None``); an unknown tenant is an error."""

    def __init__(self) -> None:
        self._tables: dict[tuple[str, str, str], Callable[[], DataFrame | None]] = {}

    def add(self, tenant: str, dataset: str, table: str, make: Callable[[], DataFrame | None]) -> None:
        for slug in (tenant, dataset, table):
            if not _SLUG.fullmatch(slug):
                raise InvalidInput(f"not a valid name: {slug!r}")
        self._tables[tenant, dataset, table] = make

    def add_stored(self, spark: SparkSession, tenant: str, dataset: str, table: str, path: str) -> None:
        """A table in storage, as its latest commit has it when it is asked for; scans are pruned by the hour."""
        self.add(tenant, dataset, table, lambda: lifecycle.table(spark, path))

    def tables(self, tenant: str, dataset: str) -> list[str]:
        return sorted(t for a, b, t in self._tables if (a, b) == (tenant, dataset))

    def find(self, tenant: str, dataset: str, table: str) -> DataFrame | None:
        if tenant not in {t for t, _, _ in self._tables}:
            raise InvalidInput(f"unknown tenant {tenant!r}")
        make = self._tables.get((tenant, dataset, table))
        return make() if make else None

    def union(self, tenant: str, dataset: str, tables: tuple[str, ...]) -> DataFrame | None:
        """Tables one below the other by column name; where one has JSON text and another a map, both become maps."""
        found = [df for t in tables if (df := self.find(tenant, dataset, t)) is not None]
        if not found:
            return None
        if any("hour_bucket" not in df.columns for df in found):
            found = [df.drop("hour_bucket") for df in found]
        maps = {f.name for df in found for f in df.schema if f.dataType.typeName() == "map"}
        coerced = [df.withColumns({c: F.from_json(c, "map<string,string>") for c, kind in df.dtypes if c in maps and kind == "string"}) for df in found]
        out = coerced[0]
        for df in coerced[1:]:
            out = out.unionByName(df, allowMissingColumns=True)
        return out
