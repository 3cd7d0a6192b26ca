"""Sources by name, and the union of what they bring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scratch import written

Extractor = Callable[[DataFrame], DataFrame]


class SourceRegistry:
    def __init__(self) -> None:
        self._sources: dict[str, Extractor] = {}

    def register(self, name: str, extractor: Extractor) -> None:
        key = name.strip().lower()
        if not key:
            raise ValueError("a source needs a name")
        if key in self._sources:
            raise ValueError(f"source {key} is registered already")
        self._sources[key] = extractor

    def get(self, name: str) -> Extractor:
        return self._sources[name.strip().lower()]

    def names(self) -> list[str]:
        return sorted(self._sources)

    def collect(self, documents: DataFrame) -> DataFrame:
        """documents(source_name, …) through the extractor of each source, as one table."""
        out = None
        for name in self.names():
            rows = self._sources[name](documents.where(F.lower(F.trim("source_name")) == name)).withColumn("source_name", F.lit(name))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        if out is None:
            raise ValueError("no source is registered")
        return out

    def collect_each(self, documents: DataFrame) -> tuple[DataFrame | None, dict[str, str]]:
        """The same, source by source: each is written by itself, so that one that fails is named with its error and the
        others' rows are there."""
        out, failed = None, {}
        for name in self.names():
            try:
                rows = self._sources[name](documents.where(F.lower(F.trim("source_name")) == name)).withColumn("source_name", F.lit(name))
                rows = written(rows, f"source-{name}")
            except Exception as error:  # noqa: BLE001, an extractor may fail in any way
                failed[name] = f"{type(error).__name__}: {error}"[:500]
                continue
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out, failed
