"""The engine: algebra or SQL text in, DataFrames out."""

from __future__ import annotations

import time
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tessella.plans.engine import Builder
from tessella.plans.parser import parse
from tessella.plans.rules import optimise
from tessella.plans.tree import AlgebraError, Filter, HashIndex, Name, OrderedIndex, Query, Relation, children
from tessella.sources.catalog import Catalog


@dataclass
class Prepared:
    """A query with parameters: build() materialises what does not depend on them, run() answers."""

    engine: "Engine"
    query: Query
    tables: dict[str, DataFrame]

    def build(self) -> "Prepared":
        """Keeps the base relations of index lookups in memory, dealt by the key that a lookup will ask for."""
        for name, keys, ordered in self._indexes(self.query.body):
            df, _ = self.engine.catalog.table(self.engine.spark, name)
            df = df.repartitionByRange(*keys) if ordered else df.repartition(*keys)
            self.tables[name] = df.sortWithinPartitions(*keys).cache()
        return self

    def release(self) -> None:
        """Frees what build() keeps."""
        for name in list(self.tables):
            self.tables.pop(name).unpersist()

    def _indexes(self, node: Any):
        if isinstance(node, (HashIndex, OrderedIndex)) and isinstance(node.values, Filter) and isinstance(node.values.source, Relation):
            names = {n.column for n in self._names(node.values.test) if n.scope is None}
            df, _ = self.engine.catalog.table(self.engine.spark, node.values.source.name)
            keys = [c for c in df.columns if c in names]
            if keys:
                yield node.values.source.name, keys, isinstance(node, OrderedIndex)
        for c in children(node):
            yield from self._indexes(c)

    def _names(self, e: Any):
        if isinstance(e, Name):
            yield e
        for c in children(e):
            yield from self._names(c)

    def run(self, **params: Any) -> DataFrame:
        missing = {a for a, _ in self.query.args} - set(params)
        if missing:
            raise AlgebraError(f"no value for {sorted(missing)}")
        catalog = Catalog(self.engine.catalog.folder, self.engine.catalog.tables | self.tables, self.engine.catalog.dates)
        b = Builder(self.engine.spark, catalog, params)
        return b.finish(b.build(optimise(self.query.body)))


class Engine:
    """Queries over a catalog."""

    def __init__(self, spark: SparkSession, folder: str | None = None, tables: dict[str, DataFrame] | None = None, dates: frozenset[str] = frozenset()):
        self.spark, self.catalog = spark, Catalog(folder, tables, dates)

    def algebra(self, text: str, **params: Any) -> DataFrame:
        node = parse(text)
        return self.tree(node.body if isinstance(node, Query) else node, **params)

    def tree(self, node: Any, **params: Any) -> DataFrame:
        b = Builder(self.spark, self.catalog, params)
        return b.finish(b.build(optimise(node)))

    def prepare(self, text: str) -> Prepared:
        node = parse(text)
        return Prepared(self, node if isinstance(node, Query) else Query("query", (), node), {})

    def sql(self, text: str, tables: list[str] | None = None, **args: Any) -> DataFrame:
        """Spark SQL over the catalog's relations, with named parameters."""
        self.catalog.views(self.spark, tables or list(self.catalog.tables))
        return self.spark.sql(text, args=args or None)

    def explain(self, df: DataFrame) -> dict[str, int | None]:
        """The optimiser's estimate: rows (if known) and bytes."""
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        rows = stats.rowCount()
        return {"rows": int(str(rows.get())) if rows.isDefined() else None, "bytes": int(str(stats.sizeInBytes()))}

    def timed(self, df: DataFrame, seconds: float = 1.0) -> dict[str, float]:
        """Runs a query again and again for so long: mean milliseconds and queries a second."""
        n, began = 0, time.perf_counter()
        while (took := time.perf_counter() - began) < seconds or not n:
            df.write.format("noop").mode("overwrite").save()
            n += 1
        took = time.perf_counter() - began
        return {"ms": 1000 * took / n, "qps": n / took}

    def within(self, df: DataFrame, seconds: float) -> list:
        """The rows of a query that ends in time; its jobs are cancelled otherwise and TimeoutError is raised."""
        import threading
        import uuid

        sc, group, late = self.spark.sparkContext, f"within-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            late.set()
            sc.cancelJobGroup(group)

        timer = threading.Timer(seconds, stop)
        sc.setJobGroup(group, "a query with a time limit", interruptOnCancel=True)
        timer.start()
        try:
            return df.collect()
        except Exception as e:
            if late.is_set():
                raise TimeoutError(f"the query took more than {seconds} s") from e
            raise
        finally:
            timer.cancel()
            for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
                sc.setLocalProperty(key, None)
