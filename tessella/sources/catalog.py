"""Sources and sinks: a catalog of named relations, table definitions, text rows and samples."""

from __future__ import annotations

import datetime
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.plans.tree import AlgebraError

_DDL = {"int": "bigint", "integer": "bigint", "bigint": "bigint", "smallint": "bigint", "text": "string", "varchar": "string", "char": "string", "blob": "string", "float": "double", "double": "double", "real": "double", "decimal": "double", "numeric": "double", "bool": "boolean", "boolean": "boolean", "date": "date", "timestamp": "string", "time": "string"}


class Catalog:
    """Relations by name: Parquet files of a folder, views, or DataFrames that were given. dates: columns that hold dates as midnight
    timestamps."""

    def __init__(self, folder: str | None = None, tables: dict[str, DataFrame] | None = None, dates: frozenset[str] = frozenset()):
        self.folder, self.tables, self.dates = folder.rstrip("/") if folder else None, dict(tables or {}), dates
        self.keys: dict[str, dict[str, Any]] = {}

    def add(self, name: str, df: DataFrame) -> None:
        self.tables[name] = df

    def table(self, spark: SparkSession, name: str) -> tuple[DataFrame, frozenset[str]]:
        if name not in self.tables:
            if self.folder is None:
                if not spark.catalog.tableExists(name):
                    raise AlgebraError(f"unknown relation {name}")
                self.tables[name] = spark.table(name)
            else:
                self.tables[name] = spark.read.parquet(f"{self.folder}/{name}.parquet")
        df = self.tables[name]
        return df, self.dates & {n for n, t in df.dtypes if t.startswith("timestamp")}

    def views(self, spark: SparkSession, names: list[str]) -> None:
        """Registers relations for SQL text; date columns become dates."""
        for n in names:
            df, dates = self.table(spark, n)
            df.withColumns({c: F.col(c).cast("date") for c in dates}).createOrReplaceTempView(n)

    def create(self, spark: SparkSession, ddl: str) -> T.StructType:
        """Declares relations by CREATE TABLE text, with primary and foreign keys as metadata."""
        schema = T.StructType()
        for m in re.finditer(r"create\s+table\s+(\w+)\s*\((.*?)\)\s*(?:;|\Z)", ddl, re.I | re.S):
            name, schema = m[1], T.StructType()
            own: dict[str, Any] = {"primary": [], "foreign": {}}
            for part in re.split(r",(?![^(]*\))", m[2]):
                part = part.strip()
                if k := re.match(r"primary\s+key\s*\(([^)]*)\)", part, re.I):
                    own["primary"] += [c.strip() for c in k[1].split(",")]
                    continue
                if k := re.match(r"foreign\s+key\s*\((\w+)\)\s*references\s+(\w+)\s*(?:\((\w+)\))?", part, re.I):
                    own["foreign"][k[1]] = (k[2], k[3])
                    continue
                column, kind = re.match(r"(\w+)\s+(\w+)", part).groups()
                if kind.lower() not in _DDL:
                    raise AlgebraError(f"unknown type {kind}")
                schema.add(column, T._parse_datatype_string(_DDL[kind.lower()]), not re.search(r"not\s+null|primary\s+key", part, re.I))
                if re.search(r"primary\s+key", part, re.I):
                    own["primary"].append(column)
                if k := re.search(r"references\s+(\w+)\s*(?:\((\w+)\))?", part, re.I):
                    own["foreign"][column] = (k[1], k[2])
            self.keys[name] = own
            self.tables[name] = spark.createDataFrame([], schema)
        return schema

    @classmethod
    def jdbc(cls, spark: SparkSession, url: str, names: list[str], fetch: int = 4096, **options: str) -> "Catalog":
        """Relations of a database, read by a driver on the class path in fetches of so many rows."""
        return cls(tables={n: spark.read.format("jdbc").options(url=url, dbtable=n, fetchsize=str(fetch), **options).load() for n in names})


def text_rows(df: DataFrame, separator: str = "|") -> DataFrame:
    """Rows as text: doubles with six decimals, booleans as t and f, ISO dates."""

    def cell(name: str, kind: T.DataType):
        c = F.col(f"`{name}`")
        if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            return F.format_string("%.6f", c.cast("double"))
        if isinstance(kind, T.BooleanType):
            return F.when(c, "t").when(~c, "f")
        return c.cast("string")

    return df.select(F.concat_ws(separator, *[F.coalesce(cell(f.name, f.dataType), F.lit("null")) for f in df.schema.fields]).alias("line"))


def write_layout(df: DataFrame, path: str, keys: list[str], ordered: bool) -> None:
    """A layout's physical side: rows dealt by key (hash index) or by ranges of it (ordered index), sorted within files, so that
    a lookup prunes by Parquet statistics."""
    dealt = df.repartitionByRange(*keys) if ordered else df.repartition(*keys)
    dealt.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def write_result(df: DataFrame, path: str) -> None:
    """A result as one folder of Parquet files, with its column names and types."""
    df.write.mode("overwrite").parquet(path)


def read_result(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def sample(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n random rows (a sampling operator)."""
    return df.orderBy(F.rand(seed)).limit(n)


def prefix_sample(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


def star_sample(tables: dict[str, DataFrame], fact: str, n: int, seed: int, links: list[tuple[str, str, str, str]], key: list[str] | None = None) -> dict[str, DataFrame]:
    """n rows of the fact table by hash of its key columns (all if none are named), and of the others the rows they refer to. links: (from, column, to,
    column), in order."""
    key = key or tables[fact].columns
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    out = {fact: tables[fact].orderBy(hashed, *key).limit(n)}
    for a, x, b, y in links:
        out[b] = tables[b].join(out[a].select(F.col(x).alias(y)).distinct(), y, "left_semi")
    return out


def parameter(text: str, kind: str) -> Any:
    """A parameter's value from its text form."""
    if kind == "int":
        return int(text)
    if kind == "fixed":
        return float(text)
    if kind == "bool":
        if text.lower() not in ("t", "f", "true", "false"):
            raise AlgebraError(f"not a bool: {text}")
        return text.lower().startswith("t")
    if kind == "date":
        return datetime.date.fromisoformat(text)
    if kind == "string":
        return text
    raise AlgebraError(f"unknown type {kind}")
