"""Tables with keys: the catalog, its levels, loading by name, integrity."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ForeignKey:
    table: str
    column: str
    parent: str
    parent_column: str


@dataclass(frozen=True)
class Catalog:
    name: str
    keys: dict[str, str]  # table -> its primary key, for tables that have one of one column
    foreign: tuple[ForeignKey, ...]
    levels: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def outgoing(self, table: str, among: set[str] | None = None) -> list[ForeignKey]:
        return [k for k in self.foreign if k.table == table and (among is None or k.parent in among)]

    def fact(self, tables: dict[str, DataFrame]) -> str | None:
        """The table with the most keys into the others; of equal ones the one with the most rows."""
        most = max((len(self.outgoing(t, set(tables))) for t in tables), default=0)
        first = [t for t in tables if len(self.outgoing(t, set(tables))) == most]
        if not most:
            return None
        return first[0] if len(first) == 1 else max(first, key=lambda t: tables[t].count())


STAR = Catalog(
    "star",
    {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"},
    (
        ForeignKey("nation", "n_regionkey", "region", "r_regionkey"),
        ForeignKey("customer", "c_nationkey", "nation", "n_nationkey"),
        ForeignKey("supplier", "s_nationkey", "nation", "n_nationkey"),
        ForeignKey("orders", "o_custkey", "customer", "c_custkey"),
        ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey"),
        ForeignKey("lineitem", "l_partkey", "part", "p_partkey"),
        ForeignKey("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ),
    {
        "minimal": ("orders",),
        "core": ("customer", "orders"),
        "chain": ("customer", "orders", "lineitem"),
        "full": ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"),
    },
)


#: How types are written in the statements that make a table.
_SQL_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN"}


@dataclass(frozen=True)
class Dataset:
    """The tables of a folder under a catalog: their names, columns, keys, sizes and rows."""

    spark: SparkSession
    folder: str
    catalog: Catalog

    @property
    def tables(self) -> list[str]:
        known = [*self.catalog.keys, *(k.table for k in self.catalog.foreign), *(t for ts in self.catalog.levels.values() for t in ts)]
        return list(dict.fromkeys(known))

    def frame(self, table: str) -> DataFrame:
        if table not in self.tables:
            raise KeyError(table)
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet")

    def schema(self, table: str) -> dict[str, str]:
        return dict(self.frame(table).dtypes)

    def primary_key(self, table: str) -> list[str]:
        return [self.catalog.keys[table]] if table in self.catalog.keys else []

    def foreign_keys(self, table: str) -> dict[str, str]:
        return {k.column: f"{k.parent}.{k.parent_column}" for k in self.catalog.outgoing(table)}

    def row_count(self, table: str) -> int:
        return self.frame(table).count()

    def rows(self, table: str, limit: int | None = None) -> DataFrame:
        """The rows of a table, or the first ``limit`` by its key (by all columns where it has none)."""
        df = self.frame(table)
        return df if limit is None else df.orderBy(*(self.primary_key(table) or df.columns)).limit(limit)

    def summary(self) -> DataFrame:
        """(table, n_rows, n_columns, key, refers_to): one row for each table."""
        out = None
        for t in self.tables:
            df = self.frame(t)
            one = df.agg(F.lit(t).alias("table"), F.count(F.lit(1)).alias("n_rows")).select(
                "table", "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"), F.lit(",".join(self.primary_key(t))).alias("key"),
                F.lit(",".join(sorted(self.foreign_keys(t).values()))).alias("refers_to"))
            out = one if out is None else out.unionByName(one)
        return out

    def statements(self) -> list[str]:
        """CREATE TABLE for each table, parents first, with primary and foreign keys."""
        waiting, out = list(self.tables), []
        while waiting:
            ready = [t for t in waiting if not any(k.parent in waiting and k.parent != t for k in self.catalog.outgoing(t))] or waiting[:1]
            for t in ready:
                waiting.remove(t)
                parts = [f"{c} {_SQL_TYPES.get(kind, kind.upper())}" for c, kind in self.frame(t).dtypes]
                parts += [f"PRIMARY KEY ({c})" for c in self.primary_key(t)]
                parts += [f"FOREIGN KEY ({k.column}) REFERENCES {k.parent} ({k.parent_column})" for k in self.catalog.outgoing(t)]
                out.append(f"CREATE TABLE {t} ({', '.join(parts)})")
        return out


def from_rows(spark: SparkSession, tables: dict[str, list[dict]], views: bool = True) -> dict[str, DataFrame]:
    """Tables from rows in memory, columns in order of first appearance, a column's kind being the tightest that fits
    all of its values (bigint, double, boolean or string); with ``views`` they can be asked in SQL by name."""
    out = {}
    for name, rows in tables.items():
        columns = list(dict.fromkeys(c for r in rows for c in r))
        kinds = {c: _kind([r.get(c) for r in rows]) for c in columns}
        change = {"bigint": int, "double": float, "boolean": bool, "string": str}
        data = [tuple(None if r.get(c) is None else change[kinds[c]](r[c]) for c in columns) for r in rows]
        out[name] = spark.createDataFrame(data, ", ".join(f"`{c}` {k}" for c, k in kinds.items()) or "none string")
        if views:
            out[name].createOrReplaceTempView(name)
    return out


def _kind(values: list) -> str:
    seen = [v for v in values if v is not None]
    if seen and all(isinstance(v, bool) for v in seen):
        return "boolean"
    if seen and all(isinstance(v, int) and not isinstance(v, bool) for v in seen):
        return "bigint"
    return "double" if seen and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in seen) else "string"


def load(spark: SparkSession, folder: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def load_uri(spark: SparkSession, uri: str, base: str) -> dict[str, DataFrame]:
    """``star:<level>`` or ``table:<name>`` under the folder ``base``."""
    kind, _, name = uri.partition(":")
    if kind == "star":
        return load(spark, base, STAR.levels[name or "full"])
    if kind == "table":
        return load(spark, base, (name,))
    raise ValueError(f"unknown source {uri!r}; known are star: and table:")


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Values of the child's key that the parent doesn't have, with how many rows have them."""
    used = child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))
    return used.join(parent.select(F.col(parent_column).alias("value")), "value", "left_anti")


def violations(catalog: Catalog, tables: dict[str, DataFrame]) -> DataFrame:
    """For each foreign key between ``tables``: how many values and rows have no parent."""
    found = []
    for k in catalog.foreign:
        if k.table in tables and k.parent in tables:
            lost = orphans(tables[k.table], k.column, tables[k.parent], k.parent_column)
            found.append(lost.agg(F.count(F.lit(1)).alias("orphan_values"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("orphan_rows")).select(
                F.lit(k.table).alias("child"), F.lit(k.column).alias("child_column"), F.lit(k.parent).alias("parent"), "orphan_values", "orphan_rows"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def sql(spark: SparkSession, folder: str, text: str, names: tuple[str, ...], args: dict | None = None) -> DataFrame:
    """Any SQL over the tables ``names`` of a folder."""
    for n, df in load(spark, folder, names).items():
        df.createOrReplaceTempView(n)
    return spark.sql(text, args=args) if args else spark.sql(text)
