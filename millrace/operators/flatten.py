"""A star as one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.catalog import Catalog


def label_column(df: DataFrame, key: str) -> str | None:
    """The first text or date column that isn't the key."""
    return next((f.name for f in df.schema if f.name != key and isinstance(f.dataType, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType))), None)


def star_flatten(tables: dict[str, DataFrame], catalog: Catalog) -> tuple[str, DataFrame]:
    """The fact table without its keys, with <dimension>_<label> of each table that it refers to
    directly; rows whose key finds nothing keep null.  The name is the fact's."""
    fact = catalog.fact(tables)
    if fact is None:
        raise ValueError("no table refers to another")
    out, labels = tables[fact], []
    keys = {k.column for k in catalog.outgoing(fact)} | {catalog.keys.get(fact)}
    for k in catalog.outgoing(fact, set(tables)):
        label = label_column(tables[k.parent], k.parent_column)
        if label:
            name = f"{k.parent}_{label}"
            dim = tables[k.parent].select(F.col(k.parent_column).alias(f"__{k.column}"), F.col(label).alias(name))
            # Spark broadcasts a dimension that is small enough and else sorts both sides.
            out = out.join(dim, F.col(k.column) == F.col(f"__{k.column}"), "left").drop(f"__{k.column}")
            labels.append(name)
    return fact, out.select(*[c for c in tables[fact].columns if c not in keys], *labels)


def lookup_name(fact: DataFrame, key: str, dim: DataFrame, dim_key: str, name: str, out: str) -> DataFrame:
    """``fact`` with the dimension's name for its key, or the key itself where there is none."""
    d = dim.select(F.col(dim_key).alias("__key"), F.col(name).alias("__name"))
    return fact.join(d, F.col(key) == F.col("__key"), "left").withColumn(out, F.coalesce("__name", F.col(key).cast("string"))).drop("__key", "__name")
