"""Profiles and quality: features of columns, statistics, keys between tables, dates, alerts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.dates import date_format, date_problem
from millrace.functions.numbers import is_number
from millrace.sources.catalog import Catalog, orphans
from millrace.storage import materialize, ranked


def _stack(df: DataFrame, names: list[str], value: str = "cast(`{}` as string)") -> DataFrame:
    """(column, value): the columns ``names`` one below the other, as text."""
    return df.selectExpr(f"stack({len(names)}, " + ", ".join(f"'{n}', {value.format(n)}" for n in names) + ") AS (column, value)")


def features(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """For each column: n_rows, n_missing (null or empty), n_unique (of text values, null as empty),
    avg_len, cardinality, is_numeric (all non-empty values are numbers and there is one)."""
    names = names or df.columns
    long = _stack(df, names, "coalesce(cast(`{}` as string), '')")
    # First one row for each value, so that nothing is counted distinct in one place.
    per = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    filled = F.col("value") != ""
    out = per.groupBy("column").agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(filled, 0).otherwise(F.col("n"))).cast("long").alias("n_missing"), F.count(F.lit(1)).alias("n_unique"),
        (F.sum(F.length("value") * F.col("n")) / F.sum("n")).alias("avg_len"), F.coalesce(F.bool_and(F.when(filled, is_number(F.col("value")))), F.lit(False)).alias("is_numeric"))
    return out.withColumn("cardinality", F.col("n_unique") / F.col("n_rows"))


def at_ranks(long: DataFrame, ranks: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """(column, name, ...): of the non-null values of each ``column`` of ``long`` (column, value), those at the 0-based
    ``ranks``, which are given by name from the number of values.

    Values are counted first, ordered over all columns in one range partitioning, and picked by
    the counts before them: no task holds the values of a column."""
    per = materialize(long.where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")), "counts")
    totals = per.groupBy("column").agg(F.sum("n").alias("__all"))
    by = Window.orderBy("column").rowsBetween(Window.unboundedPreceding, -1)  # a row for each column
    starts = totals.withColumn("__start", F.coalesce(F.sum("__all").over(by), F.lit(0)))
    placed = ranked(per, [F.col("column"), F.col("value")], "__rank", {"__before": "n"}).join(F.broadcast(starts), "column")
    first = F.col("__before") - F.col("__start")
    picked = []
    for name, rank in ranks(F.col("__all")).items():
        here = (first <= rank) & (rank < first + F.col("n"))
        picked.append(F.max(F.when(here, F.col("value"))).alias(name))
    return placed.groupBy("column").agg(*picked)


def numeric_stats(df: DataFrame, names: list[str]) -> DataFrame:
    """For each numeric column: n, min, max, mean, median, stdev (sample), zeros, negatives."""
    long = _stack(df, names, "cast(`{}` as double)").where("value IS NOT NULL")
    v = F.col("value")
    plain = long.groupBy("column").agg(
        F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("stdev"), F.count_if(v == 0).alias("zeros"), F.count_if(v < 0).alias("negatives"))
    mid = at_ranks(long, lambda n: {"low": F.floor((n - 1) / 2), "high": F.floor(n / 2)}).select("column", ((F.col("low") + F.col("high")) / 2).alias("median"))
    return plain.join(mid, "column").select("column", "n", "min", "max", "mean", "median", "stdev", "zeros", "negatives")


def value_counts(df: DataFrame, names: list[str]) -> DataFrame:
    return _stack(df, names).where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def text_stats(df: DataFrame, names: list[str]) -> DataFrame:
    """For each column: n, distinct and the Shannon entropy of its values in bits."""
    counts = value_counts(df, names)
    # H = log2(N) - sum(n log2 n) / N
    return counts.groupBy("column").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct"),
        (F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy_bits"))


def same_ending(child: str, parent: str) -> bool:
    """Do two column names say the same: equal after the last underscore, or one the other's end?"""
    a, b = child.lower(), parent.lower()
    return a.rsplit("_", 1)[-1] == b.rsplit("_", 1)[-1] or a.endswith(b) or b.endswith(a)


def _family(kind: T.DataType) -> str | None:
    if isinstance(kind, T.IntegralType):
        return "int"
    return "text" if isinstance(kind, T.StringType) else None


def key_candidates(tables: dict[str, DataFrame], min_overlap: float = 0.85, min_unique: float = 0.98, confidence: tuple[str, ...] = ("high",)) -> DataFrame:
    """Columns whose values are those of another table's nearly unique column: child, child_column,
    parent, parent_column, overlap, orphan_values, confidence (high: names agree and overlap is
    0.99 or more; medium: names agree, or such an overlap with 1,000 values; else low).

    Distinct values are written once.  Which pairs of columns can overlap that far is told by
    their numbers of values and their ranges, a row for each column; only values of columns
    that are in such a pair are joined."""
    long = []
    for t, df in tables.items():
        for f in df.schema:
            if (family := _family(f.dataType)):
                long.append(df.select(F.lit(t).alias("t"), F.lit(f.name).alias("c"), F.lit(family).alias("f"), F.col(f"`{f.name}`").cast("string").alias("v")))
    values = materialize(reduce(DataFrame.unionByName, long).where("v IS NOT NULL AND v <> ''").groupBy("t", "c", "f", "v").agg(F.count(F.lit(1)).alias("n")), "values")
    number = F.when(F.col("f") == "int", F.col("v").try_cast("bigint"))
    sizes = materialize(values.groupBy("t", "c", "f").agg(
        F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("rows"), F.min(number).alias("low"), F.max(number).alias("high"), F.min("v").alias("first"), F.max("v").alias("last")), "sizes")
    a, b = sizes.alias("a"), sizes.where((F.col("distinct") / F.col("rows") >= min_unique) & (F.col("distinct") >= 2)).alias("b")
    apart = F.when(F.col("a.f") == "int", (F.col("a.low") > F.col("b.high")) | (F.col("a.high") < F.col("b.low"))).otherwise((F.col("a.first") > F.col("b.last")) | (F.col("a.last") < F.col("b.first")))
    fits = (F.col("a.f") == F.col("b.f")) & (F.col("a.t") != F.col("b.t")) & (F.col("a.distinct") >= 2) & (F.col("a.distinct") * min_overlap <= F.col("b.distinct")) & ~apart
    pairs = a.join(b, fits).select(*[F.col(f"{x}.{c}").alias(f"{n}_{c}") for x, n in (("a", "child"), ("b", "parent")) for c in ("t", "c")], F.col("a.distinct").alias("distinct"))
    pairs = F.broadcast(materialize(pairs, "pairs"))  # a row for each pair of columns of the catalog
    child = values.select(F.col("t").alias("child_t"), F.col("c").alias("child_c"), "v").join(pairs, ["child_t", "child_c"])
    parent = values.select(F.col("t").alias("parent_t"), F.col("c").alias("parent_c"), "v").join(pairs.select("parent_t", "parent_c").distinct(), ["parent_t", "parent_c"])
    shared = child.join(parent, ["parent_t", "parent_c", "v"]).groupBy("child_t", "child_c", "parent_t", "parent_c").agg(F.count(F.lit(1)).alias("common"), F.first("distinct").alias("distinct"))
    found = shared.select(F.col("child_t").alias("child"), F.col("child_c").alias("child_column"), F.col("parent_t").alias("parent"), F.col("parent_c").alias("parent_column"), "common", "distinct")
    found = found.withColumn("overlap", F.col("common") / F.col("distinct")).where(F.col("overlap") >= min_overlap)
    agree = [(a, b) for x, dx in tables.items() for a in dx.columns for y, dy in tables.items() if x != y for b in dy.columns if same_ending(a, b)]
    named = reduce(lambda p, q: p | q, [(F.col("child_column") == a) & (F.col("parent_column") == b) for a, b in sorted(set(agree))], F.lit(False))
    level = F.when(named & (F.col("overlap") >= 0.99), "high").when(named | (F.col("overlap") >= 0.99) & (F.col("distinct") >= 1000), "medium").otherwise("low")
    out = found.withColumn("confidence", level).where(F.col("confidence").isin(*confidence))
    return out.select("child", "child_column", "parent", "parent_column", "overlap", (F.col("distinct") - F.col("common")).alias("orphan_values"), "confidence")


def quality_alerts(df: DataFrame, table: str, keys: tuple[str, ...] = (), sample: int | None = None, order: list[str] | None = None) -> DataFrame:
    """(table, column, alert, severity): duplicate_key (a key of one column that repeats), constant (one
    value in two rows or more), type_drift (half or more, but not all, of at least four non-empty values are
    numbers).  All rows are looked at, or for type_drift the first ``sample`` in ``order``."""
    found = features(df)
    head = df if sample is None else (df.orderBy(*order) if order else df).limit(sample)
    filled = F.col("value") != ""
    drift = _stack(head, df.columns).where(filled).groupBy("column").agg((F.count_if(is_number(F.col("value"))) / F.count(F.lit(1))).alias("share"), F.count(F.lit(1)).alias("seen"))
    both = found.join(drift, "column", "left")
    key = F.col("column").isin(*keys) if keys else F.lit(False)
    alerts = F.array_compact(F.array(
        F.when(key & (F.col("cardinality") < 1), F.struct(F.lit("duplicate_key").alias("alert"), F.lit("high").alias("severity"))),
        F.when((F.col("n_unique") == 1) & (F.col("n_rows") >= 2), F.struct(F.lit("constant").alias("alert"), F.lit("medium").alias("severity"))),
        F.when((F.col("seen") >= 4) & (F.col("share") >= 0.5) & (F.col("share") < 1), F.struct(F.lit("type_drift").alias("alert"), F.lit("high").alias("severity")))))
    return both.select(F.lit(table).alias("table"), "column", F.explode(alerts).alias("a")).select("table", "column", "a.alert", "a.severity")


def feature_samples(df: DataFrame, names: list[str], order: list[str], k: int = 20) -> DataFrame:
    """(column, sample): the texts of each column's first ``k`` rows under ``order``, null as the empty text."""
    rows = df.orderBy(*order).limit(k)
    keyed = rows.select(F.struct(*order).alias("at"), *[F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")).alias(n) for n in names])
    long = keyed.select("at", F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").alias("v")) for n in names])).alias("x"))
    return long.groupBy("x.column").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x.v"))), lambda p: p["v"]).alias("sample"))  # k rows a column


def table_report(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, columns, n_rows, missing, numeric, constant, key_like): for each table, how many of its columns are numeric, have one
    value, or a different one in each row, and how many values are missing in all."""
    out = []
    for t, df in tables.items():
        f = features(df)
        out.append(f.agg(
            F.lit(t).alias("table"), F.count(F.lit(1)).alias("columns"), F.max("n_rows").alias("n_rows"), F.sum("n_missing").alias("missing"), F.count_if("is_numeric").alias("numeric"),
            F.count_if(F.col("n_unique") == 1).alias("constant"), F.count_if(F.col("n_unique") == F.col("n_rows")).alias("key_like")))
    return reduce(DataFrame.unionByName, out)


def date_checks(df: DataFrame, names: list[str]) -> DataFrame:
    """For each text column: n_dates, formats (how many of them), impossible, suspicious, mixed."""
    long = _stack(df, names).where("value IS NOT NULL AND value <> ''")
    kind, problem = date_format(F.col("value")), date_problem(F.col("value"))
    return long.groupBy("column").agg(
        F.count(kind).alias("n_dates"), F.count_distinct(kind).alias("formats"), F.count_if(problem == "impossible").alias("impossible"),
        F.count_if(problem == "suspicious").alias("suspicious")).withColumn("mixed", F.col("formats") > 1)


def is_date_column(df: DataFrame, name: str, order: list[str], look: int = 50, share: float = 0.7, least: int = 3) -> bool:
    """Are ``share`` of the non-empty values among the first ``look`` rows dates, and at least ``least`` of them there?"""
    head = df.orderBy(*order).limit(look).select(F.col(f"`{name}`").cast("string").alias("v")).where("v <> ''")
    row = head.agg(F.count(F.lit(1)).alias("n"), F.count(date_format(F.col("v"))).alias("d")).first()
    return row["n"] >= least and row["d"] >= share * row["n"]


def report(catalog: Catalog, tables: dict[str, DataFrame]) -> DataFrame:
    """All alerts of all tables, the most severe first: table, column, alert, severity."""
    found = [quality_alerts(df, t, (catalog.keys[t],) if t in catalog.keys else ()) for t, df in tables.items()]
    for t, df in tables.items():
        texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
        if texts:
            checks = date_checks(df, texts).where("n_dates > 0")
            for alert, when, severity in (("impossible_date", "impossible > 0", "high"), ("format_mix", "mixed", "medium"), ("suspicious_date", "suspicious > 0", "low")):
                found.append(checks.where(when).select(F.lit(t).alias("table"), "column", F.lit(alert).alias("alert"), F.lit(severity).alias("severity")))
    for k in catalog.foreign:
        if k.table in tables and k.parent in tables:
            lost = orphans(tables[k.table], k.column, tables[k.parent], k.parent_column).limit(1)
            found.append(lost.select(F.lit(k.table).alias("table"), F.lit(k.column).alias("column"), F.lit("orphans").alias("alert"), F.lit("high").alias("severity")))
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return reduce(DataFrame.unionByName, found).orderBy(rank, "table", "column", "alert")


def quality_markdown(tables: dict[str, DataFrame], alerts: DataFrame | None = None, top: int = 5, samples: int = 3) -> str:
    """A report to read: for each table its columns with their features, the ``top`` values of each text column and the
    first ``samples`` rows; then the alerts.  Everything in it is cut to a few rows before it comes to the driver."""
    from millrace.sources.files import markdown

    parts = ["# Data quality\n"]
    for t, df in tables.items():
        parts += [f"## {t}\n", markdown(features(df).orderBy("column")), f"\n### First rows of {t}\n", markdown(df.orderBy(*df.columns[:1]).limit(samples))]
        texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
        if texts:
            rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
            most = value_counts(df, texts).withColumn("place", rank).where(F.col("place") <= top)
            parts += [f"\n### Most frequent values of {t}\n", markdown(most.orderBy("column", "place"), top * len(texts))]
    if alerts is not None:
        parts += ["\n## Alerts\n", markdown(alerts)]
    return "\n".join(parts)


