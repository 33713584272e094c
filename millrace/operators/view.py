"""A queryable view of one table: projection, chained filters, aggregates, groups, reports."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.numbers import numeric, stringify
from millrace.operators.runs import value_runs
from millrace.storage import materialize, ranked, unused_name


class TableView:
    """A lazy view.  Scalars run a query; everything else is a DataFrame or another view.

    Text columns are read as numbers for aggregates: the empty text is skipped, anything
    else that isn't a number raises.  sum of nothing is 0; min, max and avg of nothing raise."""

    def __init__(self, df: DataFrame, order: list[str] | None = None):
        self.df, self.order = df, order

    def _known(self, name: str) -> str:
        if name not in self.df.columns:
            raise KeyError(name)
        return name

    def where(self, name: str, value: object = None, pred: Callable[[Column], Column] | None = None, test: Callable[[str], bool] | None = None) -> TableView:
        """Rows where ``name`` is ``value`` (null matches nothing), ``pred`` of the column holds, or ``test``, a
        Python function, holds of its text (null as the empty text).  ``pred`` stays in the JVM and can be pushed
        to the scan; ``test`` sees Arrow batches in Python workers."""
        c = F.col(f"`{self._known(name)}`")
        if test:
            holds = F.pandas_udf(lambda s: s.map(test).astype(bool), "boolean")
            return TableView(self.df.where(holds(stringify(c))), self.order)
        return TableView(self.df.where(pred(c) if pred else c == F.lit(value)), self.order)

    def select(self, names: list[str] | None = None) -> DataFrame:
        """The columns ``names``, or all."""
        return self.df.select(*[f"`{self._known(n)}`" for n in names or self.df.columns])

    def count(self) -> int:
        return self.df.count()

    def aggregate(self, name: str, *ops: str) -> DataFrame:
        """One row with a column for each of count, sum, min, max, avg."""
        self._known(name)
        return self.df.agg(*[_op(op, numeric(self.df, name)).alias(op) for op in ops])

    def _scalar(self, op: str, name: str) -> float:
        value = self.aggregate(name, op).first()[0]
        if value is None:
            raise ValueError(f"{op} of no values")
        return value

    def sum(self, name: str) -> float:
        return self._scalar("sum", name)

    def min(self, name: str) -> float:
        return self._scalar("min", name)

    def max(self, name: str) -> float:
        return self._scalar("max", name)

    def avg(self, name: str) -> float:
        return self._scalar("avg", name)

    def group_count(self, name: str) -> DataFrame:
        """(value, n); null and the empty text are one group."""
        return self.df.groupBy(stringify(F.col(f"`{self._known(name)}`")).alias("value")).agg(F.count(F.lit(1)).alias("n"))

    def group_ranges(self, name: str, strict: bool = True) -> DataFrame:
        """(value, start, end) of each run of equal values in the view's order, end excluded.
        With ``strict`` a value with two runs raises."""
        if not self.order:
            raise ValueError("group_ranges needs an order")
        runs = materialize(value_runs(self.df, self._known(name), self.order), "ranges")
        if strict:
            again = runs.groupBy("value").count().where("count > 1").select("value").first()
            if again:
                raise ValueError(f"{name} isn't contiguous: {again[0]!r} comes back")
        return runs.select("value", "start", (F.col("start") + F.col("length")).alias("end"))

    def agg_by(self, key: str, name: str, op: str, contiguous: bool = False) -> DataFrame:
        """(key, op) for each value of ``key``.  With ``contiguous`` a value whose rows aren't together in the
        view's order raises, as in ``group_ranges``."""
        self._known(key)
        if op not in ("count", "sum", "min", "max", "avg"):
            raise KeyError(op)
        if contiguous:
            self.group_ranges(key)
        return self.df.groupBy(f"`{key}`").agg(_op(op, numeric(self.df, self._known(name))).alias(op))

    def without_names(self) -> DataFrame:
        """The columns named by their place: 0, 1, ..."""
        return self.df.toDF(*map(str, range(len(self.df.columns))))

    def at(self, positions: DataFrame, position: str = "_pos") -> DataFrame:
        """The rows at the 0-based ``positions`` of the view's order."""
        if not self.order:
            raise ValueError("positions need an order")
        mine = unused_name(self.df, "__pos")
        rows = ranked(self.df, [F.col(f"`{o}`") for o in self.order], mine)
        return rows.join(positions.select(F.col(position).alias("__at")).distinct(), F.col(mine) == F.col("__at"), "left_semi").drop(mine)

    def column_bytes(self, name: str) -> int:
        """Compressed bytes of a column in the Parquet files behind the view, from their footers."""
        return stored_bytes(self.df).get(self._known(name), 0)

    def report(self) -> dict[str, list[str]]:
        """What the plan reads: the columns of its scans and the filters that reach them."""
        plan = self.df._jdf.queryExecution().executedPlan().toString()
        return {
            "columns": sorted({c.split(":")[0] for s in re.findall(r"ReadSchema: struct<([^>]*)>", plan) for c in s.split(",") if c}),
            "pushed": sorted({f for s in re.findall(r"PushedFilters: \[([^\]]*)\]", plan) for f in re.split(r", (?=[A-Z])", s) if f}),
        }


def stored_bytes(df: DataFrame) -> dict[str, int]:
    """For each column, the compressed bytes in the Parquet files that ``df`` reads; fields of a column add up.
    Only footers are read, one after the other: meant for a look at a table, not for a million files."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out: dict[str, int] = {}
    for name in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, conf))
        try:
            for block in reader.getFooter().getBlocks():
                for column in block.getColumns():
                    top = column.getPath().toArray()[0]
                    out[top] = out.get(top, 0) + column.getTotalSize()
        finally:
            reader.close()
    return out


def side_by_side(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str]) -> DataFrame:
    """Row i of ``a`` beside row i of ``b``, each under its order; where one is longer, the other's columns are null."""
    left, right = (ranked(df, [F.col(f"`{o}`") for o in o_], "_pos") for df, o_ in ((a, order_a), (b, order_b)))
    return left.join(right, "_pos", "full")


def _op(op: str, c: Column) -> Column:
    return {"count": F.count(F.lit(1)), "sum": F.coalesce(F.sum(c), F.lit(0.0)), "min": F.min(c), "max": F.max(c), "avg": F.avg(c)}[op]


def sort_as_text(df: DataFrame, name: str, *ties: str) -> DataFrame:
    """Ordered by the text of a column, ties by further columns."""
    return df.orderBy(F.col(f"`{name}`").cast("string"), *ties)


def reorder(df: DataFrame, how: str, *ties: str, seed: int = 42) -> DataFrame:
    """natural, random (by hash), sorted:column (nulls last) or reverse:column (nulls first).
    An unknown column leaves the order as it is."""
    kind, _, name = how.partition(":")
    if kind == "natural" or kind in ("sorted", "reverse") and name not in df.columns:
        return df
    if kind == "random":
        return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), *ties)), *ties)
    if kind not in ("sorted", "reverse"):
        raise ValueError(how)
    c = F.col(f"`{name}`")
    return df.orderBy(c.asc_nulls_last() if kind == "sorted" else c.desc_nulls_first(), *ties)


def top_values(df: DataFrame, name: str, k: int) -> DataFrame:
    """The ``k`` most frequent values with their counts, ties by value."""
    return df.groupBy(F.col(f"`{name}`").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)
