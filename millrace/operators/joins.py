"""Joins by place in time and by range, and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str], hot: int | None = None, span: str = "1 day") -> DataFrame:
    """``left`` with the ``values`` of the last row of ``right`` with the same ``by`` whose ``at`` isn't later; of
    rows at one time that with the largest values.

    Both sides are put one below the other and looked at once in order, so no row meets more than its
    predecessor.  Keys with over ``hot`` rows are cut into stretches of time of length ``span``, each of
    which is told the last row of the stretches before it."""
    key = [F.col(f"`{c}`") for c in by]
    mine = left.select(*[F.col(f"`{c}`") for c in left.columns], F.lit(1).alias("__side"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("__value"))
    rows = right.select(*[F.col(f"`{c}`") if c in (*by, at) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.lit(0).alias("__side"), F.struct(*values).alias("__value"))
    both = mine.unionByName(rows)
    order = [F.col(f"`{at}`"), "__side", "__value"]
    if hot is None:
        last = F.last("__value", True).over(Window.partitionBy(*key).orderBy(*order))
        out = both.withColumn("__last", last)
    else:
        busy = both.groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(key)]).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot)
        match = [key[i].eqNullSafe(F.col(f"__k{i}")) for i in range(len(by))]
        marked = both.join(busy, match, "left")
        # Keys with few rows are one stretch.
        stretch = F.when(F.col("__n").isNotNull(), F.window(F.col(f"`{at}`").cast("timestamp"), span)["start"])
        cut = marked.withColumn("__stretch", stretch).drop(*[f"__k{i}" for i in range(len(by))], "__n")
        ends = cut.where("__side = 0 AND __stretch IS NOT NULL").groupBy(*key, "__stretch").agg(F.max_by("__value", F.struct(F.col(f"`{at}`"), "__value")).alias("__end"))
        stretches = cut.where("__stretch IS NOT NULL").select(*key, "__stretch").distinct().join(ends, [*by, "__stretch"], "left")
        before = F.last("__end", True).over(Window.partitionBy(*key).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1))
        carried = stretches.select(*[k.alias(f"__k{i}") for i, k in enumerate(key)], F.col("__stretch").alias("__s"), before.alias("__carry"))
        match = [key[i].eqNullSafe(F.col(f"__k{i}")) for i in range(len(by))]
        cut = cut.join(carried, [*match, F.col("__stretch") == F.col("__s")], "left")
        inside = F.last("__value", True).over(Window.partitionBy(*key, "__stretch").orderBy(*order))
        out = cut.withColumn("__last", F.coalesce(inside, F.col("__carry")))
    return out.where("__side = 1").select(*[F.col(f"`{c}`") for c in left.columns], *[F.col(f"__last.`{v}`").alias(v) for v in values])


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs of a row of ``points`` and one of ``ranges`` with ``low`` <= ``at`` < ``high``.

    The line is cut into cells ``width`` long; a range is in each cell it touches, a point in one, so they meet by
    equality.  Choose ``width`` near the usual length of a range: then a range is in two or three cells."""
    cell = lambda c: F.floor(F.col(f"`{c}`").cast("double") / F.lit(float(width)))
    last = F.ceil(F.col(f"`{high}`").cast("double") / F.lit(float(width))) - 1
    cells = ranges.where(F.col(f"`{low}`") < F.col(f"`{high}`")).withColumn("__cell", F.explode(F.sequence(cell(low), F.greatest(last, cell(low)))))
    inside = (F.col(f"`{at}`") >= F.col(f"`{low}`")) & (F.col(f"`{at}`") < F.col(f"`{high}`"))
    return points.withColumn("__cell", cell(at)).join(cells, "__cell").where(inside).drop("__cell")


def combine(a: DataFrame, b: DataFrame, how: str, repeats: bool = False) -> DataFrame:
    """union, intersect or except of two tables with the same columns; with ``repeats`` rows count as often as they come."""
    made = {
        ("union", False): lambda: a.unionByName(b).distinct(), ("union", True): lambda: a.unionByName(b),
        ("intersect", False): lambda: a.intersect(b), ("intersect", True): lambda: a.intersectAll(b),
        ("except", False): lambda: a.subtract(b), ("except", True): lambda: a.exceptAll(b)}
    if (how, repeats) not in made:
        raise ValueError(how)
    return made[how, repeats]()
