"""Mixing sources to target weights by pivotal dependent rounding.

A source whose documents shall be taken r times gives each of them floor(r) copies and
one more with probability r - floor(r).  Those fractions are rounded dependently: two
documents of a source trade mass (in words, so that the sum of words stays) until the
probability of one of them is 0 or 1, and the one left over meets the next.  Documents
meet in small leaves first, what is left over of each leaf meets in the next level, and
so on up a tree; only the last one of a source is rounded alone, to the nearer number.  So
a source misses its target by half a document at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD, materialize, ranked, unused

#: Documents (or leftovers) that meet in one leaf of the reduction tree, on average.
FAN_IN = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), ceiling: float = 3.0) -> DataFrame:
    """Targets of the sources of ``sizes`` (source, size): source, source_size, n, target.

    Sources by code point, null last, have ``weights`` in turn and share all words; none
    gets over ``ceiling`` times what it has, and what is over is shared by weight among
    the others.  That is a water level: sources are taken by ceiling over weight, and
    those below the level of what then remains are full."""
    by = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "sources")
    total = float(by.agg(F.sum("source_size")).first()[0] or 0)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = (
        ranked(by, [F.col("source").asc_nulls_last()], "rank")
        .withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.lit(ceiling) * F.col("source_size")))
    weighed = ranked(weighed, [(F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()], "order", {"caps": "cap", "used": "weight"})
    weighed = materialize(weighed, "weighed")
    all_weight = float(weighed.agg(F.sum("weight")).first()[0] or 0)
    level = (F.lit(total) - F.col("caps")) / (F.lit(all_weight) - F.col("used"))
    # The first source that the level of what remains does not fill sets the level of all after it.
    open_at = weighed.where(F.col("cap") / F.col("weight") >= level).agg(F.min(F.struct("order", level.alias("level"))).alias("x")).select("x.level").first()[0]
    share = F.least(F.col("cap"), F.lit(float(open_at or 0)) * F.col("weight"))
    return weighed.select("source", "source_size", "n", share.alias("target"))


def _uniform(*key: Column) -> Column:
    """A number in (0, 1) that depends on ``key`` alone."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def _leaf(units: Column, seed: Column, last: Column) -> Column:
    """Pivotal rounding along the array ``units`` of (key, mass, p, ...).

    Result: open (the unit that is still fractional, or null) and done, an array of
    (unit, up) of those that are 0 or 1 now.  With ``last`` the open one is rounded too."""

    def meet(acc: Column, x: Column) -> Column:
        a, p, q, m, w = acc["open"], acc["open"]["p"], x["p"], acc["open"]["mass"], x["mass"]
        gain = F.least((1 - p) * m, q * w)  # mass that can move from x to the open unit
        loss = F.least(p * m, (1 - q) * w)  # and the other way
        up = _uniform(seed, a["key"], x["key"]) * (gain + loss) < loss  # the mean of p stays
        # The one that gets to a bound is set to it, so that no rounding error stays.
        p2 = F.when(up, F.when((1 - p) * m <= q * w, F.lit(1.0)).otherwise(p + gain / m)).otherwise(F.when(p * m <= (1 - q) * w, F.lit(0.0)).otherwise(p - loss / m))
        q2 = F.when(up, F.when(q * w <= (1 - p) * m, F.lit(0.0)).otherwise(q - gain / w)).otherwise(F.when((1 - q) * w <= p * m, F.lit(1.0)).otherwise(q + loss / w))
        sealed = lambda v: (v <= 0) | (v >= 1)
        a2, x2 = a.withField("p", p2), x.withField("p", q2)
        fixed = F.array_compact(F.array(F.when(sealed(p2), a2), F.when(sealed(q2), x2)))
        both = F.struct(F.when(~sealed(p2), a2).when(~sealed(q2), x2).alias("open"), F.concat(acc["done"], fixed).alias("done"))
        alone = F.struct(x.alias("open"), acc["done"].alias("done"))
        return F.when(a.isNull(), alone).otherwise(both)

    def close(acc: Column) -> Column:
        a = acc["open"]
        end = a.withField("p", (a["p"] >= 0.5).cast("double"))
        shut = F.struct(F.when(F.lit(False), a).alias("open"), F.concat(acc["done"], F.array(end)).alias("done"))
        return F.when(last & a.isNotNull(), shut).otherwise(acc)

    none = F.filter(units, lambda x: F.lit(False))
    start = F.struct(F.get(none, F.lit(0)).alias("open"), none.alias("done"))
    return F.aggregate(units, start, meet, close)


def round_copies(units: DataFrame, largest: int, seed: int = 42) -> DataFrame:
    """Round the fraction p of each row of ``units`` (source, key, mass, p) to 0 or 1: (key, p).

    ``largest`` is the number of rows of the largest source; it sets the height of the tree."""
    done = None
    level = 0
    rows = units
    while True:
        last = largest <= FAN_IN
        n = 1 if last else -(-largest // FAN_IN)
        # After the first level a source has one row per leaf, so leaf numbers deal them evenly.
        leaf = F.pmod(F.xxhash64("key", F.lit(seed + level)), F.lit(n)).cast("long")
        grouped = (
            rows.groupBy("source", leaf.alias("leaf")).agg(F.array_sort(F.collect_list(F.struct("key", "mass", "p"))).alias("units"))
            .withColumn("r", _leaf(F.col("units"), F.concat_ws("/", F.lit(seed), F.lit(level), F.col("leaf")), F.lit(last)))
            .select("source", "leaf", F.col("r.open").alias("open"), F.col("r.done").alias("done")))
        grouped = materialize(grouped, f"level{level}")
        fixed = grouped.select("source", F.explode("done").alias("u")).select("source", "u.key", "u.p")
        done = fixed if done is None else done.unionByName(fixed)
        if last:
            return done
        rows = grouped.where("open is not null").select("source", "open.key", "open.mass", "open.p")
        largest, level = n, level + 1


def take_copies(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), ceiling: float = 3.0, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """How often rows of ``sizes`` (doc_id, source, size) are taken, as (doc_id, source, size, rows, whole,
    more), and the targets of the sources.

    Rows that agree in all three columns (repeated rows) are one unit: ``more`` of its ``rows`` are
    taken ``whole`` + 1 times, the others ``whole`` times.  Only what is left of the unit's
    share after whole rows is rounded, so a source of repeated rows too misses its target by
    half a document at most.  Rows without words get none."""
    targets = materialize(source_targets(sizes, weights, ceiling), "targets")
    units = sizes.where("size > 0").groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
    joined = units.join(targets, units["source"].eqNullSafe(targets["source"])).select(units["*"], "source_size", "target")
    rate = F.col("target") / F.col("source_size")
    key = F.struct("doc_id", "size")
    shares = joined.select("source", key.alias("key"), "rows", F.floor(rate).cast("long").alias("whole"), (F.col("rows") * (rate - F.floor(rate))).alias("share"))
    split = materialize(shares.select(
        "source", "key", "rows", "whole", F.col("key.size").cast("double").alias("mass"),
        F.floor("share").cast("long").alias("sure"), (F.col("share") - F.floor("share")).alias("p")), "units")
    largest = int(targets.agg(F.max("n")).first()[0] or 0)
    extra = round_copies(split.where("p > 0").select("source", "key", "mass", "p"), largest, seed)
    copies = split.join(extra.withColumnRenamed("p", "up"), (split["key"] == extra["key"]) & split["source"].eqNullSafe(extra["source"]), "left").select(
        split["source"], split["key"], "rows", "whole", (F.col("sure") + F.coalesce("up", F.lit(0.0)).cast("long")).alias("more"))
    return copies.select(F.col("key.doc_id").alias("doc_id"), "source", F.col("key.size").alias("size"), "rows", "whole", "more"), targets


def _with_copies(rows: DataFrame, units: DataFrame, names: tuple[str, str, str], copies: str) -> DataFrame:
    """``rows``, whose id, source and size are the columns ``names``, with the number of their ``copies``.

    Repeated rows are numbered inside their part of the table first, and parts by how many they
    have, so no task sees all rows of a unit.  ``rows`` are shuffled once at any size, however few the
    ``units``, so that disk grows as the input does."""
    u = materialize(units, "copies").select(*[F.col(c).alias(f"__{c}") for c in ("doc_id", "source", "size", "rows", "whole", "more")])
    i, s, n = (rows[c] for c in names)
    both = rows.join(u.hint("merge"), i.eqNullSafe(F.col("__doc_id")) & s.eqNullSafe(F.col("__source")) & (n == F.col("__size")), "left")
    keep = [rows[c] for c in rows.columns]
    if u.where("__rows > 1").isEmpty():
        return both.select(*keep, F.coalesce(F.col("__whole") + F.col("__more"), F.lit(0)).cast("long").alias(copies))
    once = both.where("__rows IS NULL OR __rows = 1").select(*keep, F.coalesce(F.col("__whole") + F.col("__more"), F.lit(0)).cast("long").alias(copies))
    unit = ["__doc_id", "__source", "__size"]
    many = materialize(both.where("__rows > 1").withColumns({"__part": F.spark_partition_id(), "__tag": F.monotonically_increasing_id()}), "repeats")
    before = Window.partitionBy(*unit).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = many.groupBy(*unit, "__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    parts = parts.select(*[F.col(c).alias(f"{c}_") for c in (*unit, "__part")], "__before")
    own = many.withColumn("__local", F.row_number().over(Window.partitionBy(*unit, "__part").orderBy("__tag")))
    match = [own[c].eqNullSafe(parts[f"{c}_"]) for c in (*unit, "__part")]
    placed = own.join(parts, match[0] & match[1] & match[2] & match[3])
    chosen = (F.col("__before") + F.col("__local") <= F.col("__more")).cast("long")
    return once.unionByName(placed.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("__whole") + chosen).alias(copies)))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return materialize(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size")), "sizes")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), ceiling: float = 3.0, seed: int = 42,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken.

    A document is taken whole, 0 to ``ceiling`` times; taken is copies times size.  Null
    and empty texts have size 0 and are never taken; null sources are one source, last in
    order; a source without words has target 0.  Runs with the same rows and seed agree."""
    sizes = _sized(docs, id_col, text_col, source_col)
    units, targets = take_copies(sizes, weights, ceiling, seed)
    with_copies = _with_copies(sizes, units, ("doc_id", "source", "size"), "copies")
    out = with_copies.join(targets, with_copies["source"].eqNullSafe(targets["source"]))
    return out.select("doc_id", with_copies["source"], "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), ceiling: float = 3.0, seed: int = 42,
              id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it, with the columns of ``docs``."""
    size, copies = unused(docs, "__words"), unused(docs, "__copies")
    units, _ = take_copies(_sized(docs, id_col, text_col, source_col), weights, ceiling, seed)
    rows = docs.withColumn(size, word_count(F.col(f"`{text_col}`")))
    both = _with_copies(rows, units.where("whole + more > 0"), (id_col, source_col, size), copies).where(F.col(copies) > 0)
    return both.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias(copies)).drop(copies)
