"""Samples of exact size, by hash so that they are the same in every run, and how well they represent."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.statistics import chi2_p_value, wilson
from millrace.sources.catalog import Catalog
from millrace.storage import materialize, ranked, unused_name

#: A sample of up to so many rows is the top of an order; a larger one is cut by rank.
AT_ONCE = 100_000


def draw(keys: list[str], seed: int = 42) -> Column:
    """What rows are drawn by: md5 of the seed and the key columns."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(f"`{k}`").cast("string") for k in keys]))


def sample_exact(df: DataFrame, size: int | float, keys: list[str], seed: int = 42) -> DataFrame:
    """Exactly ``size`` rows, or that share of them rounded half to even; all if there are fewer.
    ``keys`` must tell rows apart."""
    if isinstance(size, float):
        size = round(size * df.count())
    order = [draw(keys, seed), *[F.col(f"`{k}`") for k in keys]]
    if size <= AT_ONCE:
        return df.orderBy(*order).limit(size)
    # A limit this large would bring all of its rows into one task.
    rank = unused_name(df, "__rank")
    return ranked(df, order, rank).where(F.col(rank) < size).select(*[F.col(f"`{c}`") for c in df.columns])


def allocate(groups: DataFrame, size: int) -> DataFrame:
    """``groups`` (value, n) with quota: rows for each in proportion, rounded half to even, at least 1 each and at most
    what it has; what rounding leaves over goes to, or comes from, the largest groups, one row at a time, at most
    twice round.  Groups can be as many as they like: they are ranked, not gathered."""
    total = groups.agg(F.sum("n")).first()[0] or 0
    share = F.least(F.greatest(F.bround(F.lit(size) * F.col("n") / F.lit(total or 1)).cast("long"), F.lit(1)), F.col("n"))
    now = materialize(groups.withColumn("quota", share), "quota")
    rest = size - (now.agg(F.sum("quota")).first()[0] or 0)
    order = [F.col("n").desc(), F.col("value").cast("string").asc_nulls_last()]
    for _ in range(2):
        able = (F.col("quota") < F.col("n")) if rest > 0 else (F.col("quota") > 1)
        m = now.where(able).count() if rest else 0
        if not m:
            break
        step = 1 if rest > 0 else -1
        moved = ranked(now.where(able), order, "__rank")
        changed = moved.withColumn("quota", F.col("quota") + F.when(F.col("__rank") < abs(rest), step).otherwise(0)).drop("__rank")
        now = materialize(changed.unionByName(now.where(~able)), "quota")
        rest -= step * min(abs(rest), m)
    return now


def sample_stratified(df: DataFrame, size: int | float, by: str, keys: list[str], seed: int = 42) -> DataFrame:
    """A sample of ``size`` rows, or that share of them, in which groups of ``by`` have their share (``allocate``).  ``keys`` must tell rows apart.

    Rows are ranked by group and draw in one range partitioning, so no task holds a group, and cut by
    the group's first rank and quota."""
    counts = materialize(df.groupBy(F.col(f"`{by}`").alias("value")).agg(F.count(F.lit(1)).alias("n")), "groups")
    if isinstance(size, float):
        size = max(1, round(size * (counts.agg(F.sum("n")).first()[0] or 0)))
    quota = allocate(counts, size)
    text = F.col("value").cast("string")
    order = [F.col("value").isNull(), text]
    starts = ranked(quota, order, "__k", {"__start": "n"}).select(F.col("value").alias("__group"), "__start", "quota")
    starts = materialize(starts, "starts")
    few = starts.count() <= AT_ONCE
    group = F.col(f"`{by}`").cast("string")
    rank = unused_name(df, "__rank")
    placed = ranked(df, [F.col(f"`{by}`").isNull(), group, draw(keys, seed), *[F.col(f"`{k}`") for k in keys]], rank)
    both = placed.join(F.broadcast(starts) if few else starts, F.col(f"`{by}`").eqNullSafe(F.col("__group")))
    return both.where(F.col(rank) - F.col("__start") < F.col("quota")).select(*[F.col(f"`{c}`") for c in df.columns])


def grouped_order(df: DataFrame, by: str, *ties: str) -> DataFrame:
    """All rows, groups of ``by`` together in the order of their texts, null last."""
    c = F.col(f"`{by}`")
    return df.orderBy(c.isNull(), c.cast("string"), *ties)


def keep_referenced(tables: dict[str, DataFrame], catalog: Catalog, start: str) -> dict[str, DataFrame]:
    """Only the rows of parents that ``start`` refers to, over any number of steps.  A parent of several
    tables keeps what any of them refers to."""
    out = {start: tables[start]}
    waiting = list(tables)
    while waiting:  # parents after all of their children
        ready = [t for t in waiting if t == start or not any(k.parent == t and k.table in waiting for k in catalog.foreign)]
        if not ready:
            raise ValueError("foreign keys form a cycle")
        for t in ready:
            waiting.remove(t)
            refs = [out[k.table].select(F.col(k.column).alias("__ref")) for k in catalog.foreign if k.parent == t and k.table in out]
            if t != start and refs:
                key = next(k.parent_column for k in catalog.foreign if k.parent == t)
                used = reduce(DataFrame.unionByName, refs).where("__ref IS NOT NULL")
                out[t] = tables[t].join(used, tables[t][key] == used["__ref"], "left_semi")
    return {t: out.get(t, tables[t]) for t in tables}


def sample_with_references(tables: dict[str, DataFrame], catalog: Catalog, size: int | float, keys: list[str], seed: int = 42, stratify: str | None = None) -> dict[str, DataFrame]:
    """A sample of the fact table, by shares of ``stratify`` if given, and the rows of other tables that it needs."""
    fact = catalog.fact(tables)
    picked = sample_stratified(tables[fact], size, stratify, keys, seed) if stratify else sample_exact(tables[fact], size, keys, seed)
    return keep_referenced({**tables, fact: picked}, catalog, fact)


def rarity(df: DataFrame, names: list[str], score: str = "rarity") -> DataFrame:
    """``df`` with the sum over ``names`` of -log2 of the share of rows that have the row's value, rounded to 4."""
    n = df.count()
    out, total = df, F.lit(0.0)
    for k, c in enumerate(names):
        freq = df.groupBy(F.col(f"`{c}`").alias(f"__v{k}")).agg((-F.log2(F.count(F.lit(1)) / F.lit(n))).alias(f"__r{k}"))
        out = out.join(freq, F.col(f"`{c}`").eqNullSafe(F.col(f"__v{k}")), "left")
        total = total + F.col(f"__r{k}")
    return out.withColumn(score, F.round(total, 4)).select(*[F.col(f"`{c}`") for c in df.columns], score)


def rarity_band(df: DataFrame, names: list[str], low: float, high: float) -> DataFrame:
    """Rows whose rarity lies between the scores at ``low`` and ``high`` of the sorted scores, both included."""
    scored = materialize(rarity(df, names), "rarity")
    n = scored.count()
    if not n:
        return scored
    at = [min(round(q * n), n - 1) for q in (low, high)]
    by_rank = ranked(scored.select("rarity"), [F.col("rarity")], "rank").where(F.col("rank").isin(*at)).collect()  # two rows
    found = {r["rank"]: r["rarity"] for r in by_rank}
    upper = found[at[1]] if round(high * n) < n else found[at[1]] + 1
    return scored.where(F.col("rarity").between(found[at[0]], upper))


def shares(df: DataFrame, by: str) -> DataFrame:
    n = df.count()
    return df.groupBy(F.col(f"`{by}`").alias("value")).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / F.lit(n)).alias("share"))


def distances(population: DataFrame, sample: DataFrame, by: str) -> DataFrame:
    """One row: tvd, jsd (base 2), hellinger, chi2 of the sample's counts, groups, low_expected (a cell expects under 5)."""
    p, q = shares(population, by), shares(sample, by)
    both = p.alias("p").join(q.alias("q"), F.col("p.value").eqNullSafe(F.col("q.value")), "full")
    x, y, m = F.coalesce("p.share", F.lit(0.0)), F.coalesce("q.share", F.lit(0.0)), F.coalesce("q.n", F.lit(0))
    mid = (x + y) / 2
    part = lambda a: F.when(a > 0, a * F.log2(a / mid)).otherwise(0.0)
    n = sample.count()
    expected = x * F.lit(n)
    return both.agg(
        F.round(F.sum(F.abs(x - y)) / 2, 4).alias("tvd"), F.round(F.sum(part(x) + part(y)) / 2, 4).alias("jsd"),
        F.round(F.sqrt(F.sum((F.sqrt(x) - F.sqrt(y)) ** 2)) / F.sqrt(F.lit(2.0)), 4).alias("hellinger"),
        F.round(F.sum(F.when(expected > 0, (m - expected) ** 2 / expected)), 4).alias("chi2"),
        F.count_if(x > 0).alias("groups"), F.bool_or(expected < 5).alias("low_expected"))


def group_report(population: DataFrame, sample: DataFrame, by: str, confidence: float = 0.95) -> DataFrame:
    """For each group of the population: its rows and share there and in the sample, the Wilson interval of the
    sample's share, and the difference in points."""
    p, q = shares(population, by), shares(sample, by)
    n = sample.count()
    both = p.alias("p").join(q.alias("q"), F.col("p.value").eqNullSafe(F.col("q.value")), "left")
    m = F.coalesce("q.n", F.lit(0))
    w = wilson(m, F.lit(n), confidence)
    return both.select(
        F.col("p.value").alias("value"), F.col("p.n").alias("pop_n"), F.col("p.share").alias("pop_share"), m.alias("sample_n"), F.coalesce("q.share", F.lit(0.0)).alias("sample_share"),
        F.round(w["low"], 4).alias("low"), F.round(w["high"], 4).alias("high"), F.round(100 * (F.coalesce("q.share", F.lit(0.0)) - F.col("p.share")), 2).alias("diff_pp"))


def fit_p_value(population: DataFrame, sample: DataFrame, by: str) -> float:
    """The p-value of the chi-square test that the sample has the population's shares."""
    row = distances(population, sample, by).first()
    return chi2_p_value(row["chi2"] or 0.0, row["groups"] - 1)


def independence(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: chi2 and freedom of the table of counts of two columns."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    rows, cols = (cells.groupBy(c).agg(F.sum("n").alias(f"n_{c}")) for c in ("a", "b"))
    total = cells.agg(F.sum("n")).first()[0] or 0
    # Cells without rows add their expectation; those with rows are in the join.
    full = cells.join(rows, "a").join(cols, "b")
    e = F.col("n_a") * F.col("n_b") / F.lit(total)
    seen = full.agg(F.sum((F.col("n") - e) ** 2 / e - e).alias("x"))
    n_a, n_b = rows.count(), cols.count()
    return seen.select((F.col("x") + F.lit(float(total))).alias("chi2"), F.lit((n_a - 1) * (n_b - 1)).cast("long").alias("freedom"))


def normalize(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """A column's distinct values numbered from 1 in order, and the table with numbers instead of values."""
    values = ranked(df.select(F.col(f"`{name}`").alias("value")).where("value IS NOT NULL").distinct(), [F.col("value")], "__rank").select((F.col("__rank") + 1).alias("id"), "value")
    slim = df.join(values, F.col(f"`{name}`") == F.col("value"), "left").select(*[F.col(f"`{c}`") for c in df.columns if c != name], F.col("id").alias(f"{name}_id"))
    return values, slim
