"""Shaping a dataset by a declared request: which tables, joined or not, which rows, in which order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.flatten import star_flatten
from millrace.operators.sampling import distances, fit_p_value, group_report, grouped_order, keep_referenced, rarity_band, sample_exact, sample_stratified
from millrace.operators.view import reorder
from millrace.sources.catalog import Catalog

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class ShapeRequest:
    """volume: rows (int) or share (float); level: a name or table names; join: normalized or flat;
    rarity: (low, high) shares of the sorted rarity scores; stratify: a column of the fact; order: as in ``reorder``."""

    level: str | tuple[str, ...] = "full"
    join: str = "normalized"
    rarity: tuple[float, float] | None = None
    stratify: str | None = None
    references: bool = False
    volume: int | float | None = None
    order: str = "natural"
    seed: int = 42

    def problems(self) -> list[str]:
        """Everything that is wrong with the request."""
        out = []
        v = self.volume
        if isinstance(v, bool) or v is not None and not isinstance(v, (int, float)):
            out.append("volume must be a number")
        elif isinstance(v, float) and not 0 <= v <= 1:
            out.append("volume as a share must be in [0, 1]")
        elif isinstance(v, int) and v < 0:
            out.append("volume must not be negative")
        if not isinstance(self.seed, int):
            out.append("seed must be an int")
        if not isinstance(self.level, str) and not (self.level and all(isinstance(t, str) for t in self.level)):
            out.append("level must be a name or table names")
        if self.join not in ("normalized", "flat"):
            out.append("join must be normalized or flat")
        if self.rarity is not None and not 0 <= self.rarity[0] <= self.rarity[1] <= 1:
            out.append("rarity needs 0 <= low <= high <= 1")
        if self.order.partition(":")[0] not in ("natural", "random", "sorted", "reverse"):
            out.append("order must be natural, random, sorted:column or reverse:column")
        return out


@dataclass
class Shaped:
    """What came out: tables, what was done, and the tables that went in."""

    tables: Tables
    trace: list[str] = field(default_factory=list)
    before: Tables = field(default_factory=dict)
    request: ShapeRequest | None = None

    @property
    def names(self) -> list[str]:
        return list(self.tables)

    def counts(self) -> dict[str, int]:
        return {t: df.count() for t, df in self.tables.items()}

    def summary(self) -> DataFrame:
        """(table, before, after, kept): rows of each table that came out, before and after, and the share kept."""
        out = []
        for t, df in self.tables.items():
            was = self.before.get(t, df).agg(F.count(F.lit(1)).alias("before"))
            now = df.agg(F.count(F.lit(1)).alias("after"))
            out.append(was.crossJoin(F.broadcast(now)).select(F.lit(t).alias("table"), "before", "after", F.when(F.col("before") > 0, F.col("after") / F.col("before")).alias("kept")))  # one row each
        return reduce(DataFrame.unionByName, out)

    def metrics(self, table: str, by: str) -> dict[str, object]:
        """How well what is left of a table represents it: distances, p-value and a report of the groups."""
        old, new = self.before[table], self.tables[table]
        return {**distances(old, new, by).first().asDict(), "p_value": fit_p_value(old, new, by), "groups": group_report(old, new, by)}


Step = Callable[[Tables, Catalog, ShapeRequest, list[str]], Tables]
STEPS: dict[str, Step] = {}


def register_step(name: str, step: Step) -> None:
    """Add a step at the end, or put another in the place of one."""
    STEPS[name] = step


def _texts(df: DataFrame) -> list[str]:
    return [c for c, kind in df.dtypes if kind in ("string", "date", "timestamp", "timestamp_ntz")]


def _level(tables: Tables, catalog: Catalog, r: ShapeRequest, trace: list[str]) -> Tables:
    names = catalog.levels.get(r.level, tuple(tables)) if isinstance(r.level, str) else r.level
    trace += [f"no table {n}" for n in names if n not in tables]
    return {n: tables[n] for n in names if n in tables}


def _join(tables: Tables, catalog: Catalog, r: ShapeRequest, trace: list[str]) -> Tables:
    if r.join == "normalized" or catalog.fact(tables) is None:
        return tables
    fact, flat = star_flatten(tables, catalog)
    return {fact: flat}


def _main(tables: Tables, catalog: Catalog) -> str:
    return catalog.fact(tables) or next(iter(tables))


def _rarity(tables: Tables, catalog: Catalog, r: ShapeRequest, trace: list[str]) -> Tables:
    if r.rarity is None:
        return tables
    t = _main(tables, catalog)
    return {**tables, t: rarity_band(tables[t], _texts(tables[t]), *r.rarity)}


def _rows(tables: Tables, catalog: Catalog, r: ShapeRequest, trace: list[str]) -> Tables:
    t = _main(tables, catalog)
    df = tables[t]
    if r.volume is None:
        if not r.stratify or r.stratify not in df.columns:
            trace += [f"{t} has no column {r.stratify}"] * bool(r.stratify)
            return keep_referenced(tables, catalog, t) if r.references else tables
        trace.append(f"grouped {t} by {r.stratify}")  # all rows, in the order of the groups
        out = {**tables, t: grouped_order(df, r.stratify, *[c for c in df.columns if c != r.stratify])}
        return keep_referenced(out, catalog, t) if r.references else out
    if r.stratify and r.stratify in df.columns:
        picked = sample_stratified(df, r.volume, r.stratify, df.columns, r.seed)
        trace.append(f"stratified {t} by {r.stratify}")
    else:
        trace += [f"{t} has no column {r.stratify}"] * bool(r.stratify)
        picked = sample_exact(df, r.volume, df.columns, r.seed)
    out = {**tables, t: picked}
    if r.references:
        return keep_referenced(out, catalog, t)
    return {n: picked if n == t else sample_exact(d, r.volume, d.columns, r.seed) for n, d in out.items()}


def _order(tables: Tables, catalog: Catalog, r: ShapeRequest, trace: list[str]) -> Tables:
    name = r.order.partition(":")[2]
    trace += [f"{t} has no column {name}" for t, df in tables.items() if name and name not in df.columns]
    return {t: reorder(df, r.order, *df.columns, seed=r.seed) for t, df in tables.items()}


for _name, _step in (("level", _level), ("join", _join), ("rarity", _rarity), ("rows", _rows), ("order", _order)):
    register_step(_name, _step)


def shape(tables: Tables, catalog: Catalog, request: ShapeRequest) -> Shaped:
    """The tables after all steps.  An invalid request raises with everything that is wrong with it."""
    if wrong := request.problems():
        raise ValueError("; ".join(wrong))
    trace: list[str] = []
    before = tables
    for name, step in STEPS.items():
        tables = step(tables, catalog, request, trace)
        trace.append(name)
    return Shaped(tables, trace, before, request)


def representativeness(before: DataFrame, after: DataFrame, columns: list[str]) -> dict[str, DataFrame]:
    return {c: distances(before, after, c) for c in columns}
