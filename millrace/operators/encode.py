"""Column encodings as DataFrames: dictionary, runs, delta runs, templates, and which to choose."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.identifiers import Codec
from millrace.functions.numbers import compact, is_number
from millrace.functions.texts import code_width, common_prefix, common_suffix, digit_groups, encode_index, fill_template, template
from millrace.operators.runs import step_runs, value_runs
from millrace.storage import materialize, ranked, with_previous

#: A dictionary of up to so many values is broadcast; a larger one is joined.
DICTIONARY_MAX = 8192


def _small(codes: DataFrame, k: int) -> DataFrame:
    return F.broadcast(codes) if k <= DICTIONARY_MAX else codes


def dictionary_encode(df: DataFrame, name: str, order: list[str], by_frequency: bool = False) -> tuple[DataFrame, DataFrame] | None:
    """(value, code, symbol) with codes by first appearance, or the most frequent first, and (_pos, code); or None
    where a dictionary can't pay: fewer than two values, or none repeated.  Values are as many as they are."""
    rows = materialize(ranked(df.select(F.col(f"`{name}`").alias("value"), *[F.col(f"`{o}`").alias(f"o{k}") for k, o in enumerate(order)]), [F.col(f"o{k}") for k in range(len(order))], "_pos").select("_pos", "value"), "positions")
    values = materialize(rows.groupBy("value").agg(F.min("_pos").alias("first"), F.count(F.lit(1)).alias("n")), "values")
    k, n = values.count(), rows.count()
    if not 2 <= k < n:
        return None
    first = [F.col("n").desc(), F.col("first")] if by_frequency else [F.col("first")]
    codes = ranked(values, first, "code").select("value", "code", encode_index(F.col("code"), code_width(k)).alias("symbol"))
    coded = rows.join(_small(codes, k), rows["value"].eqNullSafe(codes["value"])).select("_pos", "code")
    return codes, coded


def filter_codes(codes: DataFrame, coded: DataFrame, pred: Callable[[Column], Column]) -> DataFrame:
    """The positions (_pos) whose value fulfils ``pred``: it looks at each value once, then codes are compared."""
    return coded.join(codes.where(pred(F.col("value"))).select("code"), "code", "left_semi").select("_pos")


def dictionary_decode(codes: DataFrame, coded: DataFrame) -> DataFrame:
    return coded.join(codes, "code").select("_pos", "value")


def run_lengths(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """(start, value, length)."""
    return value_runs(df, name, order)


def expand_runs(runs: DataFrame) -> DataFrame:
    """(_pos, value) again."""
    return runs.select(F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("_pos"), "value")


def delta_runs(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """(start, value, delta, length): runs of rows that differ from the row before by the same
    number; the first row is a run of its own with delta null."""
    return step_runs(df, name, order)


def expand_deltas(runs: DataFrame) -> DataFrame:
    """(_pos, value) again."""
    step = F.coalesce("delta", F.lit(0))
    each = runs.select("value", step.alias("step"), F.posexplode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("k", "_pos"))
    return each.select("_pos", (F.col("value") + F.col("k") * F.col("step")).alias("value"))


def text_delta_runs(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """(start, value, deltas, length): runs of texts that differ from the one before in their groups of digits
    only, by the same steps each time.

    Two texts make a step if they have the same template and groups of the same lengths, and their
    groups differ by one number other than 0, or by it and 0.  Texts that make no step are runs
    of one with deltas null.  ``order`` must tell rows apart; groups of over 18 digits make no step."""
    c = F.col(f"`{name}`")
    keep = [F.col(f"`{o}`").alias(f"o{k}") for k, o in enumerate(order)]
    shape = F.regexp_replace(c, "[0-9]", "0")  # template and widths
    rows = df.select(c.alias("value"), shape.alias("shape"), digit_groups(c).alias("groups"), *keep)
    seen = with_previous(rows, [F.col(f"o{k}") for k in range(len(order))], ["shape", "groups"])
    numbers = lambda g: F.transform(g, lambda x: x.try_cast("bigint"))
    steps = F.zip_with(numbers(F.col("groups")), numbers(F.col("prev_groups")), lambda x, y: x - y)
    moved = F.array_distinct(F.filter(steps, lambda x: x != 0))
    fits = F.col("shape").eqNullSafe(F.col("prev_shape")) & (F.size(moved) == 1) & F.forall(steps, lambda x: x.isNotNull())
    deltas = materialize(seen.select("_pos", "value", F.when(fits, steps).alias("deltas")), "deltas")
    # A run is a text and those that go on from it by the same steps.  Where steps change, the text begins a run of
    # its own, whose steps are those of the next text: so of changes in a row every second one begins a run.
    linked = with_previous(deltas, [F.col("_pos")], ["deltas"], position="at", prefix="before_")
    changes = F.col("deltas").isNotNull() & F.col("before_deltas").isNotNull() & ~F.col("deltas").eqNullSafe(F.col("before_deltas"))
    streaks = value_runs(linked.select("_pos", changes.alias("changes")), "changes", ["_pos"]).where("value")
    every_second = streaks.select(F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1, F.lit(2).cast("long"))).alias("_pos"))
    heads = deltas.where("deltas IS NULL").select("_pos").unionByName(every_second)
    after = with_previous(heads, [F.col("_pos").desc()], ["_pos"], position="rank", prefix="next")
    n = deltas.count()
    sized = after.select(F.col("_pos").alias("start"), (F.coalesce("next_pos", F.lit(n)) - F.col("_pos")).alias("length"))
    own, ahead = deltas.select(F.col("_pos").alias("start"), "value"), deltas.select((F.col("_pos") - 1).alias("start"), "deltas")
    return sized.join(own, "start").join(ahead, "start", "left").select("start", "value", F.when(F.col("length") > 1, F.col("deltas")).alias("deltas"), "length")


def expand_text_deltas(runs: DataFrame) -> DataFrame:
    """(_pos, value) again: the k-th text of a run has its groups moved by k times the deltas, filled to their widths."""
    each = runs.select("value", "deltas", F.posexplode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("k", "_pos"))
    moved = F.zip_with(digit_groups(F.col("value")), F.col("deltas"), lambda g, d: F.lpad((g.try_cast("bigint") + d * F.col("k")).cast("string"), F.length(g), "0"))
    return each.select("_pos", F.when((F.col("k") == 0) | F.col("deltas").isNull(), F.col("value")).otherwise(fill_template(template(F.col("value")), moved)).alias("value"))


def split_template(df: DataFrame, name: str) -> DataFrame:
    """(template, n_rows, n_groups, n_varying): one row for each template of digits in the column.  The
    column can be split if there is one template, two groups or more, and one of them varies."""
    c = F.col(f"`{name}`")
    parts = df.select(template(c).alias("template"), digit_groups(c).alias("groups"))
    long = parts.select("template", F.posexplode_outer("groups").alias("k", "group"))
    varying = long.groupBy("template", "k").agg(F.min("group").alias("low"), F.max("group").alias("high")).groupBy("template").agg(
        F.count_if(F.col("low") != F.col("high")).alias("n_varying"))
    sizes = parts.groupBy("template").agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size("groups")).cast("long").alias("n_groups"))
    return sizes.join(varying, sizes["template"].eqNullSafe(varying["template"])).select(sizes["*"], "n_varying")


def split_columns(df: DataFrame, name: str, groups: int) -> DataFrame:
    """The column as its template and a text column g0, g1, ... for each group of digits."""
    c = F.col(f"`{name}`")
    return df.withColumn("template", template(c)).withColumns({f"g{k}": F.get(digit_groups(c), F.lit(k)) for k in range(groups)})


def merge_columns(df: DataFrame, groups: int, name: str) -> DataFrame:
    return df.withColumn(name, fill_template(F.col("template"), F.array(*[F.col(f"g{k}") for k in range(groups)]))).drop("template", *[f"g{k}" for k in range(groups)])


def _long(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, value): texts, null as the empty one."""
    stacked = ", ".join(f"'{n}', coalesce(cast(`{n}` as string), '')" for n in names)
    return df.selectExpr(f"stack({len(names)}, {stacked}) AS (column, value)")


def _width(k: Column) -> Column:
    """Characters of a code among ``k``."""
    return F.when(k <= 94, 1).when(k <= 94**2, 2).when(k <= 94**3, 3).otherwise(4)


def candidate_sizes(df: DataFrame, names: list[str], codecs: dict[str, Codec] | None = None) -> DataFrame:
    """(column, candidate, bytes) of each way to write a column that can be used on it: raw (texts and line ends),
    dictionary (values, and a code for each row), split (one template, and each group of digits raw or by
    dictionary) and, for columns in ``codecs``, codec (payloads instead of texts, where any text is compressible).

    Texts are first reduced to one row per value; nothing is sorted."""
    per = materialize(_long(df, names).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")), "values")

    def sizes(values: DataFrame, by: str) -> DataFrame:
        size = F.octet_length("value") + 1
        out = values.groupBy(by).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("k"), F.sum(size * F.col("n")).alias("raw"), F.sum(size).alias("table"))
        pays = (F.col("k") >= 2) & (F.col("k") < F.col("rows"))
        return out.withColumn("dictionary", F.when(pays, F.col("table") + _width(F.col("k")) * F.col("rows")))

    plain = sizes(per, "column")
    out = [plain.select("column", F.lit("raw").alias("candidate"), F.col("raw").alias("bytes")), plain.where("dictionary IS NOT NULL").select("column", F.lit("dictionary").alias("candidate"), F.col("dictionary").alias("bytes"))]
    # Split needs one template in the column, two groups or more, and one that varies.
    shapes = per.groupBy("column").agg(F.min(template(F.col("value"))).alias("low"), F.max(template(F.col("value"))).alias("high"), F.min(F.size(digit_groups(F.col("value")))).alias("groups"), F.sum("n").alias("all"))
    able = shapes.where((F.col("low") == F.col("high")) & (F.col("groups") >= 2) & (F.col("all") >= 2)).select("column", "low", "groups")
    pieces = per.join(able, "column").select(F.col("column").alias("c"), "low", F.posexplode(digit_groups(F.col("value"))).alias("g", "value"), "n")
    parts = pieces.groupBy("c", "g", "low", "value").agg(F.sum("n").alias("n")).withColumn("slot", F.struct("c", "g", "low"))
    group = sizes(parts, "slot").select("slot.c", "slot.low", (F.col("k") > 1).alias("varies"), F.least("raw", F.coalesce("dictionary", "raw")).alias("bytes"))
    split = group.groupBy("c", "low").agg(F.sum("bytes").alias("bytes"), F.bool_or("varies").alias("varies")).where("varies")
    out.append(split.select(F.col("c").alias("column"), F.lit("split").alias("candidate"), (F.col("bytes") + F.octet_length("low") + 1).cast("long").alias("bytes")))
    for c, codec in (codecs or {}).items():
        own = per.where(F.col("column") == c).select("column", "n", codec.encode(F.col("value")).alias("payload"), (codec.classify(F.col("value")) == "compressible").alias("good"))
        sized = own.groupBy("column").agg(F.sum((F.octet_length("payload") + 1) * F.col("n")).alias("bytes"), F.bool_or("good").alias("good")).where("good")
        out.append(sized.select("column", F.lit("codec").alias("candidate"), "bytes"))
    return reduce(DataFrame.unionByName, out)


#: In which order candidates are looked at: a later one is taken only if it is smaller.
CANDIDATES = ("raw", "dictionary", "split", "codec")


def encoding_choice(df: DataFrame, names: list[str], codecs: dict[str, Codec] | None = None, without: tuple[str, ...] = ()) -> DataFrame:
    """(column, choice, bytes, raw_bytes): the smallest of ``candidate_sizes`` for each column, the first of equal
    ones; ``without`` leaves candidates out, to see what each is worth."""
    rank = reduce(lambda w, x: w.when(F.col("candidate") == x[1], x[0]), enumerate(CANDIDATES), F.when(F.lit(False), -1))
    sizes = candidate_sizes(df, names, codecs).where(~F.col("candidate").isin(*without) if without else F.lit(True))
    best = F.min(F.struct("bytes", rank.alias("rank"), "candidate")).alias("best")
    return sizes.groupBy("column").agg(best, F.max(F.when(F.col("candidate") == "raw", F.col("bytes"))).alias("raw_bytes")).select("column", F.col("best.candidate").alias("choice"), "best.bytes", "raw_bytes")


def size_report(df: DataFrame, names: list[str], codecs: dict[str, Codec] | None = None) -> DataFrame:
    """One row: columns, header_bytes (names and line ends), body_bytes, total_bytes, raw_bytes, how many columns are
    written in each way, and how many codecs were offered but lost."""
    chosen = encoding_choice(df, names, codecs)
    modes = [F.count_if(F.col("choice") == c).alias(f"n_{c}") for c in CANDIDATES]
    row = chosen.agg(F.count(F.lit(1)).alias("columns"), F.sum(F.octet_length("column") + 1).cast("long").alias("header_bytes"), F.sum("bytes").alias("body_bytes"), F.sum("raw_bytes").alias("raw_bytes"), *modes)
    return row.withColumns({"total_bytes": F.col("header_bytes") + F.col("body_bytes"), "codecs_lost": F.lit(len(codecs or {})) - F.col("n_codec")})


def encoding_advice(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, n_rows, n_unique, raw_bytes, dictionary_bytes, advice): text as it is, or a dictionary
    where its values and codes take fewer bytes."""
    per = _long(df, names).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    size = F.octet_length("value") + 1
    out = per.groupBy("column").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_unique"), F.sum(size * F.col("n")).alias("raw_bytes"), F.sum(size).alias("table_bytes"))
    offered = (F.col("n_unique") >= 2) & (F.col("n_unique") < F.col("n_rows"))
    packed = F.when(offered, F.col("table_bytes") + _width(F.col("n_unique")) * F.col("n_rows"))
    return out.select("column", "n_rows", "n_unique", "raw_bytes", packed.alias("dictionary_bytes")).withColumn(
        "advice", F.when(F.col("dictionary_bytes") < F.col("raw_bytes"), "dictionary").otherwise("raw"))


def cadence(df: DataFrame, names: list[str], order: list[str], look: int = 5, near: float = 0.7, spread: float = 0.5) -> DataFrame:
    """(column, cadence, rule) for each column: 1 if its first ``look`` distinct texts are of one length and
    neighbours share ``near`` of it in prefix and suffix, 2 if it is numeric and over ``spread`` of its rows are
    distinct, else null.  Columns of fewer than two texts have no cadence."""
    texts = materialize(df.select(*[F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")).alias(f"c{k}") for k, n in enumerate(names)], *[F.col(f"`{o}`").alias(f"o{k}") for k, o in enumerate(order)]), "texts")
    keys = F.struct(*[F.col(f"o{k}") for k in range(len(order))])
    long = reduce(DataFrame.unionByName, [texts.select(F.lit(n).alias("column"), F.col(f"c{k}").alias("value"), keys.alias("at")) for k, n in enumerate(names)])
    per = materialize(long.groupBy("column", "value").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n")), "values")
    filled = F.when(F.col("value") != "", is_number(F.col("value")))
    whole = per.groupBy("column").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("rows"), F.coalesce(F.bool_and(filled), F.lit(False)).alias("numeric"))
    # A bound on the rank lets Spark keep that many rows of a column before the shuffle.
    rank = F.row_number().over(Window.partitionBy("column").orderBy("at"))
    heads = per.withColumn("rank", rank).where(F.col("rank") <= look)
    pairs = heads.withColumn("before", F.lag("value").over(Window.partitionBy("column").orderBy("rank")))
    share = (common_prefix(F.col("before"), F.col("value")) + common_suffix(F.col("before"), F.col("value"))) / F.length("value")
    first = pairs.groupBy("column").agg(
        ((F.min(F.length("value")) == F.max(F.length("value"))) & (F.min(F.length("value")) > 0)).alias("even"), F.bool_and(F.when(F.col("before").isNotNull() & (F.length("value") > 0), share >= near)).alias("alike"))
    rule = F.when(F.col("k") < 2, F.lit(None).cast("int")).when(F.col("even") & F.coalesce("alike", F.lit(False)), 1).when(F.col("numeric") & (F.col("k") / F.col("rows") > spread), 2)
    return whole.join(first, "column").select("column", rule.isNotNull().alias("cadence"), rule.alias("rule"))


def leveled(df: DataFrame, level: int, order: list[str], precision: int | None = None) -> tuple[str | None, dict[str, DataFrame]]:
    """A table column by column, as (start, value, length): level 0 and 1 keep the order of rows (level 0 without
    runs, each row alone), level 2 first sorts by the column with the fewest values, level 3 also
    writes texts as numbers of a dictionary, the most frequent first.  Returns the column sorted by.

    Whole numbers lose their fraction, others are rounded to ``precision`` where one is given."""
    def shown(name: str) -> Column:
        c = F.col(f"`{name}`")
        number = F.round(c.cast("double"), precision) if precision is not None else c.cast("double")
        return F.coalesce(compact(number) if name in numbers else c.cast("string"), F.lit(""))

    numbers = {n for n, kind in df.dtypes if kind in ("int", "bigint", "double", "float", "smallint", "tinyint")}
    by = None
    if level >= 2:
        counts = _long(df, df.columns).groupBy("column", "value").count().groupBy("column").count().collect()  # a row for each column
        known = {r["column"]: r["count"] for r in counts}
        by = min(df.columns, key=lambda c: known.get(c, 0)) if known else None
    keys = [by, *order] if by else order
    out = {}
    for name in df.columns:
        rows = df.select(shown(name).alias("__shown"), *[F.col(f"`{k}`") for k in dict.fromkeys(keys)])
        if level >= 3 and name not in numbers:
            made = dictionary_encode(rows, "__shown", keys, by_frequency=True)
            if made:
                rows = made[1].select(F.col("code").cast("string").alias("__shown"), "_pos")
                out[name] = value_runs(rows, "__shown", ["_pos"])
                continue
        if level == 0:
            out[name] = ranked(rows, [F.col(f"`{k}`") for k in keys], "start").select("start", F.col("__shown").alias("value"), F.lit(1).cast("long").alias("length"))
        else:
            out[name] = value_runs(rows, "__shown", keys)
    return by, out


def stats_lines(df: DataFrame, names: list[str], full_rows: int | None = None, confidence: float = 0.95, always: bool = False) -> DataFrame:
    """(column, line): a line with n, sum, min, max and avg for each numeric column; where the rows are a sample of
    ``full_rows``, fewer than that, also the error of the mean in per cent.  ``always`` gives the error however many rows there are."""
    from millrace.functions.statistics import normal_quantile

    z = normal_quantile(0.5 + confidence / 2)
    long = df.selectExpr(f"stack({len(names)}, " + ", ".join(f"'{n}', cast(`{n}` as double)" for n in names) + ") AS (column, value)").where("value IS NOT NULL")
    per = long.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("avg"), F.stddev_samp("value").alias("sd"))
    shown = lambda c: compact(F.round(F.col(c), 4))
    line = F.concat(F.lit("# STATS "), F.col("column"), F.lit(": n="), F.col("n").cast("string"), *[x for c in ("sum", "min", "max", "avg") for x in (F.lit(f" {c}="), shown(c))])
    if full_rows is not None:
        error = F.abs(F.lit(z) * F.col("sd") / F.sqrt("n") / F.col("avg")) * 100
        line = F.when((F.lit(always) | (F.lit(full_rows) > F.col("n"))) & (F.col("n") >= 2) & (F.col("avg") != 0), F.concat(line, F.lit(" err="), F.format_string("%.1f", error), F.lit(f"% full_n={full_rows}"))).otherwise(line)
    return per.select("column", line.alias("line"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Do two tables hold the same rows, each as often?"""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
