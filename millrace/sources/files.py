"""Readers and writers of text formats."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.numbers import coerce


def read_csv(spark: SparkSession, path: str, kinds: dict[str, str], delimiter: str = ",") -> DataFrame:
    """A CSV with header as typed columns; null markers and what can't be read become null.  A
    header other than the names of ``kinds`` raises."""
    raw = spark.read.csv(path, header=True, sep=delimiter, inferSchema=False, escape='"', multiLine=False)
    if raw.columns != list(kinds):
        raise ValueError(f"header {raw.columns} isn't {list(kinds)}")
    return raw.select(*[coerce(F.col(f"`{c}`"), kind).alias(c) for c, kind in kinds.items()])


def infer_kinds(df: DataFrame) -> dict[str, str]:
    """The tightest kind that fits all non-empty texts of each column: int, float, bool or string."""
    checks = {"int": r"^-?[0-9]+$", "float": r"^-?[0-9]+(\.[0-9]+)?$", "bool": "^(?i:true|false)$"}
    row = df.agg(*[
        F.coalesce(F.bool_and(F.when((F.col(f"`{c}`") != ""), F.col(f"`{c}`").rlike(p))), F.lit(False)).alias(f"{i}:{k}")
        for i, c in enumerate(df.columns) for k, p in checks.items()]).first()
    return {c: next((k for k in checks if row[f"{i}:{k}"]), "string") for i, c in enumerate(df.columns)}


def read_csv_texts(spark: SparkSession, path: str, delimiter: str = ",", typed: bool = False) -> DataFrame:
    """A CSV with header as texts, null as empty; ``typed``: as the tightest kinds that fit (``infer_kinds``)."""
    raw = spark.read.csv(path, header=True, sep=delimiter, inferSchema=False, escape='"', multiLine=True)
    texts = raw.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in raw.columns])
    return texts if not typed else texts.select(*[coerce(F.col(f"`{c}`"), kind).alias(c) for c, kind in infer_kinds(texts).items()])


def read_csv_auto(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """A CSV with header: of one column as (value), of several as they are."""
    df = read_csv_texts(spark, path, delimiter)
    return df.toDF("value") if len(df.columns) == 1 else df


def read_toon(spark: SparkSession, path: str) -> DataFrame:
    """The rows that ``write_toon`` wrote, as texts; null stays null.  The header tells names and the number of rows,
    and another number of rows raises."""
    from millrace.functions.binding import let

    head = spark.read.text(f"{path}/header").first()[0]
    m = re.fullmatch(r"(.+)\[(\d+)\]\{(.*)\}:", head)
    if not m:
        raise ValueError(f"no header: {head!r}")
    names, n = m[3].split(","), int(m[2])
    lines = spark.read.text(f"{path}/rows").select(F.substring("value", 3, 1 << 30).alias("line"))
    # A cell is a quoted text, in which a backslash keeps the next character, or runs up to the next comma.
    cells = F.regexp_extract_all("line", F.lit(r'(?:^|,)("(?:[^"\\]|\\.)*"|[^,]*)'), F.lit(1))
    plain = lambda q: F.replace(F.replace(F.replace(F.replace(q, F.lit("\\\\"), F.lit("\u0000")), F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), F.lit("\u0000"), F.lit("\\"))
    cell = lambda x: F.when(x == "null", F.lit(None)).when(x.startswith('"'), plain(x.substr(F.lit(2), F.length(x) - 2))).otherwise(x)
    out = lines.select(cells.alias("c")).select(*[let(F.get("c", F.lit(k)), cell).alias(name) for k, name in enumerate(names)])
    if out.count() != n:
        raise ValueError(f"{path} should have {n} rows")
    return out


def project_positions(df: DataFrame, positions: dict[str, tuple[int, ...]], joint: str = "") -> DataFrame:
    """Columns made of one or several columns of ``df`` by position; rows with a null among them go."""
    names = df.columns
    rows = df.where(" AND ".join(f"`{names[p]}` IS NOT NULL" for ps in positions.values() for p in ps))
    return rows.select(*[F.concat_ws(joint, *[F.col(f"`{names[p]}`") for p in ps]).alias(c) for c, ps in positions.items()])


def write_csv(df: DataFrame, path: str, delimiter: str = ",") -> None:
    """CSV with header, null as empty, quotes only where needed."""
    df.write.option("header", True).option("sep", delimiter).option("nullValue", "").option("emptyValue", "").option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """A JSON object for each row, nulls kept."""
    df.write.option("ignoreNullFields", False).json(path)


def _as_text(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    return F.to_json(c) if isinstance(df.schema[name].dataType, (T.StructType, T.ArrayType, T.MapType)) else c.cast("string")


def markdown(df: DataFrame, max_rows: int = 500) -> str:
    """A Markdown table of the first ``max_rows`` rows, with a note if there are more."""
    cell = [F.regexp_replace(F.replace(F.coalesce(_as_text(df, c), F.lit("")), F.lit("|"), F.lit("\\|")), r"\r?\n", " ").alias(c) for c in df.columns]
    rows = df.select(*cell).limit(max_rows + 1).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "|".join(["---"] * len(df.columns)) + "|"]
    lines += ["| " + " | ".join(r) + " |" for r in rows[:max_rows]]
    return "\n".join(lines + [f"\n*first {max_rows} rows*"] * (len(rows) > max_rows)) + "\n"


def toon_rows(df: DataFrame) -> DataFrame:
    """The rows of a table in indented, comma-separated text (column ``value``): texts with a comma,
    quote, colon or white space at an end, and those that look like numbers, booleans or null, are quoted."""
    def cell(name: str) -> Column:
        c = _as_text(df, name)
        if not isinstance(df.schema[name].dataType, T.StringType):
            return F.coalesce(c, F.lit("null"))
        quoted = F.concat(F.lit('"'), F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
        odd = (c == "") | c.rlike(r'[,":\\\n\r\t\[\]{}]|^\s|\s$|^-') | c.rlike(r"^(true|false|null|[+-]?\d+(\.\d+)?([eE][+-]?\d+)?)$")
        return F.when(c.isNull(), "null").when(odd, quoted).otherwise(c)

    return df.select(F.concat(F.lit("  "), F.concat_ws(",", *[cell(c) for c in df.columns])).alias("value"))


def toon_header(df: DataFrame, name: str) -> str:
    return f"{name}[{df.count()}]{{{','.join(df.columns)}}}:"


def write_toon(df: DataFrame, name: str, path: str) -> None:
    """Header and rows as text files; the header is a file of its own that sorts first."""
    spark = df.sparkSession
    spark.createDataFrame([(toon_header(df, name),)], "value string").coalesce(1).write.text(f"{path}/header")
    toon_rows(df).write.text(f"{path}/rows")


def write_markdown(df: DataFrame, path: str, max_rows: int = 500) -> None:
    """``markdown`` as one text file in a folder."""
    df.sparkSession.createDataFrame([(markdown(df, max_rows).rstrip("\n"),)], "value string").coalesce(1).write.text(path)


def compare_formats(df: DataFrame, path: str, formats: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(format, codec, bytes, n_rows, same): the table written in each format and codec under ``path``, how large it is
    there and whether it comes back the same."""
    spark = df.sparkSession
    formats = formats or {"parquet": ("none", "snappy", "zstd"), "orc": ("none", "zstd"), "json": ("none", "gzip"), "csv": ("none", "gzip")}
    rows = []
    for name, codecs in formats.items():
        for codec in codecs:
            to = f"{path}/{name}-{codec}"
            w = df.write.format(name).option("compression", codec)
            (w.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if name == "csv" else w).save(to)
            r = spark.read.schema(df.schema).format(name)
            back = (r.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if name == "csv" else r).load(to)
            at = spark._jvm.org.apache.hadoop.fs.Path(to)
            size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
            rows.append((name, codec, size, back.count(), df.exceptAll(back).isEmpty() and back.exceptAll(df).isEmpty()))
    return spark.createDataFrame(rows, "format string, codec string, bytes bigint, n_rows bigint, same boolean")


def derive(df: DataFrame, name: str, path: str, formats: tuple[str, ...] = ("csv", "jsonl", "toon", "md")) -> None:
    """The table in each of ``formats`` under ``path``."""
    write = {"csv": write_csv, "jsonl": write_jsonl, "toon": lambda d, p: write_toon(d, name, p), "md": write_markdown}
    for f in formats:
        write[f](df, f"{path}/{name}.{f}")
