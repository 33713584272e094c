"""Numbers in text columns, and rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as a number: an optional sign, digits with an optional point and exponent, or inf and nan.
NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"


def is_number(c: Column) -> Column:
    return c.rlike(NUMBER)


def strict_double(c: Column, what: str = "value") -> Column:
    """The number in a text; the empty text is null, anything else raises."""
    bad = F.raise_error(F.concat(F.lit(f"{what} is not a number: "), c)).cast("double")
    return F.when(c.isNull() | (c == ""), F.lit(None).cast("double")).when(is_number(c), F.trim(c).cast("double")).otherwise(bad)


def numeric(df: DataFrame, name: str) -> Column:
    """Column ``name`` as double: text by ``strict_double``, numbers as they are."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return strict_double(F.col(f"`{name}`"), name)
    return F.col(f"`{name}`").cast("double")


def stringify(c: Column) -> Column:
    """Every value as text, null as the empty text."""
    return F.coalesce(c.cast("string"), F.lit(""))


#: Text that stands for a missing value in files.
NULL_MARKERS = ("", "?", "NA", "NaN", "null", "None")


def coerce(c: Column, kind: str) -> Column:
    """A text from a file as int, float, bool, date, datetime or string; markers and what can't be read are null."""
    v = F.when(c.isin(*NULL_MARKERS), F.lit(None)).otherwise(c)
    if kind == "int":
        return F.coalesce(v.try_cast("bigint"), v.try_cast("double").cast("bigint"))
    if kind == "float":
        return v.try_cast("double")
    if kind == "bool":
        return F.when(F.lower(v).isin("true", "1", "yes"), True).when(F.lower(v).isin("false", "0", "no"), False)
    if kind == "date":
        return v.try_cast("date")
    if kind == "datetime":
        return v.try_cast("timestamp_ntz")
    return v


def compact(c: Column) -> Column:
    """A number as text without a fraction where it is whole."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))
