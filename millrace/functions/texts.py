"""Templates, digit groups and codes of text values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE = 94  # printable ASCII from "!" on


def template(c: Column) -> Column:
    """The text with each run of digits as one 0."""
    return F.regexp_replace(c, "[0-9]+", "0")


def digit_groups(c: Column) -> Column:
    """The runs of digits."""
    return F.regexp_extract_all(c, F.lit("([0-9]+)"), F.lit(1))


def fill_template(t: Column, groups: Column) -> Column:
    """The text whose template and digit groups these are."""
    return F.array_join(F.transform(F.split(t, "0"), lambda p, i: F.concat(p, F.coalesce(F.get(groups, i), F.lit("")))), "")


def code_width(k: int) -> int:
    """Digits that ``k`` codes need in base 94."""
    width = 1
    while BASE**width < k:
        width += 1
    return width


def encode_index(i: Column, width: int) -> Column:
    """A code as ``width`` printable characters, most significant first."""
    return F.concat(*[F.char((F.floor(i / F.lit(BASE**k)) % BASE + 33).cast("int")) for k in range(width - 1, -1, -1)])


def decode_index(c: Column, width: int) -> Column:
    return sum(((F.ascii(F.substring(c, k + 1, 1)) - 33).cast("long") * F.lit(BASE ** (width - 1 - k)) for k in range(width)), F.lit(0).cast("long"))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading characters two texts share."""
    n = F.least(F.length(a), F.length(b))
    marks = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1)))
    first = F.array_position(marks, F.lit(False))
    return F.when(n == 0, 0).when(first > 0, (first - 1).cast("int")).otherwise(n)


def common_suffix(a: Column, b: Column) -> Column:
    return common_prefix(F.reverse(a), F.reverse(b))


def shift_digits(c: Column, by: Column) -> Column:
    """The last run of digits moved by ``by``, zero-filled to its width."""
    digits = F.regexp_extract(c, "([0-9]+)[^0-9]*$", 1)
    sum_ = (digits.cast("long") + by).cast("string")
    moved = F.lpad(sum_, F.greatest(F.length(digits), F.length(sum_)), "0")
    return F.when(digits == "", c).otherwise(F.concat(F.regexp_extract(c, "^(.*?)[0-9]+[^0-9]*$", 1), moved, F.regexp_extract(c, "([^0-9]*)$", 1)))


def escape_name(c: Column) -> Column:
    """A column name fit for a header: backslash before , = : and backslash, and before a leading ! @ or %."""
    inner = F.regexp_replace(c, r"([\\,=:])", r"\\$1")
    return F.regexp_replace(inner, "^([!@%])", r"\\$1")


def min_length_rule(n: Column, avg_len: Column, cardinality: Column, is_numeric: Column) -> Column:
    """The shortest affix worth a reference, from a column's features."""
    return (
        F.when(n < 100, 3).when(cardinality < 0.2, 3).when(avg_len >= 25, 6).when((avg_len >= 8) & (cardinality >= 0.4), 6)
        .when((avg_len >= 5) & is_numeric & (cardinality >= 0.8), 6).when((avg_len >= 12) & (cardinality >= 0.7), 5)
        .when((avg_len >= 3) & (cardinality >= 0.2), 4).otherwise(3))
