"""Typed codecs of identifiers: classify, encode, decode, each a column expression."""

from __future__ import annotations

import string
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.binding import let

#: Payload symbols: digits, letters, minus and plus.  Nine digits fit in five of them, twelve in seven.
SYMBOLS = string.digits + string.ascii_uppercase + string.ascii_lowercase + "-+"
BASE = len(SYMBOLS)

CPF_WEIGHTS = (tuple(range(10, 1, -1)), tuple(range(11, 1, -1)))
CNPJ_WEIGHTS = ((5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2), (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2))


@dataclass(frozen=True)
class Codec:
    """Classes of a text, its payload, and the text back from the payload."""

    name: str
    classify: Callable[[Column], Column]
    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column]


def _digit(c: Column, k: int) -> Column:
    return F.substring(c, k + 1, 1).cast("int")


def _weighted(c: Column, weights: tuple[int, ...]) -> Column:
    return sum((_digit(c, k) * w for k, w in enumerate(weights)), F.lit(0))


def _both_digits(body: Column, first: Callable[[Column], Column], second: Callable[[Column, Column], Column]) -> Column:
    return let(body, lambda b: let(first(b), lambda d1: F.concat(d1.cast("string"), second(b, d1).cast("string"))))


def cpf_digits(body: Column) -> Column:
    """The two check digits of nine digits."""
    first = lambda b: _weighted(b, CPF_WEIGHTS[0]) * 10 % 11 % 10
    second = lambda b, d1: (_weighted(b, CPF_WEIGHTS[1][:9]) + d1 * CPF_WEIGHTS[1][9]) * 10 % 11 % 10
    return _both_digits(body, first, second)


def cnpj_digits(body: Column) -> Column:
    """The two check digits of twelve digits."""
    check = lambda r: let(r % 11, lambda x: F.when(x < 2, 0).otherwise(11 - x))
    first = lambda b: check(_weighted(b, CNPJ_WEIGHTS[0]))
    second = lambda b, d1: check(_weighted(b, CNPJ_WEIGHTS[1][:12]) + d1 * CNPJ_WEIGHTS[1][12])
    return _both_digits(body, first, second)


def to_payload(number: Column, width: int) -> Column:
    symbol = lambda n, k: F.substring(F.lit(SYMBOLS), (F.floor(n / F.lit(BASE**k)) % BASE + 1).cast("int"), F.lit(1))
    return let(number, lambda n: F.concat(*[symbol(n, k) for k in range(width - 1, -1, -1)]))


def from_payload(c: Column, width: int) -> Column:
    place = lambda p, k: (F.instr(F.lit(SYMBOLS), F.substring(p, k + 1, 1)) - 1).cast("long")
    return let(c, lambda p: sum((place(p, k) * F.lit(BASE ** (width - 1 - k)) for k in range(width)), F.lit(0).cast("long")))


def _codec(name: str, classify: Callable[[Column], Column], packed: Callable[[Column], Column], restored: Callable[[Column], Column]) -> Codec:
    """Texts that ``classify`` calls compressible are ``packed``; others are kept behind a mark."""
    kept = lambda v: F.concat(F.lit("_"), F.coalesce(v, F.lit("")))
    return Codec(
        name, classify,
        lambda c: let(c, lambda v: F.when(classify(v) == "compressible", packed(v)).otherwise(kept(v))),
        lambda c: let(c, lambda p: F.when(p.startswith("_"), F.substring(p, 2, 1 << 30)).otherwise(restored(p))))


def _checked(name: str, masked: str, size: int, width: int, digits: Callable[[Column], Column], mask: Callable[[Column], Column]) -> Codec:
    bare = lambda c: F.regexp_replace(c, "[^0-9]", "")

    def classify(c: Column) -> Column:
        checked = lambda only: F.when(F.length(only) != size, "length_wrong").when(digits(only) != F.substring(only, size - 1, 2), "check_invalid").otherwise("compressible")
        return let(c, lambda v: (
            F.when(v.isNull() | (v == ""), "empty_value").when(v.rlike(f"^[0-9]{{{size}}}$"), "format_unmasked")
            .when(~v.rlike(masked), F.when(F.length(v) > 5, "format_mismatch").otherwise("length_wrong"))
            .otherwise(let(bare(v), checked))))

    packed = lambda v: to_payload(F.substring(bare(v), 1, size - 2).cast("long"), width)
    restored = lambda p: let(let(F.lpad(from_payload(p, width).cast("string"), size - 2, "0"), lambda body: F.concat(body, digits(body))), mask)
    return _codec(name, classify, packed, restored)


def _parts(c: Column, *pieces: tuple[int, int] | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.substring(c, p[0], p[1]) for p in pieces])


CPF = _checked("cpf", r"^[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}$", 11, 5, cpf_digits, lambda c: _parts(c, (1, 3), ".", (4, 3), ".", (7, 3), "-", (10, 2)))
CNPJ = _checked("cnpj", r"^[0-9]{2}\.[0-9]{3}\.[0-9]{3}/[0-9]{4}-[0-9]{2}$", 14, 7, cnpj_digits, lambda c: _parts(c, (1, 2), ".", (3, 3), ".", (6, 3), "/", (9, 4), "-", (13, 2)))

_IP = r"^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$"


def _classify_ip(c: Column) -> Column:
    """Four numbers of up to three digits, none with a zero in front; numbers over 255 are let through."""
    padded = c.rlike(r"(^|\.)0[0-9]")
    return F.when(c.isNull() | (c == ""), "empty_value").when(~c.rlike(_IP), "format_mismatch").when(padded, "format_padded_zeros").otherwise("compressible")


def pad_ip(c: Column) -> Column:
    """Twelve digits, three for each slot."""
    return F.concat(*[F.lpad(F.regexp_extract(c, _IP, k), 3, "0") for k in range(1, 5)])


def unpad_ip(c: Column) -> Column:
    return F.concat_ws(".", *[F.substring(c, 3 * k + 1, 3).cast("int").cast("string") for k in range(4)])


IPV4 = _codec("ipv4", lambda c: let(c, lambda v: _classify_ip(v)), lambda v: to_payload(pad_ip(v).cast("long"), 7), lambda p: let(F.lpad(from_payload(p, 7).cast("string"), 12, "0"), unpad_ip))

CODECS = {c.name: c for c in (CPF, CNPJ, IPV4)}


def pattern_codec(name: str, pattern: str, groups: tuple[int, ...], joint: Callable[[list[Column]], Column], width: int) -> Codec:
    """A codec of one's own: ``pattern`` has a group of digits, of the lengths ``groups``, for each
    part; ``joint`` puts parts together again.  What doesn't survive the round trip is kept as it is."""
    total = sum(groups)

    def digits(c: Column) -> Column:
        return F.concat(*[F.regexp_extract(c, pattern, k + 1) for k in range(len(groups))])

    def back(p: Column) -> Column:
        starts = [1 + sum(groups[:k]) for k in range(len(groups))]
        number = F.lpad(from_payload(p, width).cast("string"), total, "0")
        return let(number, lambda d: joint([F.substring(d, at, g) for at, g in zip(starts, groups)]))

    def classify(c: Column) -> Column:
        code = lambda v: to_payload(F.when(v.rlike(pattern), digits(v)).otherwise("0").cast("long"), width)
        return let(c, lambda v: F.when(v.isNull() | (v == ""), "empty_value").when(~v.rlike(pattern), "format_mismatch").when(back(code(v)) != v, "round_trip").otherwise("compressible"))

    return _codec(name, classify, lambda v: to_payload(digits(v).cast("long"), width), back)
