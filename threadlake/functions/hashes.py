"""String hashes of the session model, as folds over a text's characters in 32-bit arithmetic.

Characters count by their code point. Texts outside the basic plane therefore hash differently from implementations that
count UTF-16 units; null gives null.
"""

from pyspark.sql import Column, functions as F

_WORD = 1 << 32


def _fold(text: Column, start: int, step) -> Column:
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    return F.aggregate(points, F.lit(start).cast("bigint"), step)


def _base36(number: Column) -> Column:
    return F.lower(F.conv(number.cast("string"), 10, 36))


def djb2(text: Column) -> Column:
    """h * 33 + c from 5381, unsigned, in base 36."""
    return _base36(_fold(text, 5381, lambda h, c: (h * 33 + c) % _WORD))


def djb2_signed(text: Column) -> Column:
    """The same as a signed number in base 36."""
    h = _fold(text, 5381, lambda h, c: (h * 33 + c) % _WORD)
    return F.when(h >= _WORD // 2, F.concat(F.lit("-"), _base36(_WORD - h))).otherwise(_base36(h))


def djb2_xor(text: Column) -> Column:
    """(h * 33) xor c from 5381, as an unsigned number."""
    return _fold(text, 5381, lambda h, c: ((h * 33) % _WORD).bitwiseXOR(c))


def times31(text: Column) -> Column:
    """h * 31 + c from 7, unsigned, in base 36."""
    return _base36(_fold(text, 7, lambda h, c: (h * 31 + c) % _WORD))
