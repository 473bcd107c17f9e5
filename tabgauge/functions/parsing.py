"""Column expressions that read numbers and dates as a table reader would, and give NULL where they can't."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBER = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|[iI]nf(?:inity)?)\s*$"
_DATE = r"^\s*[0-9]{4}-[0-9]{1,2}(?:-[0-9]{1,2}(?:[ T][0-9].*)?)?\s*$"


def without_nan(c: Column, kind: T.DataType) -> Column:
    """NaN counts as missing."""
    return F.nullif(c, F.lit(float("nan")).cast(kind)) if isinstance(kind, (T.FloatType, T.DoubleType)) else c


def number(c: Column) -> Column:
    """The number that a string spells; suffixes such as ``1d``, hexadecimal and thousands marks don't count."""
    first = F.ascii(c)  # white space, a sign, a point, a digit, or the i of infinity: most texts need no pattern
    return F.when(((first <= 57) | first.isin(73, 105)) & c.rlike(_NUMBER), F.trim(c).try_cast("double"))


def date(c: Column, formats: Sequence[str] = ()) -> Column:
    """The time that a string spells in ISO form or in one of ``formats``."""
    iso = F.when((F.ascii(c) <= 57) & c.rlike(_DATE), F.trim(c).try_cast("timestamp"))
    return F.coalesce(iso, *(F.try_to_timestamp(c, F.lit(f)) for f in formats)) if formats else iso


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a date or a timestamp of any kind."""
    return F.unix_micros(c.cast("timestamp"))
