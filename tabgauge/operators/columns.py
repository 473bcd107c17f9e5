"""References to columns, and what their values say about them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabgauge.functions import parsing
from tabgauge.functions.order import SKETCH, around

#: Column metadata of a categorical: the categories in order, and whether the order counts.
CATEGORIES, ORDERED = "categories", "ordered"
#: Distinct values up to which a profile's sketches count exactly, and how near (as a share) an estimate beyond may come to a check's threshold before it is counted exactly.
EXACT_UNIQUE, NEAR = 4_096, 0.15
#: Probabilities that a profile gets bounds for.
QUARTERS = (0.25, 0.75)
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass(frozen=True)
class ColumnRef:
    """A column of a table. ``dataset`` names the table in the result store."""

    df: DataFrame = field(repr=False)
    name: str
    dataset: str | None = None

    @property
    def field(self) -> T.StructField:
        return self.df.schema[self.name]

    @property
    def value(self) -> Column:
        return parsing.without_nan(self.df[f"`{self.name}`"], self.field.dataType)


def column(df: DataFrame, name: str, dataset: str | None = None) -> ColumnRef:
    return ColumnRef(df, name, dataset)


def as_ref(x) -> ColumnRef:
    """A reference from a reference or from a pandas Series (its categories and their order are kept)."""
    if isinstance(x, ColumnRef):
        return x
    import pandas as pd

    if not isinstance(x, pd.Series):
        raise TypeError(f"expected a column reference or a pandas Series, not {type(x).__name__}")
    name, spark = str(x.name if x.name is not None else "value"), SparkSession.builder.getOrCreate()
    values, metadata = x, {}
    if isinstance(x.dtype, pd.CategoricalDtype):
        metadata = {CATEGORIES: [str(c) for c in x.cat.categories], ORDERED: bool(x.cat.ordered)}
        values = x.astype(object).where(x.notna(), None).map(lambda v: None if v is None else str(v))
    frame = pd.DataFrame({name: values.reset_index(drop=True)})
    if values.dtype == object:
        held = [None if pd.isna(v) else v for v in values]
        kinds = {type(v) for v in held if v is not None}
        kind = T.BooleanType() if kinds == {bool} else T.LongType() if kinds == {int} else T.DoubleType() if kinds <= {int, float} and kinds else T.StringType()
        cast = {T.BooleanType: bool, T.LongType: int, T.DoubleType: float, T.StringType: str}[type(kind)]
        df = spark.createDataFrame([(None if v is None else cast(v),) for v in held], T.StructType([T.StructField(name, kind)]))
    elif not len(frame):
        kind = T.TimestampNTZType() if values.dtype.kind == "M" else T.BooleanType() if values.dtype.kind == "b" else T.LongType() if values.dtype.kind in "iu" else T.DoubleType()
        df = spark.createDataFrame([], T.StructType([T.StructField(name, kind)]))
    else:
        df = spark.createDataFrame(frame)
    return ColumnRef(df.select(F.col(f"`{name}`").alias(name, metadata=metadata)) if metadata else df, name)


def categorical(df: DataFrame, name: str, categories: Sequence[str], ordered: bool = False) -> DataFrame:
    """``df`` with the categories of a string column declared."""
    return df.withColumn(name, F.col(f"`{name}`").alias(name, metadata={CATEGORIES: list(categories), ORDERED: ordered}))


@dataclass(frozen=True)
class ColumnSpec:
    """What a profile found. ``inferred``: b, i, f, M (date), m (interval), O (other) or ``unsupported``."""

    name: str
    kind: T.DataType
    inferred: str
    wide: bool  # of the 64-bit number types, or read from text
    n: int
    n_missing: int
    n_unique: int  # missing counts as one value
    n_spelled: int = 0  # of the missing ones, empty strings
    categories: tuple[str, ...] | None = None
    ordered: bool = False
    from_text: bool = False
    low: float | None = None  # of numbers
    high: float | None = None
    brackets: tuple[float, ...] | None = None  # around the quartiles

    @property
    def n_present(self) -> int:
        return self.n - self.n_missing

    @property
    def is_number(self) -> bool:
        return self.inferred in ("i", "f")

    def read(self, c: Column) -> Column:
        """Values of the inferred kind: numbers as double, dates as timestamp, others as they are; empty text of a number or date column is missing."""
        if isinstance(self.kind, T.DayTimeIntervalType):
            return F.unix_micros(F.timestamp_seconds(F.lit(0)) + c).cast("double")
        if self.inferred in ("i", "f"):
            return parsing.number(c) if self.from_text else c.cast("double")
        if self.inferred == "M":
            return parsing.date(c) if self.from_text else c.cast("timestamp")
        return c

    def ordinal_value(self, c: Column) -> Column:
        """A number whose order is the column's: dates as microseconds, categories by their place (missing: -1)."""
        if self.categories is not None and self.ordered:
            place = F.array_position(F.array(*[F.lit(x) for x in self.categories]), c)
            return F.coalesce(F.when(place > 0, place - 1), F.lit(-1)).cast("double")
        if self.inferred == "M":
            return F.unix_micros(self.read(c)).cast("double")
        return self.read(c).cast("double") if self.inferred != "b" else c.cast("int").cast("double")


def _kind(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "b"
    if isinstance(kind, _WHOLE):
        return "i"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "f"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "M"
    if isinstance(kind, T.DayTimeIntervalType):
        return "m"
    return "O" if isinstance(kind, (T.StringType, T.NullType)) else "unsupported"


def _plain(v: Column, kind: T.DataType) -> Column:
    """A value that a sketch takes, different for different values."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return parsing.micros(v)
    if isinstance(kind, T.DayTimeIntervalType):
        return F.unix_micros(F.timestamp_seconds(F.lit(0)) + v)
    if isinstance(kind, T.DateType):
        return F.unix_date(v)
    if isinstance(kind, (T.LongType, T.IntegerType, T.DoubleType, T.StringType)):
        return v
    return v.cast("int" if isinstance(kind, (T.BooleanType, T.ByteType, T.ShortType)) else "double" if isinstance(kind, (T.FloatType, T.NullType)) else "string")


@dataclass
class _Found:
    """What one pass found of a column, on one side or on all."""

    n: int = 0
    present: int = 0
    unique: int = 0
    blank: int = 0
    numbers: int = 0
    dates: int = 0
    whole: int = 0
    low: float | None = None
    high: float | None = None
    brackets: tuple[float, ...] | None = None


def _measure(df: DataFrame, columns: Sequence[tuple[Column, T.DataType]], side: str | None, sides: int, date_formats: Sequence[str]) -> list[list[_Found]]:
    """Of each column what was found on each side, and last on all: one pass, whose sketches add up over the sides."""
    text = [isinstance(kind, T.StringType) for _, kind in columns]
    number = [isinstance(kind, (T.StringType, T.NullType, T.DayTimeIntervalType)) or _kind(kind) in ("i", "f") for _, kind in columns]
    held = [F.col(side).alias("side") if side else F.lit(0).alias("side")]
    for i, (v, kind) in enumerate(columns):
        held.append(_plain(v, kind).alias(f"v{i}"))
        if text[i]:
            held += [parsing.number(v).alias(f"x{i}"), parsing.date(v, date_formats).isNotNull().alias(f"d{i}")]
        elif number[i]:
            held.append(_plain(v, kind).cast("double").alias(f"x{i}"))
    counts, sketches, ends = [F.count(F.lit(1)).alias("n")], [], []
    for i in range(len(columns)):
        counts.append(F.count(f"v{i}").alias(f"c{i}"))
        sketches.append(F.theta_sketch_agg(f"v{i}").alias(f"u{i}"))
        if text[i]:
            x = F.col(f"x{i}")
            counts += [F.count_if(F.col(f"v{i}") == "").alias(f"e{i}"), F.count(x).alias(f"k{i}"), F.count_if(f"d{i}").alias(f"d{i}"), F.count_if(x == F.floor(x)).alias(f"w{i}")]
        if number[i]:
            ends += [F.min(f"x{i}").alias(f"l{i}"), F.max(f"x{i}").alias(f"h{i}")]
            sketches.append(F.kll_sketch_agg_double(f"x{i}", F.lit(SKETCH)).alias(f"q{i}"))
    rows = df.select(*held).groupBy("side").agg(*counts, *ends, *sketches)
    plain = ["side", "n", *[f"{k}{i}" for i in range(len(columns)) for k in ("c", *("ekdw" if text[i] else ""), *("lh" if number[i] else ""))]]
    unions = [F.theta_sketch_estimate(F.theta_union_agg(f"u{i}")).alias(f"u{i}") for i in range(len(columns))]
    quarter = F.array(*map(F.lit, around(QUARTERS)))
    unions += [F.when(F.count(f"l{i}") > 0, F.kll_sketch_get_quantile_double(F.kll_merge_agg_double(f"q{i}"), quarter)).alias(f"q{i}") for i in range(len(columns)) if number[i]]
    each = F.collect_list(F.struct(*plain, *[F.theta_sketch_estimate(f"u{i}").alias(f"u{i}") for i in range(len(columns))])).alias("sides")
    row = rows.agg(each, *unions).first()
    by_side = {r["side"]: r for r in row["sides"]}

    def one(i: int, r) -> _Found:
        get = lambda k: r[f"{k}{i}"]
        made = _Found(r["n"], get("c"), get("u"))
        if text[i]:
            made.blank, made.numbers, made.dates, made.whole = (get(k) for k in "ekdw")
            made.unique += made.blank > 0  # sketches skip empty text
        if number[i]:
            made.low, made.high = get("l"), get("h")
        return made

    out = []
    for i in range(len(columns)):
        parts = [one(i, by_side[s]) if s in by_side else _Found() for s in range(sides)]
        total = lambda k: sum(getattr(p, k) for p in parts)
        lows, highs = [p.low for p in parts if p.low is not None], [p.high for p in parts if p.high is not None]
        every = _Found(total("n"), total("present"), (row[f"u{i}"] or 0) + (total("blank") > 0), total("blank"), total("numbers"), total("dates"), total("whole"), min(lows, default=None), max(highs, default=None))
        if number[i] and row[f"q{i}"]:
            every.brackets = tuple(row[f"q{i}"])
        out.append([*parts, every])
    return out


def _spec(field: T.StructField, found: _Found) -> ColumnSpec:
    n, c, kind = found.n, found.present, field.dataType
    inferred, wide, missing, spelled, text = _kind(kind), isinstance(kind, (T.LongType, T.DoubleType, T.DecimalType)), n - c, 0, False
    categories = (field.metadata or {}).get(CATEGORIES)
    if isinstance(kind, T.StringType):
        if categories is None and n - found.numbers == missing + found.blank:
            inferred, wide, spelled, text = "i" if found.whole == c and not missing else "f", True, found.blank, True
        elif categories is None and n - found.dates == missing + found.blank:
            inferred, spelled, text = "M", found.blank, True
    elif isinstance(kind, T.NullType):
        inferred, wide = "f", True
    elif inferred == "m" and not missing:
        inferred, wide = "i", True  # an interval column without gaps reads as whole numbers
    unique = found.unique + (missing > 0) - (1 if spelled and missing and text else 0)
    return ColumnSpec(field.name, kind, inferred, wide, n, missing + spelled, unique, spelled, tuple(categories) if categories is not None else None,
                      bool((field.metadata or {}).get(ORDERED)), text, found.low, found.high, found.brackets)


def profile(df: DataFrame, columns: Sequence[tuple[Column, Sequence[T.StructField]]], side: str | None = None, date_formats: Sequence[str] = (), check=None) -> list[list[ColumnSpec]]:
    """For each column its spec on each side, and last over all of them, by one pass.

    A column is an expression and its fields: one on each side (0, 1 ... in the column ``side``), then that of the expression. Distinct counts beyond ``EXACT_UNIQUE`` are
    estimates, unless ``check`` has a threshold near them or doesn't say which it has; then a second pass counts exactly.
    """
    usable = [k for k, (_, fields) in enumerate(columns) if all(_kind(f.dataType) != "unsupported" for f in fields)]
    sides = max((len(fields) for _, fields in columns), default=1) - (side is not None)
    kinds = [(columns[k][0], columns[k][1][-1].dataType) for k in usable]
    found = _measure(df, kinds, side, sides, date_formats) if usable else []
    if side is None:
        found = [f[-1:] for f in found]
    unsure = [(i, s) for i, parts in enumerate(found) for s, f in enumerate(parts) if check is not None and f.unique > EXACT_UNIQUE * (1 - NEAR) and _near(check.threshold(f.n), f.unique)]
    if unsure:
        of = lambda i, s: _plain(*kinds[i]) if side is None or s == sides else F.when(F.col(side) == s, _plain(*kinds[i]))
        for (i, s), n in zip(unsure, df.agg(*[F.count_distinct(of(i, s)) for i, s in unsure]).first()):
            found[i][s].unique = n
    made = {k: [_spec(field, f) for field, f in zip(columns[k][1], found[i])] for i, k in enumerate(usable)}
    return [made[k] if k in made else [ColumnSpec(f.name, f.dataType, "unsupported", False, 0, 0, 0) for f in fields] for k, (_, fields) in enumerate(columns)]


def _near(threshold: float | None, unique: int) -> bool:
    return threshold is None or abs(unique - threshold) <= NEAR * threshold


def profile_table(df: DataFrame, names: Sequence[str] | None = None, date_formats: Sequence[str] = (), check=None) -> dict[str, ColumnSpec]:
    refs = [ColumnRef(df, c) for c in (df.columns if names is None else names)]
    return {r.name: specs[0] for r, specs in zip(refs, profile(df, [(r.value, [r.field]) for r in refs], None, date_formats, check))}
