"""What metrics have in common: the registry, their configuration, the result row, and where results are kept."""

from __future__ import annotations

from collections.abc import Mapping
from contextlib import contextmanager
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabgauge.operators.classify import Check, ColumnCheck
from tabgauge.operators.columns import ColumnRef, as_ref

RESULT = "metric string, column_a string, column_b string, value double, value_ts timestamp, value_interval interval day to second"


class Metric:
    """A named metric. Subclasses with a ``name`` of their own enter the registry; the first of a name stays.

    ``store`` is where results go besides (see ``tabgauge.sources.store``); ``upload_to_database=False`` keeps them out of it.
    """

    name: ClassVar[str] = ""
    category: ClassVar[str] = ""
    registry: ClassVar[dict[str, type[Metric]]] = {}
    store: ClassVar[Any] = None

    def __init__(self, check: Check | None = None, upload_to_database: bool = True):
        self.check, self.upload_to_database = check or ColumnCheck(), upload_to_database

    def __init_subclass__(cls, **kwargs: Any) -> None:
        super().__init_subclass__(**kwargs)
        if cls.__dict__.get("name"):
            Metric.registry.setdefault(cls.name, cls)

    def __repr__(self) -> str:
        return f"{type(self).__name__}()"

    def __str__(self) -> str:
        return self.name

    def params(self) -> dict[str, Any]:
        return {}

    def to_dict(self) -> dict[str, Any]:
        return {"name": self.name, **self.params()}

    @classmethod
    def from_dict(cls, config: Mapping[str, Any], check: Check | None = None) -> Metric:
        """The metric that ``config`` names, whatever class this is called on. Tables' metrics have the columns' metric nested."""
        params = {k: v for k, v in config.items() if k != "name"}
        kind = Metric.registry[config["name"]]
        if isinstance(params.get("metric"), Mapping):
            return kind(Metric.from_dict(params.pop("metric"), check), **params)
        return kind(**({"check": check} if check is not None else {}), **params)

    @classmethod
    @contextmanager
    def kept_in(cls, store: Any):
        """Within this context, results are added to ``store``."""
        before, Metric.store = Metric.store, store
        try:
            yield store
        finally:
            Metric.store = before

    @classmethod
    @contextmanager
    def not_kept(cls):
        with cls.kept_in(None):
            yield

    def _keep(self, result: DataFrame, dataset: str | None, rows: int, columns: int) -> None:
        if Metric.store is not None and self.upload_to_database:
            if not dataset:
                raise AttributeError("a result that is kept needs the name of its dataset")
            Metric.store.add(self, scalar(result), dataset, rows, columns, self.category)


def result_row(spark: SparkSession, metric: str, a: str | None = None, b: str | None = None, value: Any = None) -> DataFrame:
    """A result of one known value; all NULL if the metric doesn't apply."""
    return spark.range(1).select(*_columns(metric, a, b, F.lit(value).cast("double")))


def _columns(metric: str, a: str | None, b: str | None, value: Column) -> list[Column]:
    kinds = [x.strip().split(" ", 1) for x in RESULT.split(",")]
    held = {"metric": F.lit(metric), "column_a": F.lit(a), "column_b": F.lit(b), "value": value}
    return [held.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in kinds]


def as_result(df: DataFrame, metric: str, a: str | None, b: str | None, value: str = "value", kind: str = "value") -> DataFrame:
    """One row with column ``value`` as a result whose ``kind`` column (value, value_ts, value_interval) has it."""
    held = _columns(metric, a, b, F.lit(None))
    at = {"value": 3, "value_ts": 4, "value_interval": 5}[kind]
    held[at] = F.col(value).cast(["double", "timestamp", "interval day to second"][at - 3]).alias(kind)
    return df.select(*held)


def scalar(result: DataFrame) -> Any:
    """The value of a one-row result: a float, a datetime, a timedelta, or None."""
    row = result.first()
    return next((row[c] for c in ("value", "value_ts", "value_interval") if row[c] is not None), None)


class OneColumnMetric(Metric):
    """Subclasses give ``check_column_types(spec)`` and ``compute(ref, spec)``, a one-row result."""

    category = "OneColumnMetric"

    def check_column_types(self, spec, check: Check | None = None) -> bool:
        raise NotImplementedError

    def compute(self, ref: ColumnRef, spec) -> DataFrame:
        raise NotImplementedError

    def __call__(self, a: ColumnRef, dataset: str | None = None) -> DataFrame:
        from tabgauge.operators.columns import profile_table

        ref = as_ref(a)
        spec = profile_table(ref.df, [ref.name], check=self.check)[ref.name]
        made = self.compute(ref, spec) if self.check_column_types(spec) else result_row(ref.df.sparkSession, self.name, ref.name)
        self._keep(made, dataset or ref.dataset or f"Series_{ref.name}", spec.n, 1)
        return made

    def value(self, a: ColumnRef) -> Any:
        return scalar(self(a))


class TwoColumnMetric(Metric):
    """Subclasses give ``check_column_types(a, b)`` over specs and ``compute(a, b, joint)``, a one-row result."""

    category = "TwoColumnMetric"
    symmetric: ClassVar[bool] = True

    def check_column_types(self, a, b, check: Check | None = None) -> bool:
        raise NotImplementedError

    def compute(self, a: ColumnRef, b: ColumnRef, held) -> DataFrame:
        raise NotImplementedError

    def __call__(self, a: ColumnRef, b: ColumnRef, dataset: str | None = None) -> DataFrame:
        from tabgauge.operators.histogram import joint

        a, b = as_ref(a), as_ref(b)
        held = joint([a, b], self.check)
        if self.check_column_types(*held.specs):
            made = self.compute(a, b, held)
        else:
            made = result_row(a.df.sparkSession, self.name, a.name, b.name)
        self._keep(made, dataset or a.dataset or f"Series_{a.name}", held.specs[0].n, 1)
        return made

    def value(self, a: ColumnRef, b: ColumnRef) -> Any:
        return scalar(self(a, b))


def _kept_with_parts(metric: DataFrameMetric | TwoDataFrameMetric, made: DataFrame, df: DataFrame, dataset: str | None) -> DataFrame:
    """``made``, after its parts and its summary went to the store by one append; it is computed once for that."""
    if Metric.store is None or not metric.upload_to_database:
        return made
    if not dataset:
        raise AttributeError("a result that is kept needs the name of its dataset")
    rows = made.collect()  # a row for each column or pair of columns
    made = df.sparkSession.createDataFrame(rows, made.schema)
    n = df.count()
    parts = [(name, category, value, f"{dataset}_{'_'.join(columns)}", n, 1) for name, category, columns, value in metric.parts(rows)]
    Metric.store.add_all([*parts, (metric.name, metric.category, metric.summarize_result(made), dataset, n, len(df.columns))])
    return made


class DataFrameMetric(Metric):
    """A metric of a table: ``compute(df)`` gives a table, ``summarize_result(result)`` one number."""

    category = "DataFrameMetric"

    def compute(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def summarize_result(self, result: DataFrame) -> float | None:
        raise NotImplementedError

    def parts(self, rows: list) -> list[tuple[str, str, tuple[str, ...], float | None]]:
        """(metric, category, columns, value) of the results that are kept besides the summary, of the collected rows."""
        return []

    def __call__(self, df: DataFrame, dataset: str | None = None) -> DataFrame:
        return _kept_with_parts(self, self.compute(df), df, dataset)


class TwoDataFrameMetric(Metric):
    """A metric of two tables: ``compute(old, new)`` gives a table, ``summarize_result(result)`` one number."""

    category = "TwoDataFrameMetrics"

    def compute(self, old: DataFrame, new: DataFrame) -> DataFrame:
        raise NotImplementedError

    def summarize_result(self, result: DataFrame) -> float | None:
        raise NotImplementedError

    def parts(self, rows: list) -> list[tuple[str, str, tuple[str, ...], float | None]]:
        """(metric, category, columns, value) of the results that are kept besides the summary, of the collected rows."""
        return []

    def __call__(self, old: DataFrame, new: DataFrame, dataset: str | None = None) -> DataFrame:
        return _kept_with_parts(self, self.compute(old, new), old, dataset)
