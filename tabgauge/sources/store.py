"""Results in a star schema: dimensions dataset, metric and version, and the fact table result.

Two kinds of stores: Parquet folders, and tables of a JDBC database. One writer at a time is assumed: ids follow the largest one. Dimensions are got or created by name, in one pass
over the table. ``ensure_schema`` brings an older store forward by the revisions that it hasn't recorded; columns that they added are read as NULL from older files.
"""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS: dict[str, str] = {
    "dataset": "id int, name string, num_rows long, num_columns int, created_at timestamp",
    "metric": "id int, name string, category string, created_at timestamp",
    "version": "id int, name string, created_at timestamp",
    "result": "id int, metric_id int, dataset_id int, version_id int, value double, created_at timestamp, run_id string, sub_run int",
}
#: Revisions of the schema, in order: a name, and the column that it added to a table, or nothing.
REVISIONS: tuple[tuple[str, str, str], ...] = (
    ("tables", "", ""),
    ("run_id", "result", "run_id string"),
    ("version_name", "", ""),
    ("sub_run", "result", "sub_run int"),
    ("unique_version", "", ""),
    ("unique_metric", "", ""),
)
#: The table that records which revisions a store has.
RECORD = "schema_revision"
SCHEMAS[RECORD] = "name string, applied_at timestamp"
UNVERSIONED = "Unversioned"


class ResultStore:
    """A store in Parquet folders below ``path``. Version and run come from VERSION, RUN_ID and SUB_RUN of the environment unless given."""

    def __init__(self, spark: SparkSession, path: str, version: str | None = None, run_id: str | None = None, sub_run: int | None = None):
        self.spark, self.path = spark, path
        self.version = version or os.environ.get("VERSION") or UNVERSIONED
        self.run_id = run_id if run_id is not None else os.environ.get("RUN_ID")
        sub = os.environ.get("SUB_RUN")
        self.sub_run = sub_run if sub_run is not None else int(sub) if sub else None
        self.known: dict[tuple[str, str], int] = {}
        self.seen: set[str] = set()

    # storage

    def ensure_schema(self, dry_run: bool = False) -> list[str]:
        """Create the tables that are missing, add the columns of later revisions to older ones, and record the revisions; the statements (with ``dry_run`` they are only returned)."""
        done, new = [], not self._exists("result")
        for table in SCHEMAS:
            if not self._exists(table):
                done.append(f"CREATE TABLE {self.table_name(table)} ({self.columns_of(table)})")
                if not dry_run:
                    self._create(table)
        applied = {r["name"] for r in self.read(RECORD).collect()} if self._exists(RECORD) else set()
        missing = [r for r in REVISIONS if r[0] not in applied]
        stored = {table: self._stored_columns(table) for _, table, _ in missing if table and not new}  # before any of them is added
        for _, table, column in missing:
            if table in stored and column.split()[0] not in stored[table]:
                done.append(f"ALTER TABLE {self.table_name(table)} ADD COLUMN {column}")
                if not dry_run:
                    self._add_column(table, column)
        if missing:
            done += [f"INSERT INTO {self.table_name(RECORD)} (name) VALUES ('{name}')" for name, _, _ in missing]
            if not dry_run:
                self._write(self.spark.createDataFrame([(name,) for name, _, _ in missing], "name string").withColumn("applied_at", F.current_timestamp()), RECORD)
        return done

    def table_name(self, table: str) -> str:
        return table

    def columns_of(self, table: str) -> str:
        return SCHEMAS[table]

    def _create(self, table: str) -> None:
        self._write(self.spark.createDataFrame([], SCHEMAS[table]), table)

    def _stored_columns(self, table: str) -> set[str]:
        return {c.lower() for c in self.spark.read.option("mergeSchema", True).parquet(f"{self.path}/{table}").columns}

    def _add_column(self, table: str, column: str) -> None:
        """Older files are read with the later schema, and have NULL there; a file without rows says that the column is there."""
        self._write(self.spark.createDataFrame([], SCHEMAS[table]), table)

    def _exists(self, table: str) -> bool:
        if table not in self.seen:  # a table that is there stays
            try:
                self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.path}/{table}")
            except AnalysisException:
                return False
            self.seen.add(table)
        return True

    def _write(self, rows: DataFrame, table: str) -> None:
        rows.write.mode("append").parquet(f"{self.path}/{table}")

    def read(self, table: str) -> DataFrame:
        """A table; empty if nothing has been written."""
        if not self._exists(table):
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.path}/{table}")

    # dimensions

    def by_name(self, table: str, name: str) -> T.Row | None:
        return self.read(table).where(F.col("name") == name).orderBy("id").first()

    def ids(self, table: str, rows: Sequence[Mapping[str, Any]]) -> dict[str, int]:
        """Ids of the rows' names, which are made where they are new."""
        wanted = {r["name"]: r for r in rows if (table, r["name"]) not in self.known}
        if wanted:
            # one pass: the ids of the names that are there (the least, should two writers have made one), and the largest id
            is_wanted = F.col("name").isin(list(wanted))
            row = self.read(table).agg(F.max("id"), F.collect_list(F.when(is_wanted, F.struct("name", "id")))).first()
            for r in sorted(row[1], key=lambda r: -r["id"]):
                self.known[table, r["name"]] = r["id"]
            fields = T._parse_datatype_string(SCHEMAS[table])
            given = [f for f in fields if f.name not in ("id", "created_at")]
            new = [r for n, r in sorted(wanted.items()) if (table, n) not in self.known]
            if new:
                first = (row[0] or 0) + 1
                made = self.spark.createDataFrame([(first + i, *(r.get(f.name) for f in given)) for i, r in enumerate(new)], T.StructType([fields["id"], *given]))
                self._write(made.withColumn("created_at", F.current_timestamp()).select(fields.names), table)
                self.known |= {(table, r["name"]): first + i for i, r in enumerate(new)}
        return {r["name"]: self.known[table, r["name"]] for r in rows}

    def dataset_id(self, name: str, num_rows: int | None = None, num_columns: int | None = None) -> int:
        return self.ids("dataset", [{"name": name, "num_rows": num_rows, "num_columns": num_columns}])[name]

    def metric_id(self, name: str, category: str | None = None) -> int:
        return self.ids("metric", [{"name": name, "category": category}])[name]

    def version_id(self, name: str) -> int:
        return self.ids("version", [{"name": name}])[name]

    # facts

    def add(self, metric: Any, value: Any, dataset: str, rows: int, columns: int, category: str) -> None:
        """One result. Dates and intervals are kept as seconds."""
        self.add_all([(str(metric), category, value, dataset, rows, columns)])

    def add_all(self, results: Sequence[tuple[str, str, Any, str, int, int]]) -> None:
        """Results (metric, category, value, dataset, rows, columns) by one append to each table."""
        metrics = self.ids("metric", [{"name": m, "category": c} for m, c, *_ in results])
        datasets = self.ids("dataset", [{"name": d, "num_rows": n, "num_columns": k} for *_, d, n, k in results])
        version = self.version_id(self.version)
        first = (self.read("result").agg(F.max("id")).first()[0] or 0) + 1
        number = lambda v: None if v is None else v.timestamp() if hasattr(v, "timestamp") else v.total_seconds() if hasattr(v, "total_seconds") else float(v)
        facts = [(first + i, metrics[m], datasets[d], version, number(v), self.run_id, self.sub_run) for i, (m, _, v, d, _, _) in enumerate(results)]
        made = self.spark.createDataFrame(facts, "id int, metric_id int, dataset_id int, version_id int, value double, run_id string, sub_run int")
        self._write(made.withColumn("created_at", F.current_timestamp()).select(T._parse_datatype_string(SCHEMAS["result"]).names), "result")

    def results(self) -> DataFrame:
        """Facts with the names of their dimensions."""
        name = lambda t: self.read(t).select(F.col("id").alias(f"{t}_id"), F.col("name").alias(t))
        return self.read("result").join(name("metric"), "metric_id", "left").join(name("dataset"), "dataset_id", "left").join(name("version"), "version_id", "left")


class JdbcResultStore(ResultStore):
    """A store in a database. ``options`` are those of Spark's JDBC source: url, driver, user, password."""

    def __init__(self, spark: SparkSession, options: Mapping[str, str], version: str | None = None, run_id: str | None = None, sub_run: int | None = None):
        super().__init__(spark, options["url"], version, run_id, sub_run)
        self.options = dict(options)

    @classmethod
    def from_env(cls, spark: SparkSession) -> JdbcResultStore | None:
        """The Postgres database that POSTGRES_HOST, _PORT, _USER, _PASSWORD and _DATABASE name; None without a password."""
        env = os.environ.get
        if not (password := env("POSTGRES_PASSWORD")):
            return None
        url = f"jdbc:postgresql://{env('POSTGRES_HOST', 'localhost')}:{env('POSTGRES_PORT', '5432')}/{env('POSTGRES_DATABASE', 'postgres')}"
        return cls(spark, {"url": url, "driver": "org.postgresql.Driver", "user": env("POSTGRES_USER", "postgres"), "password": password})

    def _reader(self, table: str):
        return self.spark.read.format("jdbc").options(**self.options).option("dbtable", self.table_name(table))

    def table_name(self, table: str) -> str:
        return f"{table}_dim" if table in ("dataset", "metric", "version") else "result_fact" if table == "result" else table

    def columns_of(self, table: str) -> str:
        """As Spark's JDBC source makes them, texts as wide as a dataset's name."""
        kinds = {"int": "INTEGER", "long": "BIGINT", "double": "DOUBLE PRECISION", "string": "VARCHAR(200)", "timestamp": "TIMESTAMP"}
        return ", ".join(f"{name} {kinds[kind]}" for name, kind in (x.split() for x in SCHEMAS[table].split(", ")))

    def _create(self, table: str) -> None:
        texts = ", ".join(f"{x.split()[0]} VARCHAR(200)" for x in SCHEMAS[table].split(", ") if x.endswith(" string"))
        self.spark.createDataFrame([], SCHEMAS[table]).write.format("jdbc").options(**self.options).option("dbtable", self.table_name(table)).option("createTableColumnTypes", texts).mode("append").save()

    def _stored_columns(self, table: str) -> set[str]:
        return {c.lower() for c in self._reader(table).load().columns}

    def _add_column(self, table: str, column: str) -> None:
        name, kind = column.split()
        self._execute(f"ALTER TABLE {self.table_name(table)} ADD COLUMN {name} {'VARCHAR(200)' if kind == 'string' else 'INTEGER'}")

    def _execute(self, statement: str) -> None:
        jvm, options = self.spark._jvm, self.options
        if "driver" in options:
            jvm.java.lang.Class.forName(options["driver"], True, jvm.java.lang.Thread.currentThread().getContextClassLoader())
        connection = jvm.java.sql.DriverManager.getConnection(options["url"], options.get("user", ""), options.get("password", ""))
        try:
            connection.createStatement().execute(statement)
        finally:
            connection.close()

    def _exists(self, table: str) -> bool:
        if table in self.seen:
            return True
        try:
            self._reader(table).load()
        except Exception as error:  # drivers have exceptions of their own
            if any(x in str(error).lower() for x in ("does not exist", "no such table", "not found")):
                return False
            raise
        self.seen.add(table)
        return True

    def _write(self, rows: DataFrame, table: str) -> None:
        if not self._exists(table):
            self.ensure_schema()
        held = rows.agg(*[F.count(c).alias(c) for c in rows.columns]).first()
        rows = rows.select(*[c for c in rows.columns if held[c]])  # columns without any value are left out: not all databases take a NULL of Spark's text type
        if rows.columns:
            rows.write.format("jdbc").options(**self.options).option("dbtable", self.table_name(table)).mode("append").save()

    def read(self, table: str) -> DataFrame:
        if not self._exists(table):
            return self.spark.createDataFrame([], SCHEMAS[table])
        held = self._reader(table).load()
        names = {c.lower(): c for c in held.columns}
        return held.select(*[(F.col(names[f.name]) if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(SCHEMAS[table])])
