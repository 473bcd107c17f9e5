"""Classification, tables' metrics, plot data, the store, streams and the driver's entry points."""

import json
import math
import os
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import tabgauge.metrics as m
from tabgauge.operators import plotdata
from tabgauge.operators.columns import categorical, column, profile_table
from tabgauge.sources.store import JdbcResultStore, ResultStore
from tabgauge.sources.tables import get_df

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def seven_kinds(spark, gaps=False):
    rng = np.random.default_rng(1)
    n = 1000
    rows = [(
        str(rng.choice(list("ABCDE"))), bool(rng.integers(2)), (pd.Timestamp("2019-04-14") + pd.Timedelta(days=int(rng.normal(500, 50)))).to_pydatetime(), int(rng.integers(10, 100_000)), float(rng.normal()),
        int(rng.integers(2)), str(rng.choice(list("bdc")))) for _ in range(n)]
    if gaps:
        rows = [tuple(None if rng.random() < 0.1 else v for v in r) for r in rows]
    kind = "string_col string, bool_col boolean, date_col timestamp, int_col long, float_col double, int_bool_col long, ordered_cat_col string"
    return categorical(spark.createDataFrame(rows, kind), "ordered_cat_col", "bcd", ordered=True)


@pytest.mark.parametrize("gaps", [False, True])
def test_kinds(spark, gaps):
    found = m.classify(seven_kinds(spark, gaps)).collect()
    of = lambda k: {r.column for r in found if r[k]}
    assert of("continuous") == {"int_col", "float_col"}
    assert of("categorical") == {"string_col", "bool_col", "int_bool_col", "ordered_cat_col"}
    assert of("ordinal") == {"bool_col", "date_col", "int_col", "float_col", "int_bool_col", "ordered_cat_col"}
    assert of("affine") == {"date_col", "int_col", "float_col"}


def test_inference_of_text(spark):
    held = spark.createDataFrame([("1", "1.5", "", "2020-01-01", "1d", "inf", "0x10", " 7 ", "", "a"), ("2", "", "", "2020-02-01 10:00:00", "2", "1e3", "1", "8", None, "2")], "a string, b string, c string, d string, e string, f string, g string, h string, i string, j string")
    got = {r.column: r.inferred for r in m.classify(held).collect()}
    assert got == {"a": "int", "b": "float", "c": "float", "d": "datetime", "e": "object", "f": "float", "g": "object", "h": "int", "i": "float", "j": "object"}


def test_nan_counts_as_missing_and_widths(spark):
    held = spark.range(100).select(F.when(F.col("id") < 5, float("nan")).otherwise(F.col("id").cast("double")).alias("x"), F.col("id").cast("int").alias("i"), F.col("id").cast("float").alias("f"), F.col("id").cast("decimal(10,2)").alias("d"), F.array("id").alias("arr"))
    rows = {r.column: r for r in m.classify(held).collect()}
    assert rows["x"].n_missing == 5 and rows["x"].continuous and rows["i"].continuous and not rows["i"].ordinal and not rows["f"].ordinal and rows["d"].ordinal
    assert not any(rows["arr"][k] for k in ("continuous", "categorical", "ordinal", "affine"))
    assert m.ColumnCheck(strict_ordinal=False).ordinal(profile_table(held.select("i"))["i"])


def two_tables(spark):
    rng = np.random.default_rng(4)
    rows = [(float(rng.normal(k % 2, 1)), "abc"[int(rng.integers(3))], int(rng.integers(5)), k % 2) for k in range(800)]
    held = spark.createDataFrame(rows, "x double, g string, n long, side int")
    return held.where("side = 0").drop("side"), held.where("side = 1").drop("side")


def values(df):
    return {r.column: r.value for r in df.collect()}


def test_maps_equal_single_metrics(spark):
    old, new = two_tables(spark)
    for metric in (m.KullbackLeibler(), m.JensenShannon(), m.Hellinger(), m.Norm(ord=3), m.Norm(ord=-math.inf), m.TotalVariation(), m.Bhattacharyya(), m.KolmogorovSmirnov(), m.EarthMovers()):
        got = values(m.TwoColumnMap(metric)(old, new))
        assert set(got) == {"x", "g", "n"}
        for c, v in got.items():
            one = metric.value(column(old, c), column(new, c))
            assert v == pytest.approx(one) if one is not None else v is None
    with pytest.raises(KeyError):
        m.TwoColumnMap(m.Hellinger())(old, new.drop("g"))
    ones = values(m.OneColumnMap(m.StandardDeviation())(old))
    assert ones["x"] == pytest.approx(m.StandardDeviation().value(column(old, "x"))) and ones["g"] is None
    summary = m.OneColumnMap(m.Mean())
    assert summary.summarize_result(summary(old)) == pytest.approx(m.Mean().value(column(old, "x")))


def test_matrices(spark):
    old, new = two_tables(spark)
    matrix = m.CorrMatrix(m.CramersV())
    cells = {(r.column_a, r.column_b): r.value for r in matrix(old).collect()}
    assert len(cells) == 9 and cells["x", "x"] is None and cells["x", "g"] is None and cells["g", "n"] == cells["n", "g"]
    assert cells["g", "n"] == pytest.approx(m.CramersV().value(*(m.column(old, c) for c in ("g", "n"))), rel=1e-5)
    assert math.isnan(matrix.summarize_result(matrix(old))) and m.CorrMatrix(m.CramersV(), skipna=True).summarize_result(matrix(old)) == cells["g", "n"]
    assert set(m.CorrMatrix.wide(matrix(old)).columns) == {"column_b", "x", "g", "n"}
    kl = {(r.column_a, r.column_b): r.value for r in m.CorrMatrix(m.KullbackLeibler())(old.select("g", F.col("g").alias("h"), F.reverse("g").alias("r")).limit(400)).collect()}
    assert kl["g", "h"] == pytest.approx(0)
    diff = m.DiffCorrMatrix(m.CramersV())
    got = {(r.column_a, r.column_b): r.value for r in diff(old, new).collect()}
    other = {(r.column_a, r.column_b): r.value for r in matrix(new).collect()}
    assert got["g", "n"] == pytest.approx(cells["g", "n"] - other["g", "n"], abs=1e-6) and diff.summarize_result(diff(old, new)) == pytest.approx(abs(got["g", "n"]))


def test_compare_all(spark):
    old, new = two_tables(spark)
    got = {(r.column, r.metric): r.value for r in m.compare_all(old, new).collect()}
    assert got["x", "hellinger_distance"] == pytest.approx(m.Hellinger().value(column(old, "x"), column(new, "x")))
    assert got["x", "kolmogorov_smirnov_distance"] == pytest.approx(m.KolmogorovSmirnov().value(column(old, "x"), column(new, "x")))
    assert ("g", "earth_movers_distance") in got and ("x", "earth_movers_distance") not in got and got["g", "norm_1"] == pytest.approx(2 * got["g", "total_variation_distance"])


def test_plot_data(spark):
    old, new = two_tables(spark)
    assert plotdata.series_names(4, ["a"]) == ["a", "synth", "unnamed0", "unnamed1"] and plotdata.color_scheme(3, "rg") == ["r", "g", "r"] and plotdata.axes_grid(3) == [(0, 0, 0), (1, 0, 1), (2, 1, 0)]
    counts = plotdata.categorical_counts([column(old, "g"), column(new, "g")], sample_size=100)
    assert {r.s for r in counts.groupBy("dataset").agg(F.sum("n").alias("s")).collect()} == {100}
    assert plotdata.categorical_counts([column(old, "g"), column(new.where("1 = 0"), "g")]).count() == 0
    x = np.array([r.x for r in old.collect()])
    curve = plotdata.continuous_column(column(old, "x")).orderBy("x").collect()
    width = x.std(ddof=1) * len(x) ** -0.2
    at = curve[57].x
    assert len(curve) == 200 and curve[57].density == pytest.approx(np.exp(-0.5 * ((at - x) / width) ** 2).sum() / (len(x) * width * math.sqrt(2 * math.pi)))
    both = plotdata.continuous([column(old, "x"), column(new, "x")], remove_outliers=0.1)
    assert {r.dataset for r in both.select("dataset").distinct().collect()} == {"orig", "synth"}
    cells = plotdata.cross_tables(old.where("g <> 'c'"), new, "g", "n").collect()
    assert len(cells) == 15 and sum(r.n_test for r in cells if r.a == "c") == 0
    plan, data = plotdata.dataset([old, new], max_categories=3)
    assert {r.column: r.panel for r in plan.collect()} == {"x": "continuous", "g": "categorical", "n": "text"} and set(data) == {"x", "g", "n"}


def test_get_df(spark, tmp_path):
    (tmp_path / "some.csv").write_text("a,b\n1,x\n2,y\n")
    df, name = get_df(spark, str(tmp_path / "some.csv"))
    assert name == "some" and df.count() == 2 and dict(df.dtypes) == {"a": "int", "b": "string"}
    with pytest.raises(ValueError):
        get_df(spark, "///")


def check_store(spark, store, again):
    held = spark.range(60).select(F.col("id").cast("double").alias("x"))
    assert store.ensure_schema(dry_run=True) and store.ensure_schema() and not store.ensure_schema()
    with m.Metric.kept_in(store):
        m.Mean()(column(held, "x"))
        m.Mean()(column(held, "x"), dataset="mine")
        m.Mean(upload_to_database=False)(column(held, "x"))
        with m.Metric.not_kept():
            m.Mean()(column(held, "x"))
        m.OneColumnMap(m.Mean())(held, dataset="mine")
        with pytest.raises(AttributeError):
            m.OneColumnMap(m.Mean())(held)
        m.compute_bootstrap_interval(m.Mean(), column(held, "x"), n_samples=3)
    rows = sorted((r.id, r.metric, r.dataset, r.version, r.value) for r in again.results().collect())
    assert rows == [(1, "mean", "Series_x", "Unversioned", 29.5), (2, "mean", "mine", "Unversioned", 29.5), (3, "mean", "mine_x", "Unversioned", 29.5), (4, "mean_map", "mine", "Unversioned", 29.5)]
    assert again.by_name("metric", "mean").category == "OneColumnMetric" and again.by_name("metric", "other") is None
    assert again.by_name("dataset", "Series_x").num_rows == 60 and again.dataset_id("mine") == 2 and again.version_id("2") == 2


def test_parquet_store(spark, tmp_path, monkeypatch):
    for name in ("VERSION", "RUN_ID", "SUB_RUN"):
        monkeypatch.delenv(name, raising=False)
    check_store(spark, ResultStore(spark, str(tmp_path)), ResultStore(spark, str(tmp_path)))
    monkeypatch.setenv("RUN_ID", "r")
    monkeypatch.setenv("SUB_RUN", "3")
    other = ResultStore(spark, str(tmp_path), version="9")
    other.add("mean", 1.5, "mine", 1, 1, "OneColumnMetric")
    last = other.results().orderBy(F.desc("id")).first()
    assert (last.run_id, last.sub_run, last.version) == ("r", 3, "9")


def test_jdbc_store(spark, tmp_path, monkeypatch):
    monkeypatch.delenv("VERSION", raising=False)
    options = {"url": f"jdbc:derby:{tmp_path}/db;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    check_store(spark, JdbcResultStore(spark, options), JdbcResultStore(spark, options))
    monkeypatch.delenv("POSTGRES_PASSWORD", raising=False)
    assert JdbcResultStore.from_env(spark) is None
    monkeypatch.setenv("POSTGRES_PASSWORD", "x")
    assert JdbcResultStore.from_env(spark).path == "jdbc:postgresql://localhost:5432/postgres"


def older(store, spark):
    """A store as the first revision left it, with one result."""
    for table in ("dataset", "metric", "version"):
        store._create(table)
    store._write(spark.createDataFrame([(1, 1, 1, 1, 2.5)], "id int, metric_id int, dataset_id int, version_id int, value double"), "result")
    store.seen.clear()
    return store


def test_an_older_store_is_brought_forward(spark, tmp_path):
    store = older(ResultStore(spark, str(tmp_path / "old")), spark)
    done = store.ensure_schema()
    assert [x.split(" (")[0] for x in done[:3]] == ["CREATE TABLE schema_revision", "ALTER TABLE result ADD COLUMN run_id string", "ALTER TABLE result ADD COLUMN sub_run int"] and len(done) == 9
    assert store.ensure_schema() == [] and store.read("schema_revision").count() == 6
    store.add("mean", 1.5, "mine", 1, 1, "OneColumnMetric")
    assert [(r.id, r.value) for r in store.read("result").orderBy("id").collect()] == [(1, 2.5), (2, 1.5)]


def test_an_older_database_is_brought_forward(spark, tmp_path):
    options = {"url": f"jdbc:derby:{tmp_path}/older;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    store = JdbcResultStore(spark, options)
    for table in ("dataset", "metric", "version"):
        store._create(table)
    spark.createDataFrame([(1, 1, 1, 1, 2.5)], "id int, metric_id int, dataset_id int, version_id int, value double").withColumn("created_at", F.current_timestamp()).write.format("jdbc").options(**options).option("dbtable", "result_fact").save()
    done = store.ensure_schema()
    assert "ALTER TABLE result_fact ADD COLUMN run_id string" in done and not JdbcResultStore(spark, options).ensure_schema()
    other = JdbcResultStore(spark, options, run_id="r", sub_run=4)
    other.add("mean", 1.5, "mine", 1, 1, "OneColumnMetric")
    assert [(r.id, r.value, r.run_id, r.sub_run) for r in other.read("result").orderBy("id").collect()] == [(1, 2.5, None, None), (2, 1.5, "r", 4)]


def test_matrices_keep_a_result_for_each_pair(spark, tmp_path):
    old, new = two_tables(spark)
    store = ResultStore(spark, str(tmp_path / "pairs"))
    with m.Metric.kept_in(store):
        m.CorrMatrix(m.CramersV())(old.select("g", "n"), dataset="d")
        m.TwoColumnMap(m.TotalVariation())(old.select("g"), new.select("g"), dataset="e")
    rows = [(r.metric, r.dataset) for r in store.results().orderBy("id").collect()]
    assert sorted(rows) == sorted([("cramers_v", "d_g_n"), ("cramers_v", "d_n_g"), ("cramers_v_matrix", "d"), ("total_variation_distance", "e_g"), ("total_variation_distance_map", "e")])


def test_long_names(spark):
    assert m.HellingerDistance is m.Hellinger and {"KullbackLeiblerDivergence", "EarthMoversDistanceBinned"} <= set(m.__all__)


def test_binned_distance_of_sparse_tables(spark):
    edges = [0.0, 1.0, 5.0, 6.0]
    held = spark.createDataFrame([(0, 2, 0), (2, 0, 3)], "at int, x int, y int")
    assert m.EarthMoversBinned(bin_edges=edges, position="at").value(column(held, "x"), column(held, "y")) == pytest.approx(5.0)
    with pytest.raises(ValueError):
        m.EarthMoversBinned(bin_edges=edges, position="at").value(*(column(held.withColumn("at", F.col("at") + 1), c) for c in "xy"))
    with pytest.raises(ValueError):
        m.EarthMoversBinned().value(column(held, "x"), column(held.limit(2), "y"))


def test_window_draws_each_column_down_on_its_own(spark):
    a, b = (spark.range(n).select(F.col("id").cast("double").alias("v")) for n in (50, 400))
    sizes = lambda size: {r.dataset: r["count"] for r in plotdata.continuous_window([column(b, "v"), column(a, "v")], 0.0, size)[0].groupBy("dataset").count().collect()}
    assert sizes(None) == {"orig": 400, "synth": 50}
    assert sizes(100)["orig"] == 100
    far = a.select((F.col("v") + 1e6).alias("v"))
    _, data = plotdata.dataset([b, far], sample_size=None)
    assert "outside" in data["v"].first().text


def test_distinct_counts_near_an_own_threshold_are_exact(spark):
    held = spark.range(20_000).select((F.col("id") % 5000).alias("x"))
    kind = lambda n: m.classify(held, check=m.ColumnCheck(min_num_unique=n)).first().continuous
    assert kind(5000) and not kind(5001)


def test_stream_against_baseline(spark, tmp_path):
    from tabgauge.streaming.drift import watch

    old, new = two_tables(spark)
    new.write.parquet(str(tmp_path / "in"))
    found = []
    stream = spark.readStream.schema(new.schema).parquet(str(tmp_path / "in"))
    run = watch(stream, old, m.TwoColumnMap(m.TotalVariation()), lambda r, i: found.extend(r.collect()), str(tmp_path / "at"), availableNow=True)
    run.awaitTermination(120)
    assert {r.column for r in found} == {"x", "g", "n"} and {r.batch_id for r in found} == {0}
    assert values(m.TwoColumnMap(m.TotalVariation())(old, new)) == pytest.approx({r.column: r.value for r in found})


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test data")
def test_entry_points_without_the_corpus_folder(spark, tmp_path):
    """The catalogue works where the corpus operators are deleted."""
    import shutil

    shutil.copytree(f"{ROOT}/tabgauge", tmp_path / "tabgauge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import sys, json; sys.path.insert(0, '.'); import __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.returncode == 0, out.stderr
    queries, sql = json.loads(out.stdout)
    assert not any(q.startswith("op") or q == "pipeline" for q in queries) and set(sql) <= set(queries) and len(queries) > 70


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test data")
def test_flagship(spark):
    sys.path.insert(0, ROOT)
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.columns == ["column", "metric", "value"] and found.count() > 50


def same_rows(spark_df, duck_rows, columns):
    order = sorted(spark_df.columns)
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 6) if isinstance(v, float) else v
    a = sorted((tuple(clean(r[c]) for c in order) for r in spark_df.collect()), key=str)
    b = sorted((tuple(clean(r[columns.index(c)]) for c in order) for r in duck_rows), key=str)
    return order == sorted(columns) and a == b


def catalogue_names():
    from tabgauge.plans import catalogue

    return sorted(n for n in catalogue.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test data")
@pytest.mark.parametrize("name", catalogue_names())
def test_query_against_sql(spark, name):
    import duckdb

    from tabgauge.plans import catalogue

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("nation", "customer", "part", "orders", "lineitem", "events", "labels", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = con.sql(catalogue.oracle_sql()[name])
    if name == "earth_movers_distance_guard":
        pytest.skip("too few orders at this size")
    assert same_rows(catalogue.queries()[name](spark, SF), got.fetchall(), got.columns)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test data")
def test_kendall_of_all_rows(spark):
    import duckdb
    import numpy as np

    from tabgauge.plans import catalogue

    def brute(x, y):
        x, y = np.array(x, float), np.array(y, float)
        dx, dy = (np.sign(np.subtract.outer(v, v)) for v in (x, y))
        return (dx * dy).sum() / np.sqrt(float((dx != 0).sum()) * float((dy != 0).sum()))

    def columns(table, *exprs):
        kept = " AND ".join(f"({e}) IS NOT NULL" for e in exprs)
        return zip(*duckdb.sql(f"SELECT {', '.join(exprs)} FROM '{SF}/{table}.parquet' WHERE {kept}").fetchall())

    made = catalogue.queries()
    assert made["kendall_tau_dates"](spark, SF).first().value == pytest.approx(brute(*columns("events", "epoch_us(ts)", "value")), abs=1e-7)
    assert made["kendall_tau_categories"](spark, SF).first().value == pytest.approx(brute(*columns("orders", "substr(o_orderpriority, 1, 1)::int", "o_totalprice")), abs=1e-7)
    cells = {(r.column_a, r.column_b): r.value for r in made["corr_matrix_kendall"](spark, SF).collect()}
    for a, b in (("event_id", "user_id"), ("event_id", "value"), ("user_id", "value")):
        assert cells[a, b] == pytest.approx(brute(*columns("events", a, b)), abs=2e-5)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test data")
def test_plot_data_of_all_rows(spark):
    from collections import Counter

    import duckdb
    import numpy as np

    from tabgauge.plans import catalogue

    rows = lambda sql, table: duckdb.sql(f"SELECT {sql} FROM '{SF}/{table}.parquet'").fetchall()
    made = catalogue.queries()
    part = rows("p_type, p_name, p_partkey % 2", "part")
    counts, found = Counter(part), made["cross_tables"](spark, SF).collect()
    assert {(r.a, r.b, r.n_test, r.n_synth) for r in found} == {(a, b, counts[a, b, 0], counts[a, b, 1]) for a in {p[0] for p in part} for b in {p[1] for p in part}}
    lines = Counter((("orig", "synth")[k % 2], f) for k, f in rows("l_linenumber, l_returnflag", "lineitem") if k in (1, 2))
    assert {(r.dataset, r.value): r.n for r in made["plot_categorical"](spark, SF).collect()} == lines
    v = np.array([x for (x,) in rows("value", "events")])
    h = v.std(ddof=1) * len(v) ** -0.2
    grid = np.linspace(v.min() - 3 * h, v.max() + 3 * h, 200)
    want = np.exp(-0.5 * ((grid[:, None] - v) / h) ** 2).sum(1) / (len(v) * h * np.sqrt(2 * np.pi))
    found = sorted((r.x, r.density) for r in made["plot_kde"](spark, SF).collect())
    assert np.allclose(found, np.column_stack([grid, want]), atol=2e-6)


def test_ks_distance_nulls_of_few_values(spark, tmp_path):
    import duckdb

    from tabgauge.plans import catalogue

    def compare(name, rows):
        path = str(tmp_path / name / "lineitem.parquet")
        spark.createDataFrame(rows, "l_linenumber int, l_quantity double").coalesce(1).write.parquet(path)
        con = duckdb.connect()
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}/*.parquet'")
        got = con.sql(catalogue.oracle_sql()["ks_distance_nulls"])
        found = catalogue.queries()["ks_distance_nulls"](spark, str(tmp_path / name))
        assert same_rows(found, got.fetchall(), got.columns)
        return found.first().value

    few = [(1 + k % 2, 1.0 + k % 12) for k in range(600)] + [(3 + k % 5, 1.0 + k % 17 % 12) for k in range(600)]  # 12 distinct values a side: at least 10, but fewer than 2.5 * ln(600) = 16
    assert compare("few", few) > 0.1
    held = spark.createDataFrame(few, "l_linenumber int, l_quantity double")
    assert m.KolmogorovSmirnov().value(column(held.where("l_linenumber < 3"), "l_quantity"), column(held.where("l_linenumber > 2"), "l_quantity")) is None  # the gate stays
    assert compare("constant", [(1, 1.0), (2, 1.0), (3, 1.0), (4, 2.0)]) == 0.5
    for name, rows in {"none": [], "one": [(1, 3.0), (2, 5.0)], "other": [(3, 3.0), (4, 9.0)], "missing": [(1, 5.0), (2, None), (3, 3.0)]}.items():
        assert compare(name, rows) is None
