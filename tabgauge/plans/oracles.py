"""SQL that gives the rows of the catalogue's queries, written apart from their plans."""

from __future__ import annotations

from collections.abc import Sequence


def two_sides(a: str, b: str) -> str:
    """``j(side, v)`` from two selections of one expression each: 'expression FROM table WHERE ...'."""
    return f"SELECT 0 AS side, v FROM (SELECT {a.replace(' FROM ', ' AS v FROM ', 1)}) UNION ALL SELECT 1, v FROM (SELECT {b.replace(' FROM ', ' AS v FROM ', 1)})"


BINS = """
    s AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM j WHERE v IS NOT NULL),
    w AS (SELECT *, 2.0 * (q3 - q1) * pow(n, -1.0 / 3) AS fd, (hi - lo) / (log2(n) + 1) AS sg FROM s),
    b AS (SELECT *, CAST(ceil((hi - lo) / CASE WHEN fd > 0 THEN least(fd, sg) ELSE sg END) AS BIGINT) AS nb FROM w),
    e AS (SELECT k, k * ((hi - lo) / nb) + lo AS l, CASE WHEN k = nb - 1 THEN hi ELSE (k + 1) * ((hi - lo) / nb) + lo END AS r, nb FROM (SELECT *, unnest(range(0, nb)) AS k FROM b))"""


def continuous_counts(a: str, b: str) -> str:
    """CTEs that end in ``h(k, c0, c1)``, with all bins."""
    return f"""WITH j AS ({two_sides(a, b)}), {BINS},
    h AS (SELECT k, count(v) FILTER (side = 0) AS c0, count(v) FILTER (side = 1) AS c1 FROM e LEFT JOIN j ON v >= l AND (v < r OR (k = nb - 1 AND v = r)) GROUP BY k)"""


def categorical_counts(a: str, b: str) -> str:
    return f"""WITH j AS ({two_sides(a, b)}),
    h AS (SELECT CAST(v AS VARCHAR) AS k, count(*) FILTER (side = 0) AS c0, count(*) FILTER (side = 1) AS c1 FROM j WHERE v IS NOT NULL GROUP BY 1)"""


SHARES = "f AS (SELECT k, c0 / sum(c0) OVER () AS p, c1 / sum(c1) OVER () AS q FROM h)"

#: Each metric over ``f(k, p, q)``.
OF_SHARES = {
    "kullback_leibler_divergence": "sum(CASE WHEN p = 0 THEN 0 WHEN q = 0 THEN 'infinity'::DOUBLE ELSE p * ln(p / q) END)",
    "jensen_shannon_divergence": "sqrt(greatest(0, sum(CASE WHEN p = 0 THEN 0 ELSE p * ln(2 * p / (p + q)) END + CASE WHEN q = 0 THEN 0 ELSE q * ln(2 * q / (p + q)) END) / 2))",
    "hellinger_distance": "sqrt(sum(pow(sqrt(p) - sqrt(q), 2)) / 2)",
    "bhattacharyya_coefficient": "sum(sqrt(p * q))",
    "total_variation_distance": "sum(abs(p - q)) / 2",
    "norm_l1": "sum(abs(p - q))",
    "norm_l2": "sqrt(sum(pow(p - q, 2)))",
    "norm_l3": "pow(sum(pow(abs(p - q), 3)), 1.0 / 3)",
    "norm_inf": "max(abs(p - q))",
    "norm_neg_inf": "min(abs(p - q))",
    "norm_l0": "count(*) FILTER (p <> q)",
}

KS = """SELECT max(abs(f0 - f1)) AS d FROM (
    SELECT DISTINCT v, sum(CASE side WHEN 0 THEN 1 ELSE 0 END) OVER o / (SELECT count(*)::DOUBLE FROM j WHERE side = 0 AND v IS NOT NULL) AS f0,
           sum(CASE side WHEN 1 THEN 1 ELSE 0 END) OVER o / (SELECT count(*)::DOUBLE FROM j WHERE side = 1 AND v IS NOT NULL) AS f1
    FROM j WHERE v IS NOT NULL WINDOW o AS (ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def result(metric: str, a: str | None, b: str | None, value: str, ctes: str = "", source: str = "f") -> str:
    """A query's row: names and the rounded value."""
    name = lambda x: f"'{x}'" if x else "CAST(NULL AS VARCHAR)"
    return f"{ctes} SELECT '{metric}' AS metric, {name(a)} AS column_a, {name(b)} AS column_b, round(CAST({value} AS DOUBLE), 8) AS value FROM {source}"


def cramers(table: str, a: str, b: str) -> str:
    """``v`` by the whole grid, for pairs of text."""
    return f"""(WITH t AS (SELECT coalesce(CAST({a} AS VARCHAR), 'nan') AS a, coalesce(CAST({b} AS VARCHAR), 'nan') AS b FROM {table}),
        g AS (SELECT x.a, y.b, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT a FROM t) x CROSS JOIN (SELECT DISTINCT b FROM t) y LEFT JOIN (SELECT a, b, count(*) AS n FROM t GROUP BY ALL) c ON c.a = x.a AND c.b = y.b),
        o AS (SELECT a, b, CASE WHEN n = 0 THEN 0.5 ELSE n END::DOUBLE AS o FROM g),
        m AS (SELECT o, sum(o) OVER (PARTITION BY a) * sum(o) OVER (PARTITION BY b) / sum(o) OVER () AS e FROM o)
        SELECT CASE WHEN (SELECT least(count(DISTINCT {a}), count(DISTINCT {b})) FROM {table}) = 1 THEN 0 ELSE
            sqrt(sum(pow(o - e, 2) / e) / (sum(o) * (SELECT least(count(DISTINCT a), count(DISTINCT b)) - 1 FROM o))) END FROM m)"""


def kendall(table: str, x: str, y: str) -> str:
    """tau-b by all pairs of rows."""
    return f"""(WITH t AS (SELECT row_number() OVER () AS i, {x} AS x, {y} AS y FROM {table} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)
        SELECT sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(sum(CASE WHEN a.x <> b.x THEN 1.0 ELSE 0 END) * sum(CASE WHEN a.y <> b.y THEN 1.0 ELSE 0 END)) FROM t a JOIN t b ON a.i < b.i)"""


def nominal(a: str, b: str) -> str:
    """CTEs that end in ``f(k, p, q)`` with missing values as a category."""
    return f"""WITH j AS ({two_sides(a, b)}),
    f AS (SELECT coalesce(CAST(v AS VARCHAR), 'nan') AS k, count(*) FILTER (side = 0) / (SELECT count(*)::DOUBLE FROM j WHERE side = 0) AS p,
                 count(*) FILTER (side = 1) / (SELECT count(*)::DOUBLE FROM j WHERE side = 1) AS q FROM j GROUP BY 1)"""


def kinds(table: str, numbers: Sequence[str] = (), narrow: Sequence[str] = (), texts: Sequence[str] = (), dates: Sequence[str] = ()) -> str:
    """Rows of column_check. narrow: numbers of 32 bits; numbers: of 64."""
    parts = []
    for c in (*numbers, *narrow):
        wide, kind = str(c in numbers).lower(), f"(SELECT CASE WHEN any_value(typeof({c})) IN ('DOUBLE', 'FLOAT') THEN 'float' ELSE 'int' END FROM {table})"
        parts.append(f"SELECT '{c}' AS column, {kind} AS inferred, n AS n_rows, m AS n_missing, u >= greatest(10, 2.5 * ln(n)) AS continuous, u < greatest(10, 2.5 * ln(n)) AS categorical, {wide} AS ordinal, u >= greatest(10, 2.5 * ln(n)) AS affine FROM (SELECT count(*) AS n, count(*) - count({c}) AS m, count(DISTINCT {c}) + (count({c}) < count(*))::INT AS u FROM {table})")
    for c in texts:
        parts.append(f"SELECT '{c}' AS column, 'object' AS inferred, count(*) AS n_rows, count(*) - count({c}) AS n_missing, false AS continuous, true AS categorical, false AS ordinal, false AS affine FROM {table}")
    for c in dates:
        parts.append(f"SELECT '{c}' AS column, 'datetime' AS inferred, count(*) AS n_rows, count(*) - count({c}) AS n_missing, false AS continuous, false AS categorical, true AS ordinal, true AS affine FROM {table}")
    return " UNION ALL ".join(parts)


def column_rows(parts: dict[str, str]) -> str:
    """(column, value) rows from one scalar expression or NULL per column."""
    return " UNION ALL ".join(f"SELECT '{c}' AS column, round(CAST(({v}) AS DOUBLE), 8) AS value" for c, v in parts.items())


def matrix_rows(names: Sequence[str], cells: dict[tuple[str, str], str]) -> str:
    """(column_a, column_b, value FLOAT) rows of a symmetric matrix; cells not given are NULL."""
    rows = []
    for a in names:
        for b in names:
            v = cells.get((a, b)) or cells.get((b, a)) or "NULL"
            rows.append(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(CAST({v} AS DOUBLE), 5) AS value")
    return " UNION ALL ".join(rows)
