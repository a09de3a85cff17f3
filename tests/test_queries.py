import re

import pytest

from loomery import queries as q
from tests.conftest import SMALL
from tests.oracle import assert_same, duck


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", list(q.QUERIES))
def test_query_matches_its_sql(spark, con, name):
    df = q.QUERIES[name](spark, SMALL)
    if name in q.ORACLES:
        assert_same(df, con, q.ORACLES[name])
    else:
        df.collect()


def test_plans(spark):
    """Single scans and anti joins, as meant."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(q.QUERIES["unpivot_basic"](spark, SMALL)).count("Scan") == 1
    from loomery.operators import checks

    lines, part = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("lineitem", "part"))
    assert "LeftAnti" in plan(checks.relationships(lines, "l_partkey", part, "p_partkey"))
    assert plan(checks.profile(part.select("p_partkey", "p_size"))).count("FileScan") == 1


ORDERED = {  # the order isn't among the subquery's columns
    "lateral": "SELECT c.c_custkey, o.o_orderkey FROM customer c, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) o",
    "offset": "SELECT c.c_custkey, o.k FROM customer c, LATERAL (SELECT o_orderkey + 1 AS k FROM orders WHERE o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2 OFFSET 1) o",
    "left": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) o ON true",
    "scalar": "SELECT c.c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS k FROM customer c",
    "inner": "SELECT c.c_custkey, o.n FROM customer c, LATERAL (SELECT COUNT(*) AS n, MAX(o_orderkey) AS k FROM (SELECT o_orderkey FROM orders WHERE o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t) o",
}


@pytest.mark.parametrize("name", list(ORDERED))
def test_ordered_limits_of_subqueries(spark, con, name):
    """The windows that stand for them have an order of their own: rows may arrive in any."""
    from loomery.operators.replan import mended

    for t in ("customer", "orders"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").createOrReplaceTempView(t)
    df = mended(spark.sql(ORDERED[name]))
    windows = re.findall(r"row_number\(\) windowspecdefinition\([^\n]*", df._jdf.queryExecution().optimizedPlan().toString())
    assert windows and all("o_totalprice" in w and "DESC" in w for w in windows)
    assert_same(df, con, ORDERED[name])


NUMBERED = {
    "two": "SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY NULLIF(o_orderstatus, 'F') DESC NULLS LAST, o_orderkey) AS a, ROW_NUMBER() OVER (ORDER BY NULLIF(o_orderstatus, 'F') NULLS FIRST, o_orderkey) AS b FROM orders",
    "same_order": "SELECT o_orderkey AS k, o_orderkey AS k2, ROW_NUMBER() OVER w AS a, ROW_NUMBER() OVER w + 1 AS b FROM orders WINDOW w AS (ORDER BY o_totalprice DESC, o_orderkey)",
    "grouped": "SELECT o_custkey, n, ROW_NUMBER() OVER (ORDER BY n DESC, o_custkey) AS r FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) t",
    "united": "SELECT 1 AS s, o_orderkey AS k, ROW_NUMBER() OVER (ORDER BY o_orderkey DESC) AS r FROM orders UNION ALL SELECT 2, c_custkey, ROW_NUMBER() OVER (ORDER BY c_custkey DESC) FROM customer",
    "joined": "SELECT a.k, a.r, b.r AS r2 FROM (SELECT o_orderkey AS k, ROW_NUMBER() OVER (ORDER BY o_orderkey) AS r FROM orders) a JOIN (SELECT o_orderkey AS k, ROW_NUMBER() OVER (ORDER BY o_orderkey DESC) AS r FROM orders) b ON a.k = b.k WHERE a.r % 2 = 0",
    "nothing": "SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderkey) AS r FROM orders WHERE o_orderkey < 0",
}


@pytest.mark.parametrize("name", list(NUMBERED))
def test_numbers_of_all_rows(spark, con, name, monkeypatch):
    """No window sorts all rows in one task."""
    from loomery.operators import replan

    monkeypatch.setattr(replan, "RANGE_BYTES", 500)
    for t in ("customer", "orders"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").createOrReplaceTempView(t)
    df = replan.mended(spark.sql(NUMBERED[name]))
    assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert_same(df, con, NUMBERED[name])
    assert df.rdd.getNumPartitions() > 4 or name in ("joined", "nothing")


def test_numbers_of_equal_rows(spark, monkeypatch):
    """Rows that are equal in the order are dealt too, and each number is given once."""
    from loomery.operators import replan

    monkeypatch.setattr(replan, "RANGE_BYTES", 500)
    spark.read.parquet(f"{SMALL}/orders.parquet").createOrReplaceTempView("orders")
    df = replan.mended(spark.sql("SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderkey < 0) AS r FROM orders"))
    sizes = df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) > 4 and max(sizes) < sum(sizes) / 2
    assert sorted(r.r for r in df.collect()) == list(range(1, sum(sizes) + 1))


def test_first_numbers_are_left_alone(spark):
    from loomery.operators.replan import mended

    spark.read.parquet(f"{SMALL}/orders.parquet").createOrReplaceTempView("orders")
    for sql in ("SELECT * FROM (SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 3", "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders"):
        df = spark.sql(sql)
        assert mended(df) is df
    assert mended(spark.sql("SELECT COUNT(*) AS n FROM (SELECT ROW_NUMBER() OVER (ORDER BY o_orderkey) AS r FROM orders)")).collect()[0].n == 1500


APART = {  # with the SQL that DuckDB runs; the sketch is exact for few values
    "whole": ("SELECT ABS(APPROX_COUNT_DISTINCT(l_partkey) - COUNT(DISTINCT l_partkey)) <= 0.15 * COUNT(DISTINCT l_partkey) AS near, APPROX_COUNT_DISTINCT(l_returnflag) AS few, COUNT(*) AS n FROM lineitem", "SELECT true AS near, COUNT(DISTINCT l_returnflag) AS few, COUNT(*) AS n FROM lineitem"),
    "grouped": ("SELECT NULLIF(l_returnflag, 'A') AS f, l_linestatus, COUNT(DISTINCT l_partkey) + MAX(l_quantity) AS d, COUNT(DISTINCT l_suppkey, l_linenumber) AS e, APPROX_COUNT_DISTINCT(l_linenumber) AS few, CONCAT(NULLIF(l_returnflag, 'A'), '!') AS g FROM lineitem GROUP BY NULLIF(l_returnflag, 'A'), l_linestatus HAVING COUNT(*) > 1",
                "SELECT NULLIF(l_returnflag, 'A') AS f, l_linestatus, COUNT(DISTINCT l_partkey) + MAX(l_quantity) AS d, COUNT(DISTINCT (l_suppkey, l_linenumber)) AS e, COUNT(DISTINCT l_linenumber) AS few, NULLIF(l_returnflag, 'A') || '!' AS g FROM lineitem GROUP BY 1, 2, 6 HAVING COUNT(*) > 1"),
    "rollup": ("SELECT l_returnflag, l_linestatus, COUNT(DISTINCT l_partkey) AS d, APPROX_COUNT_DISTINCT(l_linenumber) AS few FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", "SELECT l_returnflag, l_linestatus, COUNT(DISTINCT l_partkey) AS d, COUNT(DISTINCT l_linenumber) AS few FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    "filtered": ("SELECT COUNT(DISTINCT l_partkey) FILTER (WHERE l_quantity > 25) AS d, APPROX_COUNT_DISTINCT(l_linenumber) FILTER (WHERE l_quantity < 0) AS few FROM lineitem", "SELECT COUNT(DISTINCT l_partkey) FILTER (WHERE l_quantity > 25) AS d, CAST(0 AS BIGINT) AS few FROM lineitem"),
    "nothing": ("SELECT COUNT(DISTINCT l_partkey) AS d, APPROX_COUNT_DISTINCT(l_partkey) AS few FROM lineitem WHERE l_partkey < 0", "SELECT COUNT(DISTINCT l_partkey) AS d, CAST(0 AS BIGINT) AS few FROM lineitem WHERE l_partkey < 0"),
}


@pytest.mark.parametrize("name", list(APART))
def test_sketches_apart_from_distinct_values(spark, con, name):
    """No sketch is held for each distinct value: none is in an aggregate that is grouped by the values too."""
    from loomery.operators.replan import mended

    spark.read.parquet(f"{SMALL}/lineitem.parquet").createOrReplaceTempView("lineitem")
    df = mended(spark.sql(APART[name][0]))
    sketched = [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "approx_count_distinct" in line and "Aggregate(" in line]
    assert sketched and not any(re.search(r"keys=\[[^\]]*l_(part|supp)key|\bdistinct ", line) for line in sketched)
    assert_same(df, con, APART[name][1])


COUNTED = {
    "near": "SELECT p_partkey, COUNT(*) OVER (ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS n FROM part",
    "nulls": "SELECT p_partkey, p_size, COUNT(*) OVER (ORDER BY NULLIF(p_size, 9) DESC NULLS LAST RANGE BETWEEN CURRENT ROW AND 5 FOLLOWING) AS n FROM part",
    "none": "SELECT p_partkey, COUNT(*) OVER (ORDER BY p_size RANGE BETWEEN 100 FOLLOWING AND 200 FOLLOWING) AS n FROM part",
    "running": "SELECT p_partkey, COUNT(*) OVER (ORDER BY p_brand) AS n, COUNT(1) OVER (ORDER BY p_brand DESC) + 1 AS m FROM part",
    "joined": "SELECT a.p_partkey, a.n, b.n AS m FROM (SELECT p_partkey, COUNT(*) OVER (ORDER BY p_size) AS n FROM part) a JOIN (SELECT p_partkey, COUNT(*) OVER (ORDER BY p_size DESC) AS n FROM part) b ON a.p_partkey = b.p_partkey",
}


@pytest.mark.parametrize("name", list(COUNTED))
def test_counts_of_all_rows(spark, con, name):
    """The window runs over the values and their counts, not over all rows."""
    from loomery.operators.replan import mended

    spark.read.parquet(f"{SMALL}/part.parquet").createOrReplaceTempView("part")
    df = mended(spark.sql(COUNTED[name]))
    windows = re.findall(r"windowspecdefinition", df._jdf.queryExecution().optimizedPlan().toString())
    assert windows and "Window [count(1)" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert_same(df, con, COUNTED[name])


def test_other_windows_are_left_alone(spark):
    from loomery.operators.replan import mended

    spark.read.parquet(f"{SMALL}/part.parquet").createOrReplaceTempView("part")
    for over in ("COUNT(*) OVER (ORDER BY p_size ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)", "COUNT(NULLIF(p_size, 3)) OVER (ORDER BY p_size)", "RANK() OVER (ORDER BY p_size)"):
        df = spark.sql(f"SELECT p_partkey, {over} AS n FROM part")
        assert mended(df) is df
