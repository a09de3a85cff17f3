"""Queries that show each operator on the test tables, with the SQL that gives the same rows elsewhere.

Each builds a small project in memory, runs it, and reads back what it made. Databases are named after
the query and the data's folder, so queries can run side by side.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import checks, transforms
from .plans import codegen
from .plans.project import Project

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _sources(sql: str) -> str:
    """@orders in a query text stands for the table: a source in templates, a plain name elsewhere."""
    return re.sub(r"@(\w+)", r"{{ source('sf', '\1') }}", sql)


def project(spark: SparkSession, sf_dir: str, name: str, files: dict[str, str], settings: str = "", target: str | None = None, upstream: str | None = None, extra: str = "") -> Project:
    tag = f"{name}_{hashlib.md5(sf_dir.encode()).hexdigest()[:8]}"
    base = {
        "dbt_project.yml": f"name: shop\nprofile: shop\n{settings}",
        "profiles.yml": "shop:\n  target: dev\n  outputs:\n" + "".join(f"    {t}: {{project: {t}, dataset: {tag}, threads: 4}}\n" for t in ("dev", "prod")),
    }
    return Project(spark, base | {p: _sources(t) if p.endswith(".sql") else t for p, t in files.items()}, target=target, upstream=upstream, sources={"sf": sf_dir})


def query(oracle: str | None = None):
    """Register a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = re.sub(r"@(\w+)", r"\1", oracle)
        return f

    return add


def passed_through(name: str, sql: str, oracle: str | None = None) -> None:
    """A query whose model is plain SQL, as a view."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = project(spark, sf_dir, name, {"models/m.sql": "{{ config(materialized='view') }}" + sql})
        p.run("m")
        return p.table("m")

    run.__name__ = name
    query(oracle or sql)(run)


def built(name: str, files: dict[str, str], oracle: str, read: str = "m", settings: str = "", select: tuple[str, ...] = ()) -> None:
    """A query that runs a project and reads one of its models."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = project(spark, sf_dir, name, files, settings)
        p.run(*select)
        return p.table(read)

    run.__name__ = name
    query(oracle)(run)


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# -- the flagship: ephemeral staging, a loop, a table

MART = {
    "models/staging/stg_orders.sql": "{{ config(materialized='ephemeral', tags=['staging']) }}\nSELECT o_orderkey, o_custkey, o_orderpriority FROM @orders WHERE o_orderstatus <> 'P'",
    "models/staging/stg_lines.sql": "{{ config(materialized='ephemeral', tags=['staging']) }}\nSELECT l_orderkey, SUM(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS revenue FROM @lineitem GROUP BY l_orderkey",
    "models/marts/mart_segment_revenue.sql": """{{ config(tags=['daily']) }}
{%- set priorities = ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'] %}
SELECT c.c_mktsegment, COUNT(*) AS n_orders, CAST(SUM(l.revenue) AS DOUBLE) AS revenue
{%- for p in priorities %},
  SUM(CASE WHEN o.o_orderpriority = '{{ p }}' THEN 1 ELSE 0 END) AS n_{{ loop.index }}
{%- endfor %}
FROM @customer c JOIN {{ ref('stg_orders') }} o ON c.c_custkey = o.o_custkey JOIN {{ ref('stg_lines') }} l ON o.o_orderkey = l.l_orderkey
GROUP BY c.c_mktsegment""",
}
_MART_SQL = """
WITH o AS (SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderstatus <> 'P'),
l AS (SELECT l_orderkey, SUM(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS revenue FROM lineitem GROUP BY l_orderkey)
SELECT c_mktsegment, COUNT(*) AS n_orders, CAST(SUM(revenue) AS DOUBLE) AS revenue, """ + ", ".join(f"CAST(SUM(CASE WHEN o_orderpriority = '{p}' THEN 1 ELSE 0 END) AS BIGINT) AS n_{i + 1}" for i, p in enumerate(["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])) + """
FROM customer JOIN o ON c_custkey = o_custkey JOIN l ON o_orderkey = l_orderkey GROUP BY c_mktsegment"""
built("mart_segment_revenue", MART, _MART_SQL, "mart_segment_revenue")


def entry(spark: SparkSession) -> DataFrame:
    return QUERIES["mart_segment_revenue"](spark, "/root/testdata/sf0.001")


_Q1 = """SELECT l_returnflag, l_linestatus, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_base,
  CAST(SUM(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS sum_disc, COUNT(*) AS n FROM {lines} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"""
built("mart_q1", {"models/lines.sql": "{{ config(materialized='ephemeral') }} SELECT * FROM @lineitem", "models/m.sql": _Q1.format(lines="{{ ref('lines') }}")}, _Q1.format(lines="lineitem"))
_Q3 = """SELECT o_orderkey, o_orderdate, CAST(SUM(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM {c} JOIN {o} ON c_custkey = o_custkey JOIN {l} ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10"""
built("mart_q3", {"models/c.sql": "{{ config(materialized='ephemeral') }} SELECT c_custkey, c_mktsegment FROM @customer", "models/o.sql": "{{ config(materialized='view') }} SELECT o_orderkey, o_custkey, o_orderdate FROM @orders", "models/m.sql": _Q3.format(c="{{ ref('c') }}", o="{{ ref('o') }}", l="@lineitem")}, _Q3.format(c="customer", o="orders", l="lineitem"))
_Q5 = """SELECT n_name, CAST(SUM(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM @customer JOIN @orders ON c_custkey = o_custkey JOIN @lineitem ON l_orderkey = o_orderkey
JOIN @supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN @nation ON s_nationkey = n_nationkey JOIN @region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name"""
built("mart_q5", {"models/m.sql": _Q5}, _Q5)

# -- schema tests, as their templates render them


def _schema_test(name: str, model: str, column: str, test: str, oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = project(spark, sf_dir, name, {"models/m.sql": "{{ config(materialized='view') }}" + model, "models/parent.sql": "{{ config(materialized='view') }} SELECT * FROM @part WHERE p_size >= 25",
                                          "models/m.yml": f"version: 2\nmodels:\n- name: m\n  columns:\n  - name: {column}\n    tests:\n    - {test}\n"})
        p.run()
        found = next(n for n, f in p.files.items() if f.kind == "schema_test")
        return spark.sql(p.sql_of(found))

    run.__name__ = name
    query(oracle)(run)


_schema_test("test_unique_orders_cust", "SELECT * FROM @orders", "o_custkey", "unique", "SELECT count(*) AS num_errors FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(o_custkey) > 1)")
_schema_test("test_unique_pass", "SELECT * FROM @customer", "c_custkey", "unique", "SELECT count(*) AS num_errors FROM (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(c_custkey) > 1)")
_schema_test("test_not_null", "SELECT NULLIF(o_orderstatus, 'P') AS status FROM @orders", "status", "not_null", "SELECT count(*) AS num_errors FROM orders WHERE NULLIF(o_orderstatus, 'P') IS NULL")
_schema_test("test_accepted_values_quoted", "SELECT * FROM @orders", "o_orderstatus", "accepted_values: {values: [F, O]}", "SELECT count(*) AS num_errors FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
_schema_test("test_accepted_values_unquoted", "SELECT NULLIF(p_size, 9) AS size FROM @part", "size", "accepted_values: {values: [1, 2, 3, 4], quote: false}", "SELECT count(*) AS num_errors FROM part WHERE NULLIF(p_size, 9) NOT IN (1, 2, 3, 4)")
_schema_test("test_relationships", "SELECT * FROM @lineitem", "l_partkey", "relationships: {to: \"source('sf', 'part')\", field: p_partkey}", "SELECT count(*) AS num_errors FROM lineitem LEFT JOIN part ON l_partkey = p_partkey WHERE p_partkey IS NULL AND l_partkey IS NOT NULL")
_schema_test("test_relationships_broken", "SELECT * FROM @lineitem", "l_partkey", "relationships: {to: \"ref('parent')\", field: p_partkey}", "SELECT count(*) AS num_errors FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size >= 25) ON l_partkey = p_partkey WHERE p_partkey IS NULL AND l_partkey IS NOT NULL")


@query("SELECT 'dear' AS name, 'failure' AS status, count(*) AS failures FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT 'unique_m__o_orderkey_0', CASE WHEN count(*) = 0 THEN 'success' ELSE 'failure' END, count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(o_orderkey) > 1)")
def data_test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = project(spark, sf_dir, "data_test_rows", {"models/m.sql": "{{ config(materialized='view') }} SELECT * FROM @orders", "tests/dear.sql": "SELECT * FROM {{ ref('m') }} WHERE o_totalprice > 400000",
                                                  "models/m.yml": "version: 2\nmodels:\n- name: m\n  columns:\n  - name: o_orderkey\n    tests: [unique]\n"})
    p.run()
    return p.results_frame(p.test())


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, 'not_null' AS test, count(*) FILTER ({c} IS NULL) AS num_errors, count(*) FILTER ({c} IS NULL) = 0 AS passed FROM orders UNION ALL SELECT '{c}', 'unique', count(*), count(*) = 0 FROM (SELECT {c} FROM orders WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1) AS r"
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")))
def testgen_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.profile(spark.read.parquet(f"{sf_dir}/orders.parquet"))


# -- generators

built("column_values_topk", {"models/m.sql": "{% set vs = dbt_utils.get_column_values(source('sf', 'orders'), 'o_orderpriority', 3) %}{% if not execute %}SELECT 1 AS rank, '' AS v{% endif %}{% for v in vs %}SELECT {{ loop.index }} AS rank, '{{ v }}' AS v{% if not loop.last %} UNION ALL {% endif %}{% endfor %}"},
      "SELECT CAST(row_number() OVER (ORDER BY n DESC, v) AS INTEGER) AS rank, v FROM (SELECT o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, v LIMIT 3)")
built("pivot_sum", {"models/m.sql": "SELECT l_linestatus, {{ dbt_utils.pivot('l_returnflag', ['A', 'N', 'R']) }} FROM @lineitem {{ dbt_utils.group_by(1) }}"},
      "SELECT l_linestatus, " + ", ".join(f"CAST(SUM(CASE WHEN l_returnflag = '{v}' THEN 1 ELSE 0 END) AS BIGINT) AS \"{v}\"" for v in "ANR") + " FROM lineitem GROUP BY 1")
built("pivot_custom", {"models/m.sql": "SELECT l_linestatus, {{ dbt_utils.pivot('l_returnflag', ['A', 'R'], agg='max', cmp='<>', prefix='not ', suffix=' max', then_value='l_quantity', else_value=0) }} FROM @lineitem GROUP BY 1"},
      "SELECT l_linestatus, " + ", ".join(f"MAX(CASE WHEN l_returnflag <> '{v}' THEN l_quantity ELSE 0 END) AS \"not {v} max\"" for v in "AR") + " FROM lineitem GROUP BY 1")


@query("SELECT l_linestatus, " + ", ".join(f"CAST(SUM(CASE WHEN l_returnflag = '{v}' THEN 1 ELSE 0 END) AS BIGINT) AS n_{v}" for v in "ANR") + " FROM lineitem GROUP BY 1")
def pivot_dataframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_linestatus").agg(*transforms.pivot_columns("l_returnflag", ["A", "N", "R"], prefix="n_"))


_UNPIVOT = ["p_name", "p_brand", "p_type", "p_size"]
built("unpivot_basic", {"models/m.sql": "{{ dbt_utils.unpivot(source('sf', 'part'), exclude=['p_partkey'], remove=['p_retailprice'], field_name='f', value_name='v') }}"},
      " UNION ALL ".join(f"SELECT p_partkey, '{c}' AS f, CAST({c} AS VARCHAR) AS v FROM part" for c in _UNPIVOT))
built("unpivot_exclude_remove", {"models/m.sql": "{{ dbt_utils.unpivot(source('sf', 'customer'), cast_to='varchar', exclude=['C_CUSTKEY', 'c_name'], remove=['C_ACCTBAL']) }}"},
      " UNION ALL ".join(f"SELECT c_custkey, c_name, '{c}' AS field_name, CAST({c} AS VARCHAR) AS value FROM customer" for c in ("c_nationkey", "c_mktsegment")))


@query(" UNION ALL ".join(f"SELECT p_partkey, '{c}' AS f, CAST({c} AS VARCHAR) AS v FROM part" for c in _UNPIVOT))
def unpivot_dataframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.unpivot(spark.read.parquet(f"{sf_dir}/part.parquet"), "varchar", ["p_partkey"], ["p_retailprice"], "f", "v")


built("union_all_tables", {"models/a.sql": "{{ config(materialized='ephemeral') }} SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation FROM @customer", "models/b.sql": "{{ config(materialized='ephemeral') }} SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation FROM @supplier",
                           "models/m.sql": "SELECT * FROM {{ dbt_utils.union_all_tables([ref('a'), ref('b')], ['id', 'name']) }} AS u"},
      "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
built("group_by_ordinals", {"models/m.sql": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, MAX(l_quantity) AS most FROM @lineitem {{ dbt_utils.group_by(n=2) }}"}, "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, MAX(l_quantity) AS most FROM lineitem GROUP BY 1, 2")
built("columns_in_relation", {"models/o.sql": "{{ config(materialized='view') }} SELECT * FROM @orders", "models/m.sql": "{% set cols = adapter.get_columns_in_relation(ref('o')) %}{% if not execute %}SELECT 1{% endif %}{% for c in cols %}SELECT '{{ c.column }}' AS name, '{{ c.data_type }}' AS data_type{% if not loop.last %} UNION ALL {% endif %}{% endfor %}"},
      "SELECT * FROM (VALUES ('o_orderkey', 'bigint'), ('o_custkey', 'bigint'), ('o_orderstatus', 'string'), ('o_totalprice', 'double'), ('o_orderdate', 'timestamp_ntz'), ('o_orderpriority', 'string')) t(name, data_type)")
built("dynamic_columns", {"models/m.sql": "{%- set vs = dbt_utils.get_column_values(source('sf', 'orders'), 'o_orderstatus') %}SELECT o_orderpriority{% for v in vs %}, COUNT(CASE WHEN o_orderstatus = '{{ v }}' THEN 1 END) AS n_{{ v | lower }}{% endfor %} FROM @orders GROUP BY 1"},
      "SELECT o_orderpriority, " + ", ".join(f"COUNT(CASE WHEN o_orderstatus = '{v}' THEN 1 END) AS n_{v.lower()}" for v in "FOP") + " FROM orders GROUP BY 1")
built("get_relation_name", {"models/o.sql": "{{ config(materialized='view') }} SELECT * FROM @orders", "models/m.sql": "{% set r = adapter.get_relation(database='spark_catalog', schema=target.database, identifier='o') %}-- after {{ ref('o') }}\nSELECT COUNT(*) AS n FROM {{ r }}"}, "SELECT count(*) AS n FROM orders")

# -- inlining and materializations

built("ephemeral_chain", {"models/a.sql": "{{ config(materialized='ephemeral') }} SELECT * FROM @orders WHERE o_totalprice > 100000", "models/b.sql": "{{ config(materialized='ephemeral') }} SELECT o_custkey, COUNT(*) AS n FROM {{ ref('a') }} GROUP BY 1", "models/m.sql": "SELECT n, COUNT(*) AS customers FROM {{ ref('b') }} GROUP BY 1"},
      "SELECT n, COUNT(*) AS customers FROM (SELECT o_custkey, COUNT(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1) GROUP BY 1")
built("ephemeral_diamond", {"models/a.sql": "{{ config(materialized='ephemeral') }} SELECT * FROM @orders", "models/b.sql": "{{ config(materialized='ephemeral') }} SELECT o_custkey, COUNT(*) AS n FROM {{ ref('a') }} GROUP BY 1", "models/c.sql": "{{ config(materialized='ephemeral') }} SELECT o_custkey, MAX(o_totalprice) AS most FROM {{ ref('a') }} GROUP BY 1",
                            "models/m.sql": "SELECT b.o_custkey, n, most FROM {{ ref('b') }} b JOIN {{ ref('c') }} c ON b.o_custkey = c.o_custkey"},
      "SELECT o_custkey, COUNT(*) AS n, MAX(o_totalprice) AS most FROM orders GROUP BY 1")
built("udf_prefix", {"models/m.sql": "{{ config(udf='''CREATE TEMPORARY FUNCTION cents(x DOUBLE) RETURNS BIGINT RETURN CAST(ROUND(x * 100) AS BIGINT);''') }}SELECT p_partkey, cents(p_retailprice) AS c FROM @part"}, "SELECT p_partkey, CAST(ROUND(p_retailprice * 100) AS BIGINT) AS c FROM part")
for _m in ("table", "view", "incremental", "project_sharded_table"):
    built(f"mat_{_m.split('_')[-2] if '_' in _m else _m}", {"models/up.sql": "SELECT n_nationkey, n_name, n_regionkey FROM @nation", "models/m.sql": f"{{{{ config(materialized='{_m}') }}}}SELECT r_name, n_name FROM {{{{ ref('up') }}}} JOIN @region ON n_regionkey = r_regionkey"},
          "SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey")


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 10 THEN 'new' ELSE 'old' END AS origin FROM nation")
def mat_incremental_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = "{{ config(materialized='incremental', append=true, unique_key='n_nationkey') }}{% if is_incremental() %}SELECT n_nationkey, 'new' AS origin FROM @nation WHERE n_nationkey < 10{% else %}SELECT n_nationkey, 'old' AS origin FROM @nation{% endif %}"
    p = project(spark, sf_dir, "mat_incremental_merge", {"models/m.sql": model})
    p._prepare({p.target_of(p.files["m"]).database})
    spark.sql(f"DROP TABLE IF EXISTS {p.relation(p.files['m'])}")
    p.run()
    project(spark, sf_dir, "mat_incremental_merge", {"models/m.sql": model}).run()
    return p.table("m")


@query("SELECT n_nationkey, n_nationkey + 1 AS runs FROM nation WHERE n_nationkey < 3")
def self_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = {"models/m.sql": "SELECT n_nationkey, n_nationkey AS runs FROM @nation WHERE n_nationkey < 3"}
    p = project(spark, sf_dir, "self_ref", first)
    p.run()
    p = project(spark, sf_dir, "self_ref", {"models/m.sql": "SELECT n_nationkey, runs + 1 AS runs FROM {{ ref('m') }}"})
    p.run()
    return p.table("m")


@query("SELECT 'a;b' AS v, 2 AS n")
def hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = project(spark, sf_dir, "hooks", {"models/m.sql": "{{ config(pre_hook=\"DROP VIEW IF EXISTS {{ this.schema }}.hooked\", post_hook=[\"CREATE OR REPLACE VIEW {{ this.schema }}.hooked AS SELECT v, n + 1 AS n FROM {{ this }}\"]) }}SELECT 'a;b' AS v, 1 AS n"})
    p.run()
    return spark.table(f"{p.target_of(p.files['m']).database}.hooked")


def _csv(spark: SparkSession, sf_dir: str) -> str:
    rows = spark.read.parquet(f"{sf_dir}/region.parquet").orderBy("r_regionkey").collect()
    return "id,region name,rate\n" + "".join(f"{r[0]},\"{r[1]}, here\",{r[0]}.5\n" for r in rows)


@query("SELECT CAST(r_regionkey AS VARCHAR) AS id, r_name || ', here' AS \"region name\", CAST(r_regionkey + 0.5 AS DOUBLE) AS rate FROM region")
def seed_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = project(spark, sf_dir, "seed_typed", {"data/geo/regions.csv": _csv(spark, sf_dir), "models/m.sql": "SELECT * FROM {{ ref('regions') }}"}, "seeds:\n  shop:\n    enabled: true\n    geo:\n      column_types: {id: string, rate: float}\n")
    p.seed()
    p.run()
    return p.table("m")


@query("SELECT CAST(r_regionkey AS BIGINT) AS id, r_name || ', here' AS \"region name\", CAST(r_regionkey + 0.5 AS DOUBLE) AS rate FROM region")
def seed_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = project(spark, sf_dir, "seed_inferred", {"data/regions.csv": _csv(spark, sf_dir)})
    p.seed()
    return spark.table(str(p.seed_relation("regions")))


@query("SELECT 'prod' AS place, count(*) AS n FROM nation")
def deferred_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = {"models/up.sql": "SELECT '{{ target.name }}' AS place, n_nationkey FROM @nation", "models/m.sql": "SELECT place, COUNT(*) AS n FROM {{ ref('up') }} GROUP BY 1"}
    project(spark, sf_dir, "deferred_upstream", files, target="prod").run("up")
    p = project(spark, sf_dir, "deferred_upstream", files, target="dev", upstream="prod")
    p.run("m")
    return p.table("m")


@query("SELECT 'm' AS model, true AS moved UNION ALL SELECT 'plain', false")
def project_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = project(spark, sf_dir, "project_substitution", {"models/g/m.sql": "{{ config(tags=['secret']) }} SELECT 1 AS x", "models/g/plain.sql": "SELECT 2 AS x",
                "loomery.yml": "model-groups:\n  g:\n    dev: {project: dev, project_tag_substitutions: {secret: vault}}\n"})
    p.run()
    return frame(spark, [(n, spark.catalog.tableExists(str(p.relation(p.files[n]))) and p.relation(p.files[n]).schema.startswith("vault__")) for n in ("m", "plain")], "model string, moved boolean")


# -- selection

_CHAIN = {"models/a.sql": "{{ config(tags=['x']) }} SELECT 1 AS k", "models/b.sql": "SELECT k FROM {{ ref('a') }}", "models/c.sql": "{{ config(tags=['x']) }} SELECT k FROM {{ ref('b') }}", "models/d.sql": "SELECT k FROM {{ ref('a') }}", "models/e.sql": "SELECT c.k FROM {{ ref('c') }} c JOIN {{ ref('d') }} d ON c.k = d.k"}
for _name, _sel, _rows in (("select_plus_up", ["+c"], [("a", 0), ("b", 1), ("c", 2)]), ("select_plus_down", ["b+"], [("b", 0), ("c", 1), ("e", 2)]), ("select_plus_both", ["+c+"], [("a", 0), ("b", 1), ("c", 2), ("e", 3)]),
                           ("select_tag", ["tag:x"], [("a", 0), ("c", 0)]), ("select_many", ["a", "d"], [("a", 0), ("d", 1)]), ("dag_order", [], [("a", 0), ("b", 1), ("c", 2), ("d", 1), ("e", 3)])):

    def _selected(spark: SparkSession, sf_dir: str, name: str = _name, sel: list[str] = _sel) -> DataFrame:
        return frame(spark, sorted(project(spark, sf_dir, name, _CHAIN).select(*sel).depth().items()), "node string, depth int")

    _selected.__name__ = _name
    query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {d})" for n, d in _rows) + ") t(node, depth)")(_selected)

# -- templates, rendered and run

_RENDERED = {
    "tmpl_for_if": ("{% for x in [1, 2, 3] %}{% if x is odd %}SELECT {{ x }} AS x, '{{ loop.index }}' AS i{% if not loop.last %} UNION ALL {% endif %}{% endif %}{% endfor %}", "SELECT 1 AS x, '1' AS i UNION ALL SELECT 3, '3'"),
    "tmpl_macro_call": ("{% macro wrap(a, b='z') %}{{ caller() }} '{{ a }}{{ b }}'{% endmacro %}{% call wrap('q') %}SELECT{% endcall %} AS v", "SELECT 'qz' AS v"),
    "tmpl_filters": ("SELECT '{{ 'aBc' | upper }}' AS u, '{{ 'aBc' | lower }}' AS l, '{{ nothing | default('d') }}' AS d, '{{ 'axa' | replace('a', 'b') }}' AS r", "SELECT 'ABC' AS u, 'abc' AS l, 'd' AS d, 'bxb' AS r"),
    "tmpl_maths": ("SELECT CAST({{ 2 + 3 * 4 - 6 / 4 }} AS DOUBLE) AS a, {{ 2 ** 3 }} AS b, {{ -(1 + 2) * 3 }} AS c", "SELECT CAST(12.5 AS DOUBLE) AS a, 8 AS b, -9 AS c"),
    "tmpl_is_tests": ("SELECT '{{ 4 is even }}{{ 4 is divisibleby(3) }}{{ x is defined }}{{ none is none }}{{ [1] is sequence }}{{ {'a': 1} is mapping }}{{ 2.5 is float }}{{ 'a' in 'cat' }}' AS v", "SELECT 'TRUEFALSEFALSETRUETRUETRUETRUETRUE' AS v"),
    "tmpl_scoping": ("{% set x = 1 %}{% for y in [1, 2] %}{% set x = y + 10 %}{% endfor %}{% set z %}{{ x }}!{% endset %}SELECT {{ x }} AS x, '{{ z }}' AS z", "SELECT 1 AS x, '1!' AS z"),
    "tmpl_bool_precedence": ("SELECT '{{ false and false or true }}{{ true or false and false }}{{ true and false or false }}' AS a, '{{ not false and (1 == 1) }}' AS b, '{{ 'y' if 3 > 2 else 'n' }}' AS c", "SELECT 'TRUETRUEFALSE' AS a, 'TRUE' AS b, 'y' AS c"),
    "tmpl_maps_lists": ("{% set m = {'b': [1, 2], 'a': {'k': 'v'}} %}{% for k, v in m.items() %}SELECT '{{ k }}' AS k, '{{ v[1] if v is sequence and v is not mapping else v.k }}' AS v{% if not loop.last %} UNION ALL {% endif %}{% endfor %}", "SELECT 'a' AS k, 'v' AS v UNION ALL SELECT 'b', '2'"),
    "tmpl_var_env": ("SELECT '{{ var('colour', 'none') }}' AS a, '{{ var('absent', 'none') }}' AS b, '{{ env_var('LOOMERY_ABSENT', 'e') }}' AS c, '{{ project_name }}' AS d", "SELECT 'red' AS a, 'none' AS b, 'e' AS c, 'shop' AS d"),
}
for _name, (_model, _sql) in _RENDERED.items():
    built(_name, {"models/m.sql": _model}, _sql, settings="vars: {colour: red}\n")
built("tmpl_macro_file", {"macros/cents.sql": "{% macro cents(c, digits=2) %}CAST(ROUND({{ c }} * 100, {{ digits }}) AS BIGINT){% endmacro %}", "models/m.sql": "SELECT p_partkey, {{ cents('p_retailprice', 0) }} AS c FROM @part"}, "SELECT p_partkey, CAST(ROUND(p_retailprice * 100) AS BIGINT) AS c FROM part")


@query("SELECT * FROM (VALUES ('id', 'number'), ('name', 'string'), ('at', 'time'), ('day', 'date'), ('ok', 'yesno')) t(column_name, kind)")
def codegen_bi_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.sql("SELECT 1 AS id, 'a' AS name, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS at, DATE '2024-01-01' AS day, true AS ok")
    return frame(spark, codegen.bi_types(df), "column_name string, kind string")


@query("SELECT * FROM (VALUES ('o_orderpriority', 'added'), ('o_orderkey', 'kept'), ('gone', 'dropped'), ('o_custkey', 'added'), ('o_orderstatus', 'added'), ('o_totalprice', 'added'), ('o_orderdate', 'added')) t(column_name, action)")
def schema_gen_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = {"name": "orders", "columns": [{"name": "o_orderkey", "description": "key"}, {"name": "gone"}]}
    return frame(spark, codegen.column_changes(old, spark.read.parquet(f"{sf_dir}/orders.parquet").columns), "column_name string, action string")


# -- plain SQL, passed through

passed_through("pt_join_inner", "SELECT n_name, r_name FROM @nation JOIN @region ON n_regionkey = r_regionkey")
passed_through("pt_join_left", "SELECT c_custkey, o_orderkey FROM @customer LEFT JOIN (SELECT * FROM @orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey")
passed_through("pt_join_right", "SELECT c.c_custkey, o_orderkey FROM (SELECT * FROM @customer WHERE c_acctbal > 5000) c RIGHT JOIN @orders ON c.c_custkey = o_custkey")
passed_through("pt_join_full", "SELECT c_custkey, s_suppkey FROM @customer FULL OUTER JOIN @supplier ON c_custkey = s_suppkey + 50")
passed_through("pt_join_cross", "SELECT r.r_name, n.n_name FROM @region r CROSS JOIN @nation n")
passed_through("pt_join_semi", "SELECT c_custkey FROM @customer c LEFT SEMI JOIN @orders o ON c.c_custkey = o.o_custkey", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
passed_through("pt_join_anti", "SELECT p_partkey FROM @part LEFT ANTI JOIN (SELECT * FROM @lineitem WHERE l_quantity > 48) l ON p_partkey = l.l_partkey", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
passed_through("pt_join_using", "SELECT k, a.n AS n, b.r AS r FROM (SELECT n_regionkey AS k, n_name AS n FROM @nation) a JOIN (SELECT r_regionkey AS k, r_name AS r FROM @region) b USING (k)")
passed_through("pt_join_theta", "SELECT a.n_name AS a, b.n_name AS b FROM @nation a JOIN @nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
passed_through("pt_join_range", """WITH e AS (SELECT event_id, user_id, ts FROM @events WHERE event_type = 'purchase'), s AS (SELECT user_id, ts FROM @events WHERE event_type = 'signup')
SELECT e.event_id, COUNT(*) AS n FROM e JOIN s ON e.user_id = s.user_id AND s.ts BETWEEN e.ts - INTERVAL '2' DAY AND e.ts GROUP BY e.event_id""")
passed_through("pt_join_asof", """WITH u AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'signup' THEN event_id END AS signup, event_type FROM @events),
w AS (SELECT *, LAST_VALUE(signup) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS latest FROM u) SELECT event_id, latest FROM w WHERE event_type = 'purchase'""",
               """WITH u AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'signup' THEN event_id END AS signup, event_type FROM events),
w AS (SELECT *, LAST_VALUE(signup IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS latest FROM u) SELECT event_id, latest FROM w WHERE event_type = 'purchase'""")
passed_through("pt_subqueries", "SELECT c_custkey, (SELECT MAX(o_totalprice) FROM @orders WHERE o_custkey = c_custkey) AS most FROM @customer WHERE EXISTS (SELECT 1 FROM @orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AND c_acctbal > (SELECT AVG(c_acctbal) FROM @customer)")
passed_through("pt_agg_basic", "SELECT o_orderstatus, COUNT(*) AS n, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi, COUNT(CASE WHEN o_totalprice > 200000 THEN 1 END) AS dear FROM @orders GROUP BY o_orderstatus HAVING COUNT(*) > 1")
passed_through("pt_agg_stats", "SELECT l_returnflag, ROUND(STDDEV_SAMP(l_quantity), 4) AS sd, ROUND(VAR_POP(l_quantity), 4) AS vp, ROUND(CORR(l_quantity, l_extendedprice), 4) AS c, ROUND(COVAR_SAMP(l_quantity, l_discount), 4) AS cv FROM @lineitem GROUP BY l_returnflag")
passed_through("pt_agg_distinct", "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS s, COUNT(DISTINCT l_partkey) AS p FROM @lineitem GROUP BY l_returnflag")
passed_through("pt_agg_rollup", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM @lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
passed_through("pt_agg_cube", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM @lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
passed_through("pt_agg_grouping_sets", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM @lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
passed_through("pt_agg_collect", "SELECT r_name, ARRAY_JOIN(SORT_ARRAY(COLLECT_LIST(n_name)), ',') AS names FROM @nation JOIN @region ON n_regionkey = r_regionkey GROUP BY r_name", "SELECT r_name, STRING_AGG(n_name, ',' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
passed_through("pt_window_rank", "SELECT o_orderkey, ROW_NUMBER() OVER w AS rn, RANK() OVER w AS rk, DENSE_RANK() OVER w AS dr, NTILE(4) OVER w AS nt FROM @orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey)",
               "SELECT o_orderkey, CAST(ROW_NUMBER() OVER w AS INTEGER) AS rn, CAST(RANK() OVER w AS INTEGER) AS rk, CAST(DENSE_RANK() OVER w AS INTEGER) AS dr, CAST(NTILE(4) OVER w AS INTEGER) AS nt FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey)")
passed_through("pt_window_lag", "SELECT event_id, LAG(event_id) OVER w AS before, LEAD(event_id, 2) OVER w AS after, FIRST_VALUE(event_id) OVER w AS first FROM @events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
passed_through("pt_window_frame", "SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n, MAX(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM @events")
passed_through("pt_ranked_rows", "SELECT user_id, event_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM @events) t WHERE rn = 1", "SELECT user_id, event_id FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1")
passed_through("pt_time_bucket", "SELECT window.start AS start, event_type, COUNT(*) AS n FROM @events GROUP BY window(ts, '1 day'), event_type", "SELECT date_trunc('day', ts) AS start, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2")
passed_through("pt_gaps", """WITH g AS (SELECT *, CASE WHEN ts > LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '12' HOUR THEN 1 ELSE 0 END AS new FROM @events),
s AS (SELECT user_id, SUM(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g) SELECT user_id, CAST(k AS BIGINT) AS k, COUNT(*) AS n FROM s GROUP BY user_id, k""")
passed_through("pt_topk", "SELECT o_orderkey, o_totalprice FROM @orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
passed_through("pt_offset", "SELECT o_orderkey FROM @orders ORDER BY o_orderkey LIMIT 5 OFFSET 7")
passed_through("pt_setops", "(SELECT n_nationkey AS k FROM @nation WHERE n_nationkey < 10 UNION SELECT n_regionkey FROM @nation) EXCEPT (SELECT r_regionkey FROM @region INTERSECT SELECT n_nationkey FROM @nation WHERE n_nationkey > 2)")
passed_through("pt_setops_all", "SELECT n_regionkey AS k FROM @nation EXCEPT ALL SELECT r_regionkey FROM @region")
passed_through("pt_scalar_string", "SELECT c_custkey, UPPER(c_name) AS u, SUBSTRING(c_name, 2, 4) AS s, LENGTH(c_name) AS n, REPLACE(c_mktsegment, 'A', '_') AS r, LPAD(CAST(c_custkey AS STRING), 6, '0') AS p, CONCAT(c_name, '-', c_mktsegment) AS c FROM @customer",
               "SELECT c_custkey, UPPER(c_name) AS u, SUBSTRING(c_name, 2, 4) AS s, CAST(LENGTH(c_name) AS INTEGER) AS n, REPLACE(c_mktsegment, 'A', '_') AS r, LPAD(CAST(c_custkey AS VARCHAR), 6, '0') AS p, CONCAT(c_name, '-', c_mktsegment) AS c FROM customer")
passed_through("pt_scalar_regexp", "SELECT p_partkey, REGEXP_REPLACE(p_type, '[AEIOU]', '*') AS r, REGEXP_EXTRACT(p_brand, '([0-9]+)', 1) AS d, p_name LIKE '%a%' AS l FROM @part", "SELECT p_partkey, REGEXP_REPLACE(p_type, '[AEIOU]', '*', 'g') AS r, REGEXP_EXTRACT(p_brand, '([0-9]+)', 1) AS d, p_name LIKE '%a%' AS l FROM part")
passed_through("pt_scalar_date", "SELECT o_orderkey, YEAR(o_orderdate) AS y, MONTH(o_orderdate) AS m, DATE_TRUNC('MONTH', o_orderdate) AS t, DATEDIFF(DATE '1999-01-01', CAST(o_orderdate AS DATE)) AS d, DATE_FORMAT(o_orderdate, 'yyyy-MM') AS f FROM @orders",
               "SELECT o_orderkey, CAST(YEAR(o_orderdate) AS INTEGER) AS y, CAST(MONTH(o_orderdate) AS INTEGER) AS m, DATE_TRUNC('month', o_orderdate) AS t, CAST(DATE '1999-01-01' - CAST(o_orderdate AS DATE) AS INTEGER) AS d, STRFTIME(o_orderdate, '%Y-%m') AS f FROM orders")
passed_through("pt_scalar_math", "SELECT p_partkey, ABS(p_size - 25) AS a, p_size % 7 AS m, CAST(FLOOR(p_retailprice) AS BIGINT) AS f, ROUND(SQRT(p_size), 4) AS s, GREATEST(p_size, 10) AS g, TRY_DIVIDE(p_size, p_size - p_size) AS z FROM @part",
               "SELECT p_partkey, ABS(p_size - 25) AS a, p_size % 7 AS m, CAST(FLOOR(p_retailprice) AS BIGINT) AS f, ROUND(SQRT(p_size), 4) AS s, GREATEST(p_size, 10) AS g, CAST(NULL AS DOUBLE) AS z FROM part")
passed_through("pt_scalar_array", "SELECT c_custkey, SIZE(a) AS n, a[0] AS f, ARRAY_CONTAINS(a, 'BUILDING') AS b, ARRAY_JOIN(REVERSE(a), '/') AS j FROM (SELECT c_custkey, ARRAY(c_mktsegment, c_name) AS a FROM @customer) t",
               "SELECT c_custkey, CAST(len(a) AS INTEGER) AS n, a[1] AS f, list_contains(a, 'BUILDING') AS b, array_to_string(list_reverse(a), '/') AS j FROM (SELECT c_custkey, [c_mktsegment, c_name] AS a FROM customer) t")
passed_through("pt_scalar_explode", "SELECT c_custkey, x FROM @customer LATERAL VIEW EXPLODE(SPLIT(c_name, '#')) e AS x", "SELECT c_custkey, unnest(string_split(c_name, '#')) AS x FROM customer")
passed_through("pt_scalar_json", "SELECT event_id, CAST(GET_JSON_OBJECT(props, '$.k') AS INT) AS k FROM @events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
passed_through("pt_scalar_map", "SELECT event_id, m['v'] AS v, SIZE(MAP_KEYS(m)) AS n FROM (SELECT event_id, MAP('v', event_type, 'w', 'x') AS m FROM @events) t", "SELECT event_id, event_type AS v, CAST(2 AS INTEGER) AS n FROM events")
passed_through("pt_scalar_conditional", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS c, IF(o_totalprice > 100000, 'y', 'n') AS i, COALESCE(NULLIF(o_orderstatus, 'F'), '?') AS n, TRY_CAST(o_orderpriority AS INT) AS t FROM @orders")
passed_through("pt_scalar_hash", "SELECT c_custkey, MD5(c_name) AS m, SHA2(c_name, 256) AS s, c_nationkey & 3 AS b FROM @customer", "SELECT c_custkey, MD5(c_name) AS m, SHA256(c_name) AS s, c_nationkey & 3 AS b FROM customer")
passed_through("pt_pivot", "SELECT * FROM (SELECT l_linestatus, l_returnflag, l_linenumber FROM @lineitem) PIVOT (COUNT(l_linenumber) FOR l_returnflag IN ('A' AS a, 'R' AS r))", "SELECT l_linestatus, COUNT(*) FILTER (l_returnflag = 'A') AS a, COUNT(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1")
passed_through("pt_sampling_rows", "SELECT (SELECT COUNT(*) FROM @orders TABLESAMPLE (7 ROWS)) AS seven, (SELECT COUNT(*) FROM @orders TABLESAMPLE (100 PERCENT)) AS whole, (SELECT COUNT(*) FROM @orders TABLESAMPLE (0 PERCENT)) AS none", "SELECT CAST(7 AS BIGINT) AS seven, (SELECT COUNT(*) FROM orders) AS whole, CAST(0 AS BIGINT) AS none")
passed_through("pt_sampling_repeats", """SELECT (SELECT SUM(o_orderkey) FROM @orders TABLESAMPLE (50 PERCENT) REPEATABLE (3)) = (SELECT SUM(o_orderkey) FROM @orders TABLESAMPLE (50 PERCENT) REPEATABLE (3)) AS same,
  (SELECT COUNT(*) FROM @orders TABLESAMPLE (50 PERCENT) REPEATABLE (3)) BETWEEN (SELECT 0.4 * COUNT(*) FROM @orders) AND (SELECT 0.6 * COUNT(*) FROM @orders) AS about_half""", "SELECT true AS same, true AS about_half")
passed_through("pt_window_shares", "SELECT o_orderkey, ROUND(PERCENT_RANK() OVER w, 6) AS p, ROUND(CUME_DIST() OVER w, 6) AS c, NTH_VALUE(o_orderkey, 2) OVER w AS second FROM @orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)")
passed_through("pt_window_range", "SELECT p_partkey, COUNT(*) OVER (ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS n FROM @part")
passed_through("pt_nulls_order", "SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY NULLIF(o_orderstatus, 'F') DESC NULLS LAST, o_orderkey) AS a, ROW_NUMBER() OVER (ORDER BY NULLIF(o_orderstatus, 'F') NULLS FIRST, o_orderkey) AS b FROM @orders",
               "SELECT o_orderkey, CAST(ROW_NUMBER() OVER (ORDER BY NULLIF(o_orderstatus, 'F') DESC NULLS LAST, o_orderkey) AS INTEGER) AS a, CAST(ROW_NUMBER() OVER (ORDER BY NULLIF(o_orderstatus, 'F') NULLS FIRST, o_orderkey) AS INTEGER) AS b FROM orders")
passed_through("pt_agg_quantiles", "SELECT l_returnflag, PERCENTILE(l_quantity, 0.25) AS q, MEDIAN(l_quantity) AS m FROM @lineitem GROUP BY l_returnflag", "SELECT l_returnflag, QUANTILE_CONT(l_quantity, 0.25) AS q, MEDIAN(l_quantity) AS m FROM lineitem GROUP BY l_returnflag")
passed_through("pt_agg_approx", "SELECT ABS(APPROX_COUNT_DISTINCT(l_partkey) - COUNT(DISTINCT l_partkey)) <= 0.15 * COUNT(DISTINCT l_partkey) AS near, APPROX_COUNT_DISTINCT(l_returnflag) AS few FROM @lineitem", "SELECT true AS near, COUNT(DISTINCT l_returnflag) AS few FROM lineitem")
passed_through("pt_agg_filter", "SELECT o_orderstatus, COUNT(*) FILTER (WHERE o_totalprice > 100000) AS n, MAX_BY(o_orderkey, STRUCT(o_totalprice, o_orderkey)) AS top, BOOL_OR(o_totalprice > 300000) AS b FROM @orders GROUP BY o_orderstatus",
               "SELECT o_orderstatus, COUNT(*) FILTER (WHERE o_totalprice > 100000) AS n, arg_max(o_orderkey, ROW(o_totalprice, o_orderkey)) AS top, BOOL_OR(o_totalprice > 300000) AS b FROM orders GROUP BY o_orderstatus")
passed_through("pt_join_natural", "SELECT n_name, r_name FROM (SELECT n_name, n_regionkey AS k FROM @nation) n NATURAL JOIN (SELECT r_name, r_regionkey AS k FROM @region) r")
passed_through("pt_join_lateral", "SELECT c.c_custkey, o.o_orderkey FROM @customer c, LATERAL (SELECT o_orderkey FROM @orders WHERE o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) o")
passed_through("pt_unpivot", "SELECT l_orderkey, l_linenumber, l_partkey, what, amount FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_tax FROM @lineitem) UNPIVOT (amount FOR what IN (l_quantity AS quantity, l_tax AS tax))",
               "SELECT l_orderkey, l_linenumber, l_partkey, 'quantity' AS what, l_quantity AS amount FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'tax', l_tax FROM lineitem")
passed_through("pt_window_session", "SELECT user_id, session_window.start AS start, COUNT(*) AS n FROM @events GROUP BY user_id, session_window(ts, '12 hours')",
               """WITH g AS (SELECT *, CASE WHEN ts < LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '12' HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, SUM(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g) SELECT user_id, MIN(ts) AS start, COUNT(*) AS n FROM s GROUP BY user_id, k""")
passed_through("pt_window_sliding", "SELECT window.start AS start, COUNT(*) AS n FROM @events GROUP BY window(ts, '2 days', '1 day')",
               "SELECT start, COUNT(*) AS n FROM (SELECT date_trunc('day', ts) AS start FROM events UNION ALL SELECT date_trunc('day', ts) - INTERVAL 1 DAY FROM events) t GROUP BY start")
passed_through("pt_scalar_struct", "SELECT c_custkey, s.a AS a, TO_JSON(s) AS j, FROM_JSON(TO_JSON(s), 'a STRING, b INT').b AS b FROM (SELECT c_custkey, NAMED_STRUCT('a', c_mktsegment, 'b', c_nationkey) AS s FROM @customer) t",
               "SELECT c_custkey, c_mktsegment AS a, '{\"a\":\"' || c_mktsegment || '\",\"b\":' || c_nationkey || '}' AS j, c_nationkey AS b FROM customer")
passed_through("pt_scalar_lambda", "SELECT c_custkey, AGGREGATE(TRANSFORM(FILTER(a, x -> x > 3), x -> x * 2), 0, (t, x) -> t + x) AS s, SIZE(SLICE(a, 2, 2)) AS n FROM (SELECT c_custkey, ARRAY(c_nationkey, 5, 2) AS a FROM @customer) t",
               "SELECT c_custkey, CAST((CASE WHEN c_nationkey > 3 THEN 2 * c_nationkey ELSE 0 END) + 10 AS INTEGER) AS s, CAST(2 AS INTEGER) AS n FROM customer")
passed_through("pt_scalar_more", "SELECT p_partkey, TRIM(CONCAT('  ', p_name, ' ')) AS t, SPLIT(p_type, ' ')[0] AS w, FORMAT_STRING('%05d', p_size) AS f, ROUND(LN(p_size), 6) AS l, ROUND(EXP(p_size / 100), 6) AS e, POW(p_size, 2) AS p, UNIX_TIMESTAMP(TIMESTAMP '2024-01-02 03:04:05') AS u, TO_DATE('2024-05-06', 'yyyy-MM-dd') AS d FROM @part",
               "SELECT p_partkey, TRIM('  ' || p_name || ' ') AS t, string_split(p_type, ' ')[1] AS w, printf('%05d', p_size) AS f, ROUND(LN(p_size), 6) AS l, ROUND(EXP(p_size / 100), 6) AS e, POW(p_size, 2) AS p, CAST(epoch(TIMESTAMP '2024-01-02 03:04:05') AS BIGINT) AS u, DATE '2024-05-06' AS d FROM part")
passed_through("pt_values", "SELECT k, v FROM VALUES (1, 'a'), (2, 'b') AS t(k, v)", "SELECT k, v FROM (VALUES (1, 'a'), (2, 'b')) AS t(k, v)")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey <= 20")
def dml_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = project(spark, sf_dir, "dml_insert", {"models/m.sql": "SELECT n_nationkey, n_name FROM @nation WHERE n_nationkey < 5"})
    p.run()
    name = str(p.relation(p.files["m"]))
    spark.sql(f"INSERT INTO {name} SELECT n_nationkey, n_name FROM parquet.`{sf_dir}/nation.parquet` WHERE n_nationkey BETWEEN 5 AND 20")
    return spark.table(name)


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey > 20")
def dml_insert_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = project(spark, sf_dir, "dml_insert_overwrite", {"models/m.sql": "SELECT n_nationkey, n_name FROM @nation WHERE n_nationkey < 5"})
    p.run()
    name = str(p.relation(p.files["m"]))
    spark.sql(f"INSERT OVERWRITE {name} SELECT n_nationkey, n_name FROM parquet.`{sf_dir}/nation.parquet` WHERE n_nationkey > 20")
    return spark.table(name)


def _increments(spark: SparkSession, sf_dir: str, name: str, first: str, then: str, key: str = "") -> DataFrame:
    model = "{{ config(materialized='incremental', append=true" + key + ") }} {% if is_incremental() %}" + then + "{% else %}" + first + "{% endif %}"
    p = project(spark, sf_dir, name, {"models/m.sql": model})
    p._prepare({p.target_of(p.files["m"]).database})
    spark.sql(f"DROP TABLE IF EXISTS {p.relation(p.files['m'])}")
    p.run()
    project(spark, sf_dir, name, {"models/m.sql": model}).run()
    return p.table("m")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 5 UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= 3")
def mat_incremental_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _increments(spark, sf_dir, "mat_incremental_append", "SELECT n_nationkey, n_name FROM @nation WHERE n_nationkey < 5", "SELECT n_nationkey, n_name FROM @nation WHERE n_nationkey >= 3")


@query("SELECT NULLIF(n_nationkey, 3) AS k, CASE WHEN n_nationkey IN (3, 4) THEN 'new' ELSE n_name END AS v FROM nation")
def mat_incremental_nullkey(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = "SELECT NULLIF(n_nationkey, 3) AS k, n_name AS v FROM @nation"
    return _increments(spark, sf_dir, "mat_incremental_nullkey", first, "SELECT NULLIF(n_nationkey, 3) AS k, 'new' AS v FROM @nation WHERE n_nationkey IN (3, 4)", ", unique_key='k'")


@query("SELECT CAST(k AS BIGINT) AS k, v FROM (VALUES (1, 'two' || chr(10) || 'lines'), (2, 'a \"quoted\" word'), (3, NULL), (4, 'back\\slash, comma')) AS t(k, v)")
def seed_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = project(spark, sf_dir, "seed_multiline", {"data/s.csv": 'k,v\n1,"two\nlines"\n2,"a ""quoted"" word"\n\n3,\n4,"back\\slash, comma"\n'}, "seeds: {shop: {s: {column_types: {k: INTEGER, v: STRING}}}}")
    p.seed()
    return spark.table(str(p.seed_relation("s")))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_into_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.batches import stream_table

    return stream_table(spark, f"{sf_dir}/events.parquet", "event_type")
