import os

import pytest

from loomery.plans import codegen
from loomery.plans.project import Project
from loomery.sources.config import Folder, load
from loomery.sources.properties import SchemaFile
from loomery.streaming.watch import Watcher
from loomery.template.values import TemplateError
from tests.conftest import SMALL

BASE = {
    "dbt_project.yml": "name: shop\nprofile: shop\nvars: {low: 1}\nmodels:\n  shop:\n    tags: [all]\n    staging:\n      materialized: ephemeral\n    marts:\n      materialized: view\n      tags: [daily]\n",
    "profiles.yml": "shop:\n  target: dev\n  outputs:\n    dev: {project: dev, dataset: pj, threads: 3}\n    prod: {project: prod, dataset: pj, threads: 3}\n",
}
FILES = BASE | {
    "models/staging/stg_orders.sql": "SELECT * FROM {{ source('sf', 'orders') }} WHERE o_orderkey >= {{ var('low') }}",
    "models/marts/by_status.sql": "SELECT o_orderstatus, COUNT(*) AS n FROM {{ ref('stg_orders') }} GROUP BY 1",
    "models/top.sql": "{{ config(materialized='table', tags=['nightly']) }}SELECT MAX(n) AS most FROM {{ ref('by_status') }}",
    "models/marts/by_status.yml": "version: 2\nmodels:\n- name: by_status\n  columns:\n  - name: o_orderstatus\n    tests:\n    - unique\n    - not_null\n    - accepted_values: {values: [F, O], severity: warn}\n",
    "tests/some.sql": "SELECT * FROM {{ ref('top') }} WHERE most < 0",
}


def make(spark, files=FILES, **k):
    return Project(spark, files, sources={"sf": SMALL}, **k)


def test_run_select_and_test(spark):
    p = make(spark)
    assert p.order() == ["stg_orders", "by_status", "top"]
    assert p.order("top") == ["top"]
    assert p.order("+top") == ["stg_orders", "by_status", "top"]
    assert p.order("tag:daily") == ["stg_orders", "by_status"]  # with what is inlined
    assert p.run() == ["stg_orders", "by_status", "top"]
    assert p.table("top").collect()[0][0] > 0
    assert spark.catalog.getTable(str(p.relation(p.files["by_status"]))).tableType == "VIEW"
    by = {r.name: r.status for r in p.test()}
    assert by == {"unique_by_status__o_orderstatus_0": "success", "not_null_by_status__o_orderstatus_1": "success", "accepted_values_by_status__o_orderstatus_2": "warning", "some": "success"}
    assert "__inline__stg_orders AS (" in p.sql_of("by_status")
    with pytest.raises(TemplateError):
        p.order("absent")


def test_introspection_needs_no_table_in_the_first_pass(spark):
    p = make(spark, BASE | {"models/a.sql": "SELECT 'x' AS k, 1 AS v", "models/b.sql": "SELECT {% for k in dbt_utils.get_column_values(ref('a'), 'k') %}SUM(CASE WHEN k = '{{ k }}' THEN v END) AS s_{{ k }}{% endfor %}{% if not execute %}1{% endif %} FROM {{ ref('a') }}"})
    p.run()
    assert p.table("b").columns == ["s_x"]


def test_names_and_errors(spark):
    with pytest.raises(TemplateError, match="same name"):
        make(spark, BASE | {"models/a/x.sql": "SELECT 1", "models/b/x.sql": "SELECT 2"})
    p = make(spark, BASE | {"models/a/x.sql": "SELECT 1 AS k", "models/y.sql": "SELECT * FROM {{ ref('a/x') }}", "models/off.sql": "{{ config(enabled=false) }}SELECT 1", "models/blank.sql": "{# nothing #}"})
    p.compile()
    assert p.files["y"].needs == {"x"}
    assert "off" not in p.models()
    assert "blank" in p.run()
    with pytest.raises(TemplateError, match="unknown materialization"):
        make(spark, BASE | {"models/x.sql": "{{ config(materialized='odd') }}SELECT 1"}).compile()


def test_view_and_table_names_do_not_mix(spark):
    make(spark, BASE | {"models/flip.sql": "SELECT 1 AS a"}).run()
    with pytest.raises(TemplateError, match="is a table"):
        make(spark, BASE | {"models/flip.sql": "{{ config(materialized='view') }}SELECT 1 AS a"}).run()


def test_macro_file_and_udf_and_seed(spark):
    files = BASE | {"macros/twice.sql": "{% macro twice(x) %}({{ x }} * 2){% endmacro %}", "data/s.csv": "id,name\n1,a\n2,b\n", "models/m.sql": "{{ config(udf='CREATE TEMPORARY FUNCTION inc(x BIGINT) RETURNS BIGINT RETURN x + 1;') }}SELECT inc({{ twice('id') }}) AS v FROM {{ ref('s') }}"}
    p = make(spark, files)
    p.seed()
    p.run()
    assert sorted(r[0] for r in p.table("m").collect()) == [3, 5]
    assert p.select(macros=True).needs["m"] == {"macro:twice"}
    with pytest.raises(TemplateError, match="fields"):
        make(spark, BASE | {"data/j.csv": "a,b\n1\n"}).seed()


def test_folders_and_config():
    f = Folder.parse({"enabled": True, "tags": ["a", "b"], "child": {"tags": ["c"], "materialized": "view", "leaf": {"tags": []}}})
    assert f.at(["child"]) == {"enabled": True, "tags": ["c"], "materialized": "view"}
    assert f.at(["child", "leaf", "x"])["tags"] == []
    assert f.at(["other"])["tags"] == ["a", "b"]
    c = load(BASE | {"loomery.yml": "model-groups:\n  g: {dev: {dataset: short}}\n  g/h: {dev: {dataset: long}}\n"})
    assert c.target_for("models/g/h/x.sql").dataset == "long"
    assert c.target_for("models/g/x.sql").dataset == "short"
    assert c.target_for("models/gg/x.sql").dataset == "pj"
    with pytest.raises(TemplateError, match="protected"):
        load(BASE | {"loomery.yml": "protected-targets: [dev]"})


def test_properties_round_trip():
    text = "version: 2\nmodels:\n  - name: a\n    description: words\n    meta:\n      owner: me\n    columns:\n      - name: z\n        tests:\n          - unique\n          - accepted_values:\n              values:\n                - x\n              severity: warn\n      - name: b\n"
    s = SchemaFile.parse(text)
    assert s.dump() == text
    assert [(n, c, t.severity) for n, _, c, t in s.tests()] == [("unique_a__z_0", "z", "error"), ("accepted_values_a__z_1", "z", "warn")]


def test_generated_files(spark, tmp_path):
    p = make(spark, FILES | {"docs/n.md": "how many"})
    p.run()
    out = codegen.schema_gen(p, "by_status", "top", write=False)
    assert '{{ doc("n") }}' in out["models/marts/by_status.yml"]
    assert "most" in out["models/top.yml"]
    assert "- unique" in codegen.test_gen(p, "top", write=False)["models/top.yml"]
    view = codegen.bi_view("v", "db.v", spark.sql("SELECT 1 AS a, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS t"))
    assert "dimension_group: t" in view
    assert "dimension: a" in view
    paths = codegen.isolate(p, str(tmp_path), "top")
    assert "models/marts/by_status.sql" in paths
    stub = Project.load(spark, str(tmp_path), sources={"sf": SMALL})
    assert stub.run("top")


def test_watch(spark, tmp_path):
    for path, text in FILES.items():
        os.makedirs(tmp_path / os.path.dirname(path), exist_ok=True)
        (tmp_path / path).write_text(text)
    w = Watcher(Project.load(spark, str(tmp_path), sources={"sf": SMALL}))
    w.project.run()
    assert w.poll() == ([], [])
    (tmp_path / "models/staging/stg_orders.sql").write_text("SELECT * FROM {{ source('sf', 'orders') }} WHERE o_orderkey < 5")
    ran, results = w.poll()
    assert {"by_status", "top"} <= set(ran)
    assert any(r.name == "some" for r in results)


def test_deleted_files_while_watching(spark, tmp_path):
    for path, text in {"dbt_project.yml": "name: gone\nprofile: gone\n", "profiles.yml": "gone:\n  target: dev\n  outputs:\n    dev: {project: p, dataset: gone_models, threads: 2}\n",
                       "models/a.sql": "SELECT 1 AS k", "models/b.sql": "SELECT * FROM {{ ref('a') }}", "models/c.sql": "SELECT 2 AS k"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    p = Project.load(spark, str(tmp_path))
    w = Watcher(p)
    p.run()
    (tmp_path / "models/a.sql").unlink()
    ran, results = w.poll()
    assert ran == [] and [(r.name, r.status) for r in results] == [("b", "error")] and "'a'" in results[0].message
    assert "a" not in p.files and w.poll() == ([], [])
    (tmp_path / "models/b.sql").write_text("SELECT * FROM {{ ref('c') }}")
    assert w.poll()[0] == ["b"] and p.models() == ["b", "c"]


def test_circle_of_inlined_models(spark):
    e = "{{ config(materialized='ephemeral') }}"
    p = Project(spark, {"dbt_project.yml": "name: x\nprofile: x\n", "profiles.yml": "x:\n  target: dev\n  outputs:\n    dev: {project: p, dataset: d, threads: 1}\n",
                        "models/a.sql": e + "SELECT * FROM {{ ref('b') }}", "models/b.sql": e + "SELECT * FROM {{ ref('c') }}", "models/c.sql": e + "SELECT * FROM {{ ref('a') }}"})
    with pytest.raises(TemplateError, match="circle: .*a.* -> "):
        p.compile()


def test_unknown_selector_warns(spark):
    p = Project(spark, {"dbt_project.yml": "name: x\nprofile: x\n", "profiles.yml": "x:\n  target: dev\n  outputs:\n    dev: {project: p, dataset: d, threads: 1}\n", "models/a.sql": "SELECT 1 AS k"})
    with pytest.warns(UserWarning, match="no model 'nothing'"):
        assert list(p.select("a", "nothing", missing="skip").needs) == ["a"]


def test_statements_with_blocks():
    from loomery.operators.materialize import split_statements

    sql = "SELECT CASE WHEN a THEN ';' END AS x; BEGIN DECLARE v INT; IF v > 0 THEN SELECT 1; END IF; BEGIN SELECT CASE WHEN 1 THEN 2 END; END; END; SELECT 3 -- ; END"
    assert split_statements(sql) == [sql.split("; BEGIN DECLARE")[0], "BEGIN DECLARE" + sql.split("BEGIN DECLARE")[1].split("; SELECT 3")[0], "SELECT 3 -- ; END"]


def test_increments(spark):
    """Rows are appended without reading the old ones; keys are unique, null among them; other columns are an error."""
    from loomery.operators.materialize import _location, append_or_merge, write_table

    spark.sql("CREATE DATABASE IF NOT EXISTS increments")
    name, frame = "increments.t", lambda rows: spark.createDataFrame(rows, "k int, v string")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    write_table(spark, name, frame([(1, "a"), (None, "b")]))
    place = _location(spark, name)
    append_or_merge(spark, name, frame([(1, "c")]), [])
    append_or_merge(spark, name, frame([(2, "d")]).select("v", "k"), ["k"])  # a new key: the folder stays
    assert _location(spark, name) == place
    append_or_merge(spark, name, frame([(None, "e"), (1, "f")]), ["k"])
    assert _location(spark, name) != place
    assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, frame([(None, "e"), (1, "f"), (2, "d")]).collect()))
    with pytest.raises(TemplateError, match="two new rows"):
        append_or_merge(spark, name, frame([(7, "x"), (7, "y")]), ["k"])
    with pytest.raises(TemplateError, match="columns"):
        append_or_merge(spark, name, frame([(7, "x")]).withColumnRenamed("v", "w"), ["k"])
