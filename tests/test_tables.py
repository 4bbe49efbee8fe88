import datetime as dt
import decimal

import pytest

from massif.operators import profiling
from massif.operators.bounded import join_null_safe, settle
from massif.plans.spec import AnalysisSpec, load_config, merged, specs_from_config
from massif.sources import runs, tables


def test_csv_and_parquet_by_extension(spark, tmp_path):
    (tmp_path / "test.CSV").write_text("col1,col2\n1,a\n2,b\n")
    df = tables.load_table(spark, str(tmp_path / "test.CSV"))
    assert [(f.name, f.dataType.simpleString()) for f in df.schema.fields] == [("col1", "int"), ("col2", "string")]
    assert df.count() == 2
    df.write.parquet(str(tmp_path / "t.parquet"))
    assert tables.load_table(spark, str(tmp_path / "t.parquet")).count() == 2
    typed = tables.load_table(spark, str(tmp_path / "test.CSV"), "col1 double, col2 string")
    assert typed.schema["col1"].dataType.simpleString() == "double"


def test_source_checks(spark, tmp_path):
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "test.xyz").write_text("data")
    (tmp_path / "broken.parquet").write_text("not parquet")
    with pytest.raises(FileNotFoundError):
        tables.load_table(spark, str(tmp_path / "absent.csv"))
    with pytest.raises(ValueError):
        tables.load_table(spark, str(tmp_path / "empty.txt"))
    for name in ("test.xyz", "broken.parquet"):
        with pytest.raises(RuntimeError):
            tables.load_table(spark, str(tmp_path / name))


def test_empty_text_and_nan_are_null(spark, tmp_path):
    (tmp_path / "n.csv").write_text("a,b\n,1.5\nx,NaN\n")
    rows = tables.load_table(spark, str(tmp_path / "n.csv")).collect()
    assert [tuple(r) for r in rows] == [(None, 1.5), ("x", None)]


def test_numeric_and_text_columns(spark):
    df = spark.createDataFrame(
        [(1, "a", 1.1, decimal.Decimal("1.5"), True, dt.datetime(2024, 1, 1))],
        "col1 int, col2 string, col3 double, col4 decimal(5,1), col5 boolean, col6 timestamp",
    )
    assert tables.numeric_columns(df) == ["col1", "col3", "col4"]
    assert tables.numeric_columns(df, ["col1", "unknown"]) == ["col3", "col4"]
    assert tables.categorical_columns(df) == ["col2"]


def test_tables_of_a_run(spark, tmp_path):
    folder = str(tmp_path)
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert tables.write_table(df, folder, "my table/1", "r1", ["parquet", "csv"])
    assert not tables.write_table(df.limit(0), folder, "none", "r1")
    assert not tables.write_json(df.limit(0), folder, "none", "r1")
    assert tables.write_table(df, folder, "my table/1", "r1")
    assert [tuple(r) for r in tables.read_table(spark, folder, "my table/1", "r1").collect()] == [(1, "x")]
    assert spark.read.option("header", True).csv(f"{folder}/my_table-1_csv").count() == 1
    tables.write_json(df, folder, "doc", "r1")
    found = runs.gather_artifacts(spark, f"{folder}/doc", "json").collect()
    assert len(found) == 1 and found[0].content.strip() == '{"a":1,"b":"x"}'
    assert found[0].file_name.endswith(".json")


def test_tables_by_segment(spark, tmp_path):
    folder = str(tmp_path)
    rows = [("01", "v", 1, "x"), ("a/b=c d", "v", 2, None), ("", "w", 3, "z"), ("NaN", "v", 4, "z")]
    schema = "segment_group string, feature string, n int, name string"
    df = spark.createDataFrame(rows, schema)
    read = lambda **k: sorted(tables.read_table(spark, folder, "t", "r1", **k).collect(), key=lambda r: r.n)
    assert tables.write_table(df, folder, "t", "r1")
    assert tables.write_table(df.where("n = 1"), folder, "t", "r2")
    assert [tuple(r) for r in read()] == rows
    assert tables.read_table(spark, folder, "t", "r1").dtypes == df.dtypes
    # one segment lists one folder
    for row in rows[:2]:
        one = tables.read_table(spark, folder, "t", "r1", segment=row[:2])
        assert [tuple(r) for r in one.collect()] == [row]
        assert len({f.rsplit("/", 1)[0] for f in one.inputFiles()}) == 1
        assert len(one.inputFiles()) < len(tables.read_table(spark, folder, "t", "r1").inputFiles())
    # a repeated save replaces its own run, and what it no longer has is passed over
    assert tables.write_table(df.where("n <> 3").withColumn("n", df.n * 10), folder, "t", "r1")
    assert [r.n for r in read()] == [10, 20, 40]
    assert tables.read_table(spark, folder, "t", "r2").count() == 1
    with pytest.raises(FileNotFoundError):
        read(segment=("absent", "v"))
    with pytest.raises(ValueError):
        tables.write_table(df.withColumnRenamed("name", tables.SAVE), folder, "t", "r1")
    # a save that fails, or has no rows, leaves nothing to read
    with pytest.raises(Exception, match="broken"):
        tables.write_table(df.selectExpr("segment_group", "feature", "n", "raise_error('broken') AS name"), folder, "t", "r1")
    with pytest.raises(FileNotFoundError):
        read()
    assert not tables.write_table(df.limit(0), folder, "t", "r1")
    with pytest.raises(FileNotFoundError):
        read()


def test_latest_run(spark, tmp_path):
    schema = "run_id string, status string"
    listed = [("20250101_000000_run_a", "done"), ("20260101_000000_run_b", "failed"), ("zzz", "failed")]
    assert runs.latest_run(spark.createDataFrame(listed, schema)).first()[0] == "20250101_000000_run_a"
    assert runs.latest_run(spark.createDataFrame(listed[1:], schema)).first()[0] == "20260101_000000_run_b"
    assert runs.latest_run(spark.createDataFrame(listed[2:], schema)).first()[0] is None
    with pytest.raises(FileNotFoundError):
        runs.find_latest_run(spark, str(tmp_path / "nowhere"))


def test_settled_tables_are_equal_whatever_their_size(spark):
    df = spark.range(200).selectExpr("id", "cast(id % 3 as string) g", "array(id, null) a", "named_struct('x', id) s")
    local, written = settle(df), settle(df, rows=10)
    assert local.schema == df.schema
    assert sorted(map(str, local.collect())) == sorted(map(str, written.collect())) == sorted(map(str, df.collect()))
    plan = lambda frame: frame._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" in plan(local) and "parquet" in plan(written)


def test_null_safe_join_needs_a_key(spark):
    with pytest.raises(ValueError):
        join_null_safe(spark.range(1), spark.range(1), [])


def test_table_profile(spark):
    rows = [(1, 2.0, "b", None), (2, None, "a", None), (3, 4.0, "b", None), (4, 8.0, "a", None), (5, 9.0, None, None)]
    df = spark.createDataFrame(rows, "i int, v double, t string, e string")
    found = {r["column"]: r for r in profiling.profile_table(df, ["i"]).collect()}
    assert set(found) == {"v", "t"}
    assert (found["v"]["count"], found["v"].p50, found["v"].dtype) == (4, 6.0, "double")
    assert (found["t"]["count"], found["t"].unique, found["t"].top, found["t"].freq) == (4, 2, "a", 2)
    assert [tuple(r) for r in profiling.value_counts(df, "t").collect()] == [("a", 2), ("b", 2)]
    assert [tuple(r) for r in profiling.top_values(df, "t", 1).collect()] == [("a", 2)]
    assert {r["column"]: r.n_unique for r in profiling.n_unique(df, ["t", "e", "i"]).collect()} == {"t": 2, "e": 0, "i": 5}


def test_configuration(tmp_path):
    text = """
common_settings:
  preprocessing: {min_combination_size_input: auto-knee, quantization_n_classes_input: auto}
  clustering: {clustering_min_k: 3, clustering_max_k: 8, percent_drop_threshold_input: 5.0}
active_config_names: [one, absent, two]
one:
  io: {input_data_path: one.csv}
  columns: {grouping_column: route, categorical: [weekday], continuous_to_analyze: [total_time]}
  preprocessing: {min_combination_size_input: p15}
two:
  columns: {grouping_column: null, continuous_units_map: {hours: h}}
"""
    pytest.importorskip("yaml")
    path = tmp_path / "c.yaml"
    path.write_text(text)
    first, second = specs_from_config(load_config(str(path)))
    assert (first.name, first.input_path, first.grouping, first.min_combination_size) == ("one", "one.csv", "route", "p15")
    assert (first.n_bins, first.min_k, first.max_k) == ("auto", 3, 8)
    assert (second.grouping, second.min_combination_size, second.units) == (None, "auto-knee", {"hours": "h"})
    assert AnalysisSpec.from_json(first.to_json()) == first
    path.write_text("key: value\n")
    assert load_config(str(path)) == {"key": "value"}
    path.write_text("")
    assert load_config(str(path)) == {}
    path.write_text("a: [1")
    with pytest.raises(ValueError):
        load_config(str(path))
    bad = tmp_path / "c.json"
    bad.write_text("{")
    with pytest.raises(ValueError):
        load_config(str(bad))
    with pytest.raises(FileNotFoundError):
        load_config(str(tmp_path / "absent.yaml"))
    with pytest.raises(ValueError):
        specs_from_config({"active_config_names": None})
    with pytest.raises(ValueError):
        AnalysisSpec.from_config({"columns": {"nope": 1}})
    assert merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}, "d": 4}) == {"a": {"b": 3, "c": 2}, "d": 4}
    assert merged({"a": 1}, None) == {"a": 1}


def test_defaults_of_the_parameters():
    spec = AnalysisSpec()
    assert (spec.min_combination_size, spec.n_bins, spec.min_k, spec.max_k) == ("auto-knee", "auto", 2, 10)
    assert (spec.max_drop_percent, spec.hdr_excluded_percent) == (5.0, 90.0)
    assert (spec.x_axis_label, spec.bin_axis_label) == ("Value", "Bin")
