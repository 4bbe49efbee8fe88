import numpy as np
import pytest

from massif.operators import binning, segments


def long_frame(spark, values, groups=None):
    rows = [(None if groups is None else groups[i], v) for i, v in enumerate(values)]
    return segments.to_long(spark.createDataFrame(rows, "g string, v double"), ["v"], "g" if groups else None)


def test_segments_without_spread_are_left_out(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 5.0), ("a", 1.0, 6.0), ("b", 2.0, None), ("b", 3.0, 1.0), (None, 1.0, 2.0), (None, 9.0, float("nan"))],
        "g string, v double, w double",
    )
    long = segments.to_long(df, ["v", "w", "absent"], "g")
    params = {(r.segment_group, r.feature): r.n_bins for r in binning.bin_params(long).collect()}
    assert set(params) == {("a", "w"), ("b", "v"), ("NaN", "v")}
    stats = {(r.segment_group, r.feature): (r.rows, r.n) for r in binning.segment_stats(long).collect()}
    assert stats[("NaN", "w")] == (2, 1) and stats[("b", "w")] == (2, 1)


def test_cells_merge_to_the_same_statistics(spark):
    rng = np.random.default_rng(1)
    rows = [(["a", "b", None][i % 3], i % 5, float(rng.normal()) if i % 4 else None, float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, c int, v double, w double")
    cells = binning.cell_stats(df, ["v", "w"], "g", ["c"])
    merged = sorted(tuple(r) for r in binning.stats_from_cells(cells, ["v", "w"]).select("segment_group", "feature", "rows", "n", "mn", "mx").collect())
    direct = binning.segment_stats(segments.to_long(df, ["v", "w"], "g"))
    assert merged == sorted(tuple(r) for r in direct.select("segment_group", "feature", "rows", "n", "mn", "mx").collect())


def test_fixed_and_single_bins(spark):
    long = long_frame(spark, [1.0, 2.0, 3.0, 4.0])
    assert binning.bin_params(long, 7, {"v": "hours"}).select("n_bins", "unit").first() == (7, "hours")
    assert binning.bin_params(long, 1).isEmpty()
    for bad in (0, -3, "seven", 2.5, True):
        with pytest.raises(ValueError):
            binning.bin_params(long, bad)


def test_null_measure_gets_a_null_bin(spark):
    long = long_frame(spark, [0.0, None, 10.0, float("nan"), 5.0])
    rows = binning.quantize(long, binning.bin_params(long, 2)).select("value", "bin").collect()
    assert sorted(((r.value, r.bin) for r in rows), key=str) == sorted(
        [(0.0, 1), (None, None), (10.0, 2), (None, None), (5.0, 1)], key=str
    )
    with pytest.raises(ValueError):
        binning.quantize(long, binning.bin_params(long, 2), edge_rule="middle")


def test_quantize_column_checks_and_labels(spark):
    df = spark.createDataFrame([(0.0, "x"), (2.0, "y"), (10.0, "z"), (None, "n")], "v double, t string")
    out, edges = binning.quantize_column(df, "v", 5, ["a", "b", "c", "d", "e"])
    found = {r.t: (r["class"], r.c_a, r.c_e) for r in out.collect()}
    assert found == {"x": ("a", 1.0, 0.0), "y": ("a", 1.0, 0.0), "z": ("e", 0.0, 1.0), "n": (None, 0.0, 0.0)}
    assert "c_c" in out.columns
    assert np.allclose(edges, [-0.01, 2, 4, 6, 8, 10])
    with pytest.raises(ValueError):
        binning.quantize_column(df, "absent", 2, [1, 2])
    with pytest.raises(TypeError):
        binning.quantize_column(df, "t", 2, [1, 2])
    with pytest.raises(ValueError):
        binning.quantize_column(df, "v", 0, [])
    with pytest.raises(ValueError):
        binning.quantize_column(df, "v", 2, [1])


def test_group_selection_compares_as_text(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (None, 3.0)], "g int, v double")
    pick = lambda wanted: sorted(r.v for r in segments.select_groups(df, "g", wanted).collect())
    assert pick(["1"]) == [1.0]
    assert pick(["1", "NaN"]) == [1.0, 3.0]
    assert pick([]) == [1.0, 2.0, 3.0]
    assert segments.select_groups(df, "absent", ["1"]).count() == 3


def test_roles_are_checked(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "g int, c string, v double")
    assert segments.check_roles(df, "g", ["c"], ["v"]) == "g"
    assert segments.check_roles(df, "absent", ["c"], ["v"]) is None
    for grouping, cats, measures in (("c", ["c"], ["v"]), ("g", ["c"], [])):
        with pytest.raises(ValueError):
            segments.check_roles(df, grouping, cats, measures)


def test_rows_behind_the_parameters_are_computed_once(spark):
    """The rows may come from a join; statistics and every pass of the percentiles read what it gave."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = spark.range(1000).selectExpr("'g' AS segment_group", "'m' AS feature", "CAST(id AS DOUBLE) AS value")
    params = binning.bin_params(rows.mapInPandas(counted, rows.schema), group_rows=50).collect()
    assert [(r.n, r.mn, r.mx, r.q25, r.q75, r.n_bins) for r in params] == [(1000, 0.0, 999.0, 249.75, 749.25, 10)]
    assert seen.value == 1000
