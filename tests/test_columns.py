import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from massif.functions import columns as C


def _trials(seed, count):
    rng = np.random.default_rng(seed)
    for t in range(count):
        n_bins = int(rng.integers(2, 40))
        kind = t % 3
        if kind == 0:
            values = rng.exponential(10, 60).round(2)
        elif kind == 1:
            values = rng.integers(0, n_bins + 1, 60).astype(float)
        else:
            values = rng.normal(0, 1e-3, 60)
        edges = np.linspace(values.min(), values.max(), n_bins + 1)
        yield t, n_bins, np.concatenate([values, edges])


@pytest.fixture(scope="module")
def placed(spark):
    rows = [
        (t, n_bins, float(values.min()), float(values.max()), i, float(v))
        for t, n_bins, values in _trials(3, 60)
        for i, v in enumerate(values)
    ]
    df = spark.createDataFrame(rows, "t int, n_bins int, mn double, mx double, i int, x double")
    args = [F.col(c) for c in ("x", "mn", "mx", "n_bins")]
    return (
        df.withColumn("right", C.right_closed_bin(*args))
        .withColumn("left", C.left_closed_bin(*args))
        .withColumn("edges", C.bin_edges(*args[1:]))
        .orderBy("t", "i")
        .toPandas()
    )


def test_right_closed_bins_equal_pandas_cut(placed):
    for _, part in placed.groupby("t"):
        bins, edges = pd.cut(
            part["x"], bins=int(part["n_bins"].iloc[0]), labels=False, include_lowest=True, retbins=True
        )
        assert (bins.to_numpy() + 1 == part["right"].to_numpy()).all()
        assert np.allclose(edges, part["edges"].iloc[0], rtol=1e-14, atol=0)


def test_left_closed_bins_equal_clipped_digitize(placed):
    for _, part in placed.groupby("t"):
        n_bins = int(part["n_bins"].iloc[0])
        expected = np.clip(np.digitize(part["x"], np.array(part["edges"].iloc[0])) - 1, 0, n_bins - 1) + 1
        assert (expected == part["left"].to_numpy()).all()


def test_value_on_an_inner_edge_differs_by_rule(spark):
    row = spark.range(1).select(
        C.right_closed_bin(F.lit(2.0), F.lit(0.0), F.lit(10.0), F.lit(5)).alias("right"),
        C.left_closed_bin(F.lit(2.0), F.lit(0.0), F.lit(10.0), F.lit(5)).alias("left"),
        C.right_closed_bin(F.lit(99.0), F.lit(0.0), F.lit(10.0), F.lit(5)).alias("above"),
        C.right_closed_bin(F.lit(-9.0), F.lit(0.0), F.lit(10.0), F.lit(5)).alias("below"),
        C.right_closed_bin(F.lit(None).cast("double"), F.lit(0.0), F.lit(10.0), F.lit(5)).alias("null"),
    )
    assert tuple(row.first()) == (1, 2, 5, 1, None)


def test_freedman_diaconis_and_fallbacks(spark):
    rng = np.random.default_rng(5)
    sets = [rng.normal(0, 1, 500), rng.exponential(3, 1001), np.array([5.0] * 40 + [1.0, 9.0]), np.array([3.0])]
    rows, expected = [], []
    for values in sets:
        q75, q25 = np.percentile(values, [75, 25])
        rows.append((len(values), float(values.min()), float(values.max()), float(q25), float(q75)))
        if len(values) < 2:
            expected.append(1)
        elif q75 > q25:
            expected.append(int(np.ceil((values.max() - values.min()) / (2 * (q75 - q25) / len(values) ** (1 / 3)))))
        else:
            expected.append(int(np.ceil(1 + np.log2(len(values)))))
    df = spark.createDataFrame(rows, "n bigint, mn double, mx double, q25 double, q75 double").coalesce(1)
    found = df.select(C.freedman_diaconis(*[F.col(c) for c in df.columns]).alias("b")).collect()
    assert [r.b for r in found] == expected


def test_thirds_give_the_rest_to_the_tail(spark):
    rows = spark.range(1, 12).select(C.bin_third(F.col("id"), F.lit(11)).alias("third")).collect()
    assert [r.third for r in rows] == ["head"] * 3 + ["body"] * 3 + ["tail"] * 5


def test_segment_names_parse_by_suffix(spark):
    names = ["a_b_total_time", "all_data_total_time", "total_time", "NaN_hours", "all_data_x"]
    df = spark.createDataFrame([(n,) for n in names], "name string").coalesce(1)
    parsed = [tuple(r[0]) for r in df.select(C.parse_segment_name(F.col("name"), ["total_time", "hours"])).collect()]
    assert parsed == [
        ("a_b", "total_time"),
        ("all_data", "total_time"),
        ("all_data", "total_time"),
        ("NaN", "hours"),
        ("all_data", "x"),
    ]
    flat = [tuple(r[0]) for r in df.select(C.parse_segment_name(F.col("name"), ["total_time"], False)).collect()]
    assert flat[0] == ("all_data", "a_b_total_time") and flat[1] == ("all_data", "total_time")


def test_run_time_text(spark):
    df = spark.createDataFrame([("20251020_163947_run_x",), ("nonsense",)], "r string").coalesce(1)
    found = [r[0] for r in df.select(C.run_time_text(F.col("r"))).collect()]
    assert found == ["October 20, 2025, at 16:39:47 UTC", "an unknown time"]


def test_names_fall_back_to_the_raw_value(spark):
    df = spark.createDataFrame([("a",), ("b",)], "g string").coalesce(1)
    out = df.select(
        C.display_name(F.col("g"), {"a": "Alpha"}).alias("d"),
        C.unit_of(F.col("g"), {"b": "hours"}).alias("u"),
        C.safe_file_name(F.lit("x y/z")).alias("s"),
        C.model_file_name(F.lit("m/a: b.c")).alias("m"),
    ).collect()
    assert [tuple(r) for r in out] == [("Alpha", "units", "x_y-z", "m_a__b_c"), ("b", "hours", "x_y-z", "m_a__b_c")]


def test_nan_becomes_null_and_null_group_is_named(spark):
    df = spark.createDataFrame([(float("nan"), None), (1.5, "g")], "v double, g string").coalesce(1)
    found = [tuple(r) for r in df.select(C.measure("v"), C.group_label("g"), C.group_label(None)).collect()]
    assert found == [(None, "NaN", "all_data"), (1.5, "g", "all_data")]
