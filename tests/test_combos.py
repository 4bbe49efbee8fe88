import numpy as np
import pytest
from pyspark.sql import functions as F

from massif.operators import combos


def sizes_frame(spark, sizes):
    return spark.createDataFrame([(int(s),) for s in sizes], "n bigint")


def walk_knee(sizes, sensitivity):
    """Kneedle over every rank, in whole numbers; None when there is no knee."""
    s = sorted(sizes, reverse=True)
    m, span = len(s), s[0] - s[-1]
    if span == 0:
        return None
    d = [(s[0] - s[i]) * (m - 1) - i * span for i in range(m)]
    at = lambda i: d[min(max(i, 0), m - 1)]
    limit = peak = None
    for i in range(m - 1):
        if d[i] >= at(i - 1) and d[i] >= at(i + 1):
            limit, peak = d[i] - sensitivity * span, i
        if peak is not None and d[i] <= at(i - 1) and d[i] <= at(i + 1):
            limit = 0
        if peak is not None and d[i + 1] < limit:
            return s[peak]
    return None


def expected_knee(sizes, sensitivity):
    if len(sizes) < 3:
        return 2
    found = walk_knee(sizes, sensitivity)
    if found is None:
        found = int(np.ceil(np.percentile(sizes, 25)))
    return max(2, found)


@pytest.mark.parametrize("seed", range(12))
def test_knee_equals_walk_over_every_combination(spark, seed):
    rng = np.random.default_rng(seed)
    kinds = [
        rng.zipf(1.6, 80).clip(max=500),
        rng.integers(1, 12, 50),
        rng.integers(1, 400, 30),
        np.repeat([90, 50, 7, 3, 1], [1, 1, 3, 10, 30]),
    ]
    sizes = kinds[seed % 4].tolist()
    sensitivity = [0.1, 1.0, 2.0][seed % 3]
    assert combos.knee_cutoff(sizes_frame(spark, sizes), sensitivity).first()[0] == expected_knee(sizes, sensitivity)


def test_knee_edge_cases(spark):
    assert combos.cutoff(sizes_frame(spark, [50, 3]), "auto-knee") == 2
    assert combos.cutoff(sizes_frame(spark, [7] * 9), "auto-knee(S=0.5)") == 7
    assert combos.cutoff(sizes_frame(spark, [1] * 9), "auto-knee") == 2
    assert combos.cutoff(sizes_frame(spark, []), "auto-knee") == 2
    assert combos.cutoff(None, "p10") == 2
    assert combos.knee_sensitivity("auto-knee(S=2.5)") == 2.5
    assert combos.knee_sensitivity("auto-knee(s=1.2.3)") == 1.0


def test_cutoff_specs(spark):
    sizes = sizes_frame(spark, [1, 2, 3, 4, 10, 30])
    assert combos.cutoff(sizes, 1) == 1
    assert combos.cutoff(sizes, "p0") == 2
    for p in (15, 50, 90, 100):
        assert combos.cutoff(sizes, f"p{p}") == max(2, int(np.ceil(np.percentile([1, 2, 3, 4, 10, 30], p))))
    for bad in ("p101", "pxx", "p-1", "median"):
        with pytest.raises(ValueError):
            combos.cutoff(sizes, bad)


def test_null_is_a_combination_of_its_own(spark):
    df = spark.createDataFrame(
        [("a", 1), ("a", None), (None, None), ("a", None), (None, 1)], "x string, y int"
    )
    sizes = combos.comb_sizes(df, ["x", "y"])
    numbered = combos.number_combos(sizes, ["x", "y"])
    found = {(r.x, r.y): (r.n, r.comb) for r in numbered.collect()}
    assert found == {(None, None): (1, 1), (None, 1): (1, 2), ("a", None): (2, 3), ("a", 1): (1, 4)}
    assert combos.with_comb(df, numbered, ["x", "y"]).where("comb = 3").count() == 2
    kept = combos.keep_combos(df, sizes, ["x", "y"], 2)
    assert [tuple(r) for r in kept.collect()] == [("a", None)] * 2


def test_partitioned_numbering_equals_one_window(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 7 != 0, (F.col("id") % 97).cast("string")).alias("a"), (F.col("id") % 41).alias("b")
    )
    sizes = combos.comb_sizes(df, ["a", "b"])
    one = {(r.a, r.b): r.comb for r in combos.number_combos(sizes, ["a", "b"]).collect()}
    many = {(r.a, r.b): r.comb for r in combos.number_combos(sizes.repartition(4), ["a", "b"]).collect()}
    assert one == many and sorted(many.values()) == list(range(1, len(many) + 1))


def test_no_categoricals_is_one_combination(spark):
    df = spark.range(7)
    sizes = combos.comb_sizes(df, [])
    assert [tuple(r) for r in combos.number_combos(sizes, []).collect()] == [(7, 1)]
    assert combos.with_comb(df, None, []).select("comb").distinct().collect()[0][0] == 1
    assert combos.keep_combos(df, sizes, [], 3).count() == 7
    assert combos.keep_combos(df, sizes, [], 8).count() == 0


def test_retention_of_nothing(spark):
    assert tuple(combos.retention(sizes_frame(spark, []), 3).first()) == (0, 0, 0.0)
    assert tuple(combos.retention(sizes_frame(spark, [1, 3]), 2).first()) == (3, 4, 75.0)


def test_one_hot_names_come_from_values_not_prefixes(spark):
    df = spark.createDataFrame(
        [("light", 2.0, "g1", True), (None, 3.0, None, False)], "weight string, weight_kg double, grp string, flag boolean"
    )
    wide = combos.one_hot(df, ["weight", "flag", "missing"], "grp", ["weight_kg"])
    assert wide.columns == ["grp", "weight_kg", "flag_false", "flag_true", "weight_light"]
    assert sorted((tuple(r) for r in wide.collect()), key=lambda r: r[1]) == [
        ("g1", 2.0, 0.0, 1.0, 1.0),
        (None, 3.0, 1.0, 0.0, 0.0),
    ]
    assert combos.one_hot_names(df, ["weight", "flag"]) == ["flag_false", "flag_true", "weight_light"]
    assert combos.one_hot_names(df, []) == []
    assert combos.one_hot(df, ["missing"], "grp", ["weight_kg"]).columns == ["grp", "weight_kg"]
    assert combos.one_hot(df, [], None, []).columns == []


def test_long_one_hot_lists_the_ones_of_the_wide_one(spark):
    df = spark.createDataFrame([(1, "a", 3), (2, None, 4), (3, "b", None), (4, None, None)], "id int, x string, y int")
    long = combos.one_hot_long(df, ["x", "y", "z"], ["id"])
    assert sorted(tuple(r) for r in long.collect()) == [(1, "x", "a"), (1, "y", "3"), (2, "y", "4"), (3, "x", "b")]
    assert combos.one_hot_long(df, ["z"], ["id"]).count() == 0
    shown = combos.one_hot(df, ["x", "y"], keep=["id"], values=[("x", "b"), ("y", "4")])
    assert shown.columns == ["id", "x_b", "y_4"]
    assert sorted(tuple(r) for r in shown.collect()) == [(1, 0.0, 0.0), (2, 0.0, 1.0), (3, 1.0, 0.0), (4, 0.0, 0.0)]
