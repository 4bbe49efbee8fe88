import numpy as np
import pytest

from massif.operators.quantiles import exact_percentiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.mark.parametrize("group_rows,buckets", [(10**6, 64), (50, 16), (1, 2), (300, 4096)])
def test_bracketing_equals_numpy(spark, group_rows, buckets):
    rng = np.random.default_rng(11)
    groups = {
        "normal": rng.normal(0, 1, 701),
        "tail": rng.pareto(0.3, 500),
        "hot": np.concatenate([np.full(600, 4.25), rng.uniform(0, 9, 300)]),
        "same": np.full(90, 3.5),
        "huge": np.array([-1.7e308, -1.0, 0.0, 1e-300, 2.0, 1.7e308]),
        "one": np.array([42.0]),
        "whole": rng.integers(0, 5, 400).astype(float),
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("normal", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    found = {r.g: r.pct for r in exact_percentiles(df, ["g"], "v", PROBS, group_rows=group_rows, buckets=buckets).collect()}
    assert set(found) == set(groups)
    for g, values in groups.items():
        if g == "huge":
            expected = np.percentile(values, [0, 20, 40, 60, 80, 100])
            exact = exact_percentiles(
                df.where("g = 'huge'"), ["g"], "v", [0.0, 0.2, 0.4, 0.6, 0.8, 1.0], group_rows=group_rows, buckets=buckets
            ).first()
            assert np.allclose(exact.pct, expected, rtol=1e-12)
        else:
            assert np.allclose(found[g], np.percentile(values, [p * 100 for p in PROBS]), rtol=1e-12, atol=1e-12), g


@pytest.mark.parametrize("group_rows", [10**6, 100])
def test_infinite_values_stand_at_the_ends(spark, group_rows):
    inf = float("inf")
    groups = {"up": [*map(float, range(2000)), inf], "both": [-inf, -inf, *map(float, range(500)), inf], "only": [inf, inf], "mixed": [-inf, inf], "hot": [1.0] * 18000 + [2.0] * 5}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(4)
    probs = [0.0, 0.2, 0.5, 1.0]
    found = {r.g: r.pct for r in exact_percentiles(df, ["g"], "v", probs, group_rows=group_rows, buckets=16).collect()}
    for g, values in groups.items():
        values = sorted(values)
        for p, got in zip(probs, found[g], strict=True):
            at = p * (len(values) - 1)
            low, high = values[int(np.floor(at))], values[int(np.ceil(at))]
            want = low if low == high or at == int(at) else low + (at - int(at)) * (high - low)
            assert got == pytest.approx(want, nan_ok=True), (g, p)


@pytest.mark.parametrize("group_rows,buckets", [(10**6, None), (200, 8), (1, 3), (50, None)])
def test_overlapping_groups_count_rows_once_per_key(spark, group_rows, buckets):
    rng = np.random.default_rng(5)
    rows = [(c, col, float(v)) for c in range(6) for col, scale in (("x", 1), ("y", 1e6)) for v in rng.gamma(c + 1, scale, 60 + 40 * c)]
    df = spark.createDataFrame(rows, "comb int, column string, v double")
    groups = {("s", 0): [0, 1, 2], ("s", 1): [3, 4, 5], ("t", 0): [1, 5], ("t", 1): [0, 2, 3, 4], ("u", 0): [5]}
    members = spark.createDataFrame([(s, k, c) for (s, k), cs in groups.items() for c in cs], "seg string, k int, comb int")
    found = exact_percentiles(
        df, ["seg", "k", "column"], "v", PROBS, group_rows=group_rows, buckets=buckets, members=members, axis=["column"]
    )
    by_key = {(r.seg, r.k, r.column): r.pct for r in found.collect()}
    assert len(by_key) == 10
    for (s, k), cs in groups.items():
        for col in "xy":
            values = [v for c, name, v in rows if c in cs and name == col]
            assert np.allclose(by_key[s, k, col], np.percentile(values, [p * 100 for p in PROBS]), rtol=1e-12)
