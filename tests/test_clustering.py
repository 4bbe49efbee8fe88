import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors

from massif.operators import clustering, silhouette

PROFILE = "segment_group string, feature string, comb bigint, bin int, n bigint"
LABELS = "segment_group string, feature string, comb bigint, k int, cluster int"
PARAMS = "segment_group string, feature string, mn double, mx double, n_bins int, unit string"


def make_profile(spark, matrices):
    """Profile and parameters from {group: matrix}; an all-zero row keeps a null bin."""
    rows = []
    for g, matrix in matrices.items():
        for comb, counts in enumerate(matrix, 1):
            filled = [(g, "f", comb, b, int(n)) for b, n in enumerate(counts, 1) if n]
            rows += filled or [(g, "f", comb, None, 3)]
    params = [(g, "f", 0.0, float(m.shape[1]), m.shape[1], "units") for g, m in matrices.items()]
    return spark.createDataFrame(rows, PROFILE), spark.createDataFrame(params, PARAMS)


@pytest.fixture(scope="module")
def matrices():
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 40, (3, 12))
    clear = np.vstack([rng.poisson(c, (15, 12)) for c in centres])
    noisy = rng.poisson(3, (30, 9))
    noisy[4] = 0
    noisy[7] = noisy[8]
    return {"clear": clear, "noisy": noisy, "tiny": np.array([[5, 0], [0, 5]])}


def distances(matrix):
    m = matrix.astype(float)
    return np.sqrt(((m[:, None, :] - m[None, :, :]) ** 2).sum(-1))


def silhouettes(matrix, labels):
    d, out = distances(matrix), []
    for i, own in enumerate(labels):
        same = (labels == own).sum()
        if same == 1:
            out.append(0.0)
            continue
        a = d[i, labels == own].sum() / (same - 1)
        b = min(d[i, labels == c].mean() for c in set(labels) - {own})
        out.append(0.0 if max(a, b) == 0 else (b - a) / max(a, b))
    return np.array(out)


def wcss(matrix, labels):
    return sum(((matrix[labels == c] - matrix[labels == c].mean(0)) ** 2).sum() for c in set(labels))


def test_six_points_in_two_clusters(spark):
    points = [(1, 2), (1, 4), (1, 0), (10, 2), (10, 4), (10, 0)]
    df = spark.createDataFrame([(Vectors.dense(p),) for p in points], ["features"])
    model = clustering.fit_kmeans(df, 2)
    assert sorted(tuple(c) for c in model.clusterCenters()) == [(1.0, 2.0), (10.0, 2.0)]
    one = clustering.fit_kmeans(df, 1)
    assert [tuple(c) for c in one.clusterCenters()] == [(5.5, 2.0)]
    assert {r.prediction for r in one.transform(df).collect()} == {0}
    for bad in (0, -1, 7, 2.0, True):
        with pytest.raises(ValueError):
            clustering.fit_kmeans(df, bad)
    with pytest.raises(ValueError):
        clustering.fit_kmeans(df.limit(0), 2)


def test_k_range_is_clamped():
    assert list(clustering.k_range(1, 10, 4)) == [2, 3]
    assert list(clustering.k_range(3, 8, 100)) == [3, 4, 5, 6, 7, 8]
    assert list(clustering.k_range(3, 8, 3)) == []
    assert list(clustering.k_range(2, 8, 1)) == []


def test_sweep_is_repeatable(spark, matrices):
    profile, params = make_profile(spark, matrices)
    labels = clustering.sweep_labels(profile, params, 2, 4)
    again = clustering.sweep_labels(profile.repartition(5), params, 2, 4, threads=1)
    order = ["segment_group", "feature", "k", "comb"]
    pdf = labels.toPandas().sort_values(order, ignore_index=True)
    pd.testing.assert_frame_equal(pdf, again.toPandas().sort_values(order, ignore_index=True), check_like=True)
    assert set(pdf["segment_group"]) == {"clear", "noisy"}
    scored = {(r.segment_group, r.k): r for r in clustering.k_scores(profile, labels).collect()}
    for (g, k), part in pdf.groupby(["segment_group", "k"]):
        assert sorted(part["comb"]) == list(range(1, len(matrices[g]) + 1))
        found = part["cluster"].to_numpy()
        assert len(set(found)) == k
        assert scored[g, k].wcss == pytest.approx(wcss(matrices[g], found))
        assert scored[g, k].silhouette == pytest.approx(silhouettes(matrices[g], found).mean())
    clear = pdf[(pdf["segment_group"] == "clear") & (pdf["k"] == 3)]["cluster"].to_numpy()
    assert [len(set(clear[i : i + 15])) for i in (0, 15, 30)] == [1, 1, 1]


def test_identical_histograms_give_fewer_clusters(spark):
    profile, params = make_profile(spark, {"same": np.full((6, 3), 4)})
    labels = clustering.sweep_labels(profile, params, 2, 3)
    assert labels.select("cluster").distinct().count() == 1
    scored = clustering.k_scores(profile, labels).collect()
    assert [(r.wcss, r.silhouette) for r in scored] == [(0.0, None)] * 2


def test_final_clusters_are_numbered_by_mean_bin(spark):
    matrix = np.array([[0, 0, 9], [0, 0, 8], [9, 0, 0], [8, 0, 0], [0, 9, 0], [0, 8, 0]])
    profile, params = make_profile(spark, {"g": matrix})
    labels = clustering.sweep_labels(profile, params, 3, 3)
    chosen = spark.createDataFrame([("g", "f", 3)], "segment_group string, feature string, k int")
    found = {r.comb: r.cluster for r in clustering.final_clusters(profile, labels, chosen).collect()}
    assert found == {1: 2, 2: 2, 3: 0, 4: 0, 5: 1, 6: 1}


@pytest.mark.parametrize("block", [4, 7, 2048])
def test_silhouette_tiles_equal_all_pairs(spark, matrices, block):
    profile, _ = make_profile(spark, matrices)
    rows, expected = [], {}
    for g in ("clear", "noisy"):
        n = len(matrices[g])
        for k in (2, 5):
            found = np.arange(n) % k
            found[0] = k
            rows += [(g, "f", i + 1, k, int(c)) for i, c in enumerate(found)]
            expected[g, k] = silhouettes(matrices[g], found)
    labels = spark.createDataFrame(rows, LABELS)
    samples = silhouette.silhouette_samples(profile, labels, block).toPandas()
    for (g, k), part in samples.groupby(["segment_group", "k"]):
        assert np.allclose(part.sort_values("comb")["silhouette"], expected[g, k], atol=1e-12)


def test_silhouette_is_undefined_for_one_or_only_single_clusters(spark):
    profile, _ = make_profile(spark, {"g": np.array([[1, 0], [0, 1], [3, 3]])})
    rows = [("g", "f", c, 1, 0) for c in (1, 2, 3)] + [("g", "f", c, 3, c) for c in (1, 2, 3)]
    scores = silhouette.silhouette_scores(profile, spark.createDataFrame(rows, LABELS)).collect()
    assert {r.k: r.silhouette for r in scores} == {1: None, 3: None}


def test_projection_equals_numpy(spark, matrices):
    rank_one = np.outer(np.arange(1, 8), [3, 0, 1, 2])
    given = matrices | {"one": rank_one, "same": np.full((4, 3), 2)}
    profile, params = make_profile(spark, given)
    rows = [(g, "f", i + 1, i % 2) for g, m in given.items() for i in range(len(m))]
    labels = spark.createDataFrame(rows, "segment_group string, feature string, comb bigint, cluster int")
    found = clustering.project_2d(profile, params, labels).toPandas().sort_values(["segment_group", "kind", "comb", "cluster"], ignore_index=True)
    assert set(found["kind"]) == {"point", "centre"}
    for g, matrix in given.items():
        centred = matrix - matrix.mean(0)
        axes = np.linalg.svd(centred, full_matrices=False)[2]
        spectrum = np.linalg.svd(centred, compute_uv=False)
        points = found[(found["segment_group"] == g) & (found["kind"] == "point")]
        for name, axis, size in zip(("pc1", "pc2"), axes, spectrum, strict=False):
            want = centred @ axis * np.sign(axis[abs(axis).argmax()]) if size > 1e-9 else np.zeros(len(matrix))
            assert np.allclose(points[name], want, atol=1e-3 * spectrum[0] + 1e-12), (g, name)
        assert abs(points["pc1"].mean()) < 1e-9 and abs((points["pc1"] * points["pc2"]).sum()) < 1e-6 * max(1.0, spectrum[0] ** 2)
