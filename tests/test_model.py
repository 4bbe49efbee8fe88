import numpy as np
import pytest

from massif.operators import model

CELLS = "segment_group string, feature string, bin int, cluster int, n bigint"
PARAMS = "segment_group string, feature string, mn double, mx double, n_bins int, unit string"


@pytest.fixture(scope="module")
def trained(spark):
    rows = [("g", "f", b, c, n) for b, c, n in [
        (1, 3, 8), (1, 5, 2), (2, 3, 4), (2, 5, 4), (2, 9, 1), (3, 5, 6), (3, 9, 1), (None, 9, 5), (None, 3, 1)
    ]]
    rows += [("two", "f", b, c, n) for b, c, n in [(1, 0, 9), (1, 1, 1), (2, 0, 2), (2, 1, 7)]]
    rows += [("lone", "f", 1, 0, 9)]
    params = spark.createDataFrame(
        [("g", "f", 0.0, 4.0, 4, "units"), ("two", "f", 0.0, 2.0, 2, "units"), ("lone", "f", 0.0, 2.0, 2, "units")], PARAMS
    )
    cells = spark.createDataFrame(rows, CELLS)
    return rows, cells, params, model.train_bin_model(cells, params)


def expand(rows, group):
    """Training rows as (bin, cluster) pairs."""
    return [(b, c) for g, _, b, c, n in rows if g == group for _ in range(n)]


def predicted(frame, group):
    return {
        r.bin: r for r in model.bin_predictions(frame).where(f"segment_group = '{group}'").collect()
    }


def test_probabilities_and_prior_for_empty_bins(trained):
    _, _, _, frame = trained
    by_bin = predicted(frame, "g")
    assert set(by_bin) == {1, 2, 3, 4, None}
    assert by_bin[1].classes == [3, 5, 9]
    assert by_bin[1].probabilities == [0.8, 0.2, 0.0]
    assert by_bin[2].predicted_cluster == 3
    assert np.allclose(by_bin[4].probabilities, [13 / 32, 12 / 32, 7 / 32])
    assert by_bin[None].predicted_cluster == 9
    assert "lone" not in {r.segment_group for r in frame.select("segment_group").distinct().collect()}


def test_smoothing(trained):
    _, cells, params, _ = trained
    frame = model.train_bin_model(cells, params, smoothing=1.0)
    by_bin = predicted(frame, "g")
    assert np.allclose(by_bin[1].probabilities, [9 / 13, 3 / 13, 1 / 13])
    assert np.allclose(by_bin[4].probabilities, [1 / 3] * 3)


@pytest.mark.parametrize("group", ["g", "two"])
def test_quality_equals_row_by_row(trained, group):
    rows, _, _, frame = trained
    pairs = expand(rows, group)
    by_bin = predicted(frame, group)
    truth = np.array([c for _, c in pairs])
    guess = np.array([by_bin[b].predicted_cluster for b, _ in pairs])
    probs = np.array([by_bin[b].probabilities for b, _ in pairs])
    classes = by_bin[1].classes

    assert {r.segment_group: r.accuracy for r in model.accuracy(frame).collect()}[group] == pytest.approx((truth == guess).mean())

    aucs, supports = [], []
    for j, c in enumerate(classes):
        pos, neg = probs[truth == c, j], probs[truth != c, j]
        wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
        aucs.append(wins / (len(pos) * len(neg)))
        supports.append(len(pos))
    found = {r.segment_group: r.auroc_weighted_ovr for r in model.auroc(frame).collect()}
    assert found[group] == pytest.approx(np.average(aucs, weights=supports))

    report = {r["class"]: r for r in model.classification_report(frame).where(f"segment_group = '{group}'").collect()}
    per_class = []
    for j, c in enumerate(classes):
        hits = ((truth == c) & (guess == c)).sum()
        precision = hits / (guess == c).sum() if (guess == c).any() else 0.0
        recall = hits / (truth == c).sum()
        f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
        per_class.append((precision, recall, f1))
        r = report[str(j)]
        assert (r.precision, r.recall, r.f1) == pytest.approx(per_class[-1])
        assert r.support == (truth == c).sum()
    assert [report["macro avg"][m] for m in ("precision", "recall", "f1")] == pytest.approx(np.mean(per_class, 0))
    assert [report["weighted avg"][m] for m in ("precision", "recall", "f1")] == pytest.approx(
        np.average(per_class, axis=0, weights=supports)
    )


def test_metadata(trained):
    _, _, params, frame = trained
    record = {r.segment_group: r for r in model.model_metadata(frame, params).collect()}
    assert set(record) == {"g", "two"}
    g = record["g"]
    assert (g.num_samples_trained, g.num_classes, g.num_features) == (32, 3, 4)
    assert g.label_mapping == {0: 3, 1: 5, 2: 9}


def test_scoring_rows_and_rejects(spark, trained):
    _, _, params, frame = trained
    rows = [("g", "f", 0.5), ("g", "f", 3.5), ("g", "f", 99.0), ("g", "f", -5.0), ("g", "f", None), ("x", "f", 1.0), ("lone", "f", 1.0)]
    long = spark.createDataFrame(rows, "segment_group string, feature string, value double")
    scored = model.score_rows(long, params, model.bin_predictions(frame))
    found = {(r.segment_group, r.value): r for r in scored.collect()}
    assert found["g", 0.5].bin == 1 and found["g", 0.5].predicted_cluster == 3
    assert found["g", 0.5].title == "value 0.50: cluster 3"
    assert (found["g", 3.5].bin_lower, found["g", 3.5].bin_upper, found["g", 3.5].bin_third) == (3.0, 4.0, "tail")
    assert found["g", 99.0].bin == 4 and found["g", -5.0].bin == 1
    assert found["g", None].bin is None and found["g", None].predicted_cluster == 9
    for key in (("x", 1.0), ("lone", 1.0)):
        assert found[key].predicted_cluster is None and found[key].reject_reason == "no model or parameters"
    left = model.score_rows(long, params, model.bin_predictions(frame), edge_rule="left")
    assert {r.bin for r in left.where("value = 0.5").collect()} == {1}
    profiles = spark.createDataFrame([("g", "f", 3, 12, [1, 2, 0, 9])], "segment_group string, feature string, cluster int, cluster_total int, cluster_counts array<int>")
    shown = {(r.segment_group, r.value): r for r in model.with_profile(scored, profiles, whole=True).collect()}
    assert (shown["g", 0.5].cluster_total, shown["g", 0.5].cluster_in_bin, shown["g", 0.5].cluster_counts) == (12, 1, [1, 2, 0, 9])
    reasons = {(r.segment_group, r.value): r.reject_reason for r in model.with_profile(scored, profiles).collect()}
    assert reasons["g", 0.5] is None and reasons["g", None] == "no profile of the cluster"


def test_counted_model_is_the_listed_one_without_empty_bins(spark, trained):
    rows, cells, params, listed = trained
    for smoothing in (0.0, 0.5):
        counted = model.count_bin_model(cells, smoothing)
        listed = model.train_bin_model(cells, params, smoothing)
        own = [tuple(r) for r in counted.where("not is_default").drop("is_default").collect()]
        assert set(own) == {tuple(r) for r in listed.where("bin_n > 0").collect()}
        others = {(r.segment_group, r.cluster): r.p for r in counted.where("is_default").collect()}
        assert all(r.p == others[r.segment_group, r.cluster] for r in listed.where("bin_n = 0").collect())
    long = spark.createDataFrame([("g", "f", x / 4) for x in range(-4, 24)] + [("g", "f", None), ("x", "f", 1.0), ("lone", "f", 1.0)], "segment_group string, feature string, value double")
    same = ["segment_group", "value", "bin", "classes", "probabilities", "predicted_cluster", "reject_reason"]
    one, two = ({str(r) for r in model.score_rows(long, params, model.bin_predictions(m)).select(*same).collect()} for m in (counted, listed))
    assert one == two
    assert {str(r) for r in model.accuracy(counted).collect()} == {str(r) for r in model.accuracy(listed).collect()}
    assert {str(r) for r in model.model_metadata(counted, params).collect()} == {str(r) for r in model.model_metadata(listed, params).collect()}


def test_counts_of_the_row_s_bin(spark, trained):
    _, _, params, frame = trained
    long = spark.createDataFrame([("g", "f", 0.5), ("g", "f", 3.5), ("g", "f", None)], "segment_group string, feature string, value double")
    scored = model.score_rows(long, params, model.bin_predictions(frame))
    counts = spark.createDataFrame([("g", "f", 3, 1, 5, 12), ("g", "f", 3, 2, 7, 12)], "segment_group string, feature string, cluster int, bin bigint, n bigint, cluster_total bigint")
    shown = {r.value: r for r in model.with_counts(scored, counts, whole=True).collect()}
    assert (shown[0.5].cluster_total, shown[0.5].cluster_in_bin, [tuple(x) for x in shown[0.5].cluster_counts]) == (12, 5, [(1, 5), (2, 7)])
    assert shown[None].cluster_in_bin is None and shown[None].reject_reason == "no profile of the cluster"
