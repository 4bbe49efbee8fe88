import pytest

from massif.operators import kselect

SCHEMA = "segment_group string, feature string, k int, silhouette double"


def scores(spark, **segments):
    rows = [(g, "f", k, s) for g, values in segments.items() for k, s in values.items()]
    return spark.createDataFrame(rows, SCHEMA)


def as_dict(df):
    out = {}
    for r in df.orderBy("k").collect():
        out.setdefault(r.segment_group, {})[r.k] = r.silhouette
    return out


def test_scores_start_at_the_first_peak(spark):
    given = scores(
        spark,
        a={2: 0.5, 3: 0.6, 4: 0.55, 5: 0.4},
        tie={2: 0.601, 3: 0.604, 4: 0.1},
        gaps={2: None, 3: float("nan"), 4: 0.2, 5: 0.3},
        none={2: None},
        even={2: 0.125, 3: 0.115, 4: 0.12},
    )
    assert as_dict(kselect.from_first_peak(given)) == {
        "a": {3: 0.6, 4: 0.55, 5: 0.4},
        "tie": {2: 0.601, 3: 0.604, 4: 0.1},
        "gaps": {5: 0.3},
        "even": {2: 0.125, 3: 0.115, 4: 0.12},
    }


def test_optimal_k_walks_while_the_drop_is_small(spark):
    given = scores(
        spark,
        segment1={2: 0.5, 3: 0.6, 4: 0.55, 5: 0.4},
        segment2={2: 0.3, 3: 0.35, 4: 0.32, 5: 0.2},
        stops={2: 0.5, 3: 0.3, 4: 0.9},
        zero_up={2: 0.0, 3: 0.4},
        zero_down={2: 0.0, 3: -0.1, 4: 0.5},
        single={4: 0.2},
        negative={2: -0.2, 3: -0.21, 4: -0.5},
    )
    found = {r.segment_group: r.k for r in kselect.optimal_k(given, 0.1).collect()}
    assert found == {
        "segment1": 4, "segment2": 4, "stops": 2, "zero_up": 3, "zero_down": 2, "single": 4, "negative": 3,
    }


def test_both_steps_together(spark):
    given = scores(spark, s={2: 0.9, 3: 0.5, 4: 0.89, 5: 0.1})
    assert kselect.optimal_k(kselect.from_first_peak(given), 0.05).first().k == 2


def test_elbow_drops_missing_and_flags_current(spark):
    rows = [("g", "f", 2, 9.0), ("g", "f", 3, 4.0), ("g", "f", 4, None), ("g", "f", 5, float("nan"))]
    given = spark.createDataFrame(rows, "segment_group string, feature string, k int, wcss double")
    chosen = spark.createDataFrame([("g", "f", 3)], "segment_group string, feature string, k int")
    found = [(r.k, r.wcss, r.is_current) for r in kselect.elbow(given, chosen).orderBy("k").collect()]
    assert found == [(2, 9.0, False), (3, 4.0, True)]


@pytest.mark.parametrize("limit,expected", [(0.0, 3), (0.09, 4), (1.0, 5)])
def test_limit(spark, limit, expected):
    given = scores(spark, s={2: 0.5, 3: 0.6, 4: 0.55, 5: 0.4})
    assert kselect.optimal_k(given, limit).first().k == expected
