from __future__ import annotations

import pytest

from massif.operators import profiles

PROFILE = "segment_group string, feature string, cluster int, bin bigint, n bigint"
PARAMS = "segment_group string, feature string, mn double, mx double, n_bins bigint, unit string"


def test_runs_cover_the_axis_once(spark):
    cells = {1: [(3, 5), (4, 1), (9, 2)], 2: [(1, 4)], 3: [(12, 1)], 4: [(b, b) for b in range(1, 13)]}
    rows = [("g", "f", c, b, n) for c, of in cells.items() for b, n in of] + [("g", "f", 1, None, 8), ("h", "f", 1, 10**12, 3)]
    params = spark.createDataFrame([("g", "f", 0.0, 12.0, 12, "u"), ("h", "f", 0.0, 1.0, 10**12 + 5, "u")], PARAMS)
    profile = spark.createDataFrame(rows, PROFILE)
    runs = {}
    for r in profiles.run_profile(profile, params).collect():
        runs.setdefault((r.segment_group, r.cluster), []).append((r.first_bin, r.last_bin, r.n))
    assert sorted(runs["g", 1]) == [(1, 2, 0), (3, 3, 5), (4, 4, 1), (5, 8, 0), (9, 9, 2), (10, 12, 0)]
    assert sorted(runs["g", 2]) == [(1, 1, 4), (2, 12, 0)] and sorted(runs["g", 3]) == [(1, 11, 0), (12, 12, 1)]
    assert sorted(runs["g", 4]) == [(b, b, b) for b in range(1, 13)]
    assert sorted(runs["h", 1]) == [(1, 10**12 - 1, 0), (10**12, 10**12, 3), (10**12 + 1, 10**12 + 5, 0)]
    dense = {(r.cluster, r.bin): r.n for r in profiles.dense_profile(profile.where("segment_group = 'g'"), params).collect()}
    assert dense == {(c, b): dict(of).get(b, 0) for c, of in cells.items() for b in range(1, 13)}
    shares = profiles.profile_share(profiles.run_profile(profile.where("segment_group = 'g'"), params)).collect()
    assert sum(r.percentage for r in shares) == pytest.approx(400.0)
    assert profiles.run_profile(profile.limit(0), params).count() == 0


def test_a_wide_view_has_a_limit(spark):
    profile = spark.createDataFrame([("g", "f", 1, 1, 1)], PROFILE)
    with pytest.raises(ValueError):
        profiles.wide_profile(profile, 10**6)
