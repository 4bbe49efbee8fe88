import numpy as np
import pytest

from massif.operators import density

PARAMS = "segment_group string, feature string, mn double, mx double, n_bins int, unit string"
PROFILE = "segment_group string, feature string, cluster int, bin int, n bigint"


def regions(spark, profiles, excluded, n_bins=None, mn=0.0, mx=None):
    n_bins = n_bins or max(len(p) for p in profiles)
    rows = [("g", "f", c, b + 1, int(n)) for c, p in enumerate(profiles) for b, n in enumerate(p)]
    params = spark.createDataFrame([("g", "f", mn, float(mx or n_bins), n_bins, "units")], PARAMS)
    found = density.high_density_region(spark.createDataFrame(rows, PROFILE), params, excluded)
    return {r.cluster: r for r in found.collect()}, found


def scan(counts, excluded):
    """The level, start, end, peak and mass by trying every level."""
    counts = np.asarray(counts, float)
    target = counts.sum() * (100.0 - excluded) / 100.0
    if counts.sum() == 0:
        return 0.0, None
    if target <= 0:
        return counts.max() + 1, None
    level = max(y for y in range(int(counts.max()) + 1) if np.maximum(counts - y, 0).sum() >= target)
    above = [i for i, n in enumerate(counts) if n > level]
    if counts[above].sum() < 2:
        return float(level), None
    blocks, best = [], None
    for i in above:
        if blocks and blocks[-1][-1] == i - 1:
            blocks[-1].append(i)
        else:
            blocks.append([i])
    for block in blocks:
        mass = counts[block].sum()
        if best is None or mass > best[0]:
            best = (mass, block)
    mass, block = best
    peak = block[int(np.argmax(counts[block]))]
    return float(level), (block[0] + 1, block[-1] + 1, peak + 1, mass, counts[peak])


def test_worked_example(spark):
    found, frame = regions(spark, [[10, 20, 50, 15, 5]], 90.0)
    r = found[0]
    assert (r.hdr_threshold_count, r.start_bin, r.end_bin, r.peak_bin, r.mass, r.peak_count) == (40.0, 3, 3, 3, 50.0, 50.0)
    assert (r.start_edge, r.end_edge, r.most_probable, r.median_bin, r.unit) == (2.0, 3.0, 2.5, 3.0, "units")
    profile = density.hdr_profile(frame).first().hdr_profile
    assert profile.hdr_threshold_count == 40.0 and len(profile.hdr_intervals) == 1
    assert profile.hdr_intervals[0].start_bin_label == 3 and profile.hdr_intervals[0].total_mass_in_interval == 50.0


@pytest.mark.parametrize("excluded", [0.0, 10.0, 33.3, 50.0, 75.0, 90.0, 100.0])
def test_closed_form_equals_level_scan(spark, excluded):
    rng = np.random.default_rng(int(excluded))
    profiles = [rng.integers(0, 9, 12) * rng.integers(0, 2, 12) for _ in range(30)]
    profiles += [rng.poisson(40, 15) for _ in range(20)]
    profiles += [[0] * 5, [1], [1, 0, 0], [2], [5, 5, 0, 5, 5], [1, 1, 1]]
    found, _ = regions(spark, profiles, excluded)
    for c, counts in enumerate(profiles):
        level, block = scan(counts, excluded)
        r = found[c]
        assert r.hdr_threshold_count == level, (counts, excluded)
        mine = None if r.start_bin is None else (r.start_bin, r.end_bin, r.peak_bin, r.mass, r.peak_count)
        assert mine == block, (counts, excluded)


def test_first_edge_is_the_published_one(spark):
    found, _ = regions(spark, [[9, 1, 0, 0]], 50.0, mn=0.0, mx=8.0)
    assert found[0].start_edge == pytest.approx(-0.008) and found[0].end_edge == 2.0


def test_bins_beyond_the_edges_give_no_region(spark):
    found, frame = regions(spark, [[0, 0, 0, 9]], 50.0, n_bins=3)
    assert found[0].start_bin is None and found[0].hdr_threshold_count == 4.0
    assert density.hdr_profile(frame).first().hdr_profile.hdr_intervals == []


def test_box_whiskers(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 100.0, -50.0]
    df = spark.createDataFrame([("g", v) for v in values], "k string, v double")
    r = density.box_stats(df, ["k"], "v").first()
    assert (r.q25, r.median, r.q75, r.whisker_low, r.whisker_high, r.outliers) == (2.0, 4.0, 6.0, 1.0, 7.0, 2)
