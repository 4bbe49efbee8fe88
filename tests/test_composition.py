import numpy as np
import pandas as pd
import pytest

from massif.operators import composition

MAP = "segment_group string, feature string, comb bigint, cluster int"


@pytest.fixture(scope="module")
def parts(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame(
        {
            "segment_group": rng.choice(["a", "b"], 400),
            "comb": rng.integers(1, 7, 400),
            "v": rng.normal(1e6, 1, 400),
            "w": rng.integers(0, 9, 400).astype(float),
        }
    )
    pdf.loc[::17, "v"] = np.nan
    combos = spark.createDataFrame(
        [(c, int((pdf["comb"] == c).sum()), None if c == 2 else f"x{c % 2}", c) for c in range(1, 7)],
        "comb bigint, n bigint, kind string, number int",
    )
    mapping = [(g, "f", c, c % 2 if g == "a" else c // 4) for g in "ab" for c in range(1, 7) if (g, c) != ("b", 6)]
    return pdf, spark.createDataFrame(pdf), combos, spark.createDataFrame(mapping, MAP), mapping


@pytest.mark.parametrize("scope", ["all", "segment"])
@pytest.mark.parametrize("group_rows", [10**6, 20])
def test_describe_equals_pandas(parts, scope, group_rows):
    pdf, rows, _, frame, mapping = parts
    found = {
        (r.segment_group, r.cluster, r.column): r
        for r in composition.cluster_describe(rows, frame, ["v", "w", "absent"], scope, group_rows).collect()
    }
    clusters = {(g, c) for g, _, _, c in mapping}
    assert set(found) == {(g, c, m) for g, c in clusters for m in ("v", "w")}
    for g, c in clusters:
        combs = [m[2] for m in mapping if m[0] == g and m[3] == c]
        part = pdf[pdf["comb"].isin(combs)]
        if scope == "segment":
            part = part[part["segment_group"] == g]
        described = part[["v", "w"]].describe()
        for m in ("v", "w"):
            r = found[g, c, m]
            mine = [r["count"], r["mean"], r["std"], r["min"], r["p25"], r["p50"], r["p75"], r["max"]]
            assert np.allclose(mine, described[m], rtol=1e-9)


def test_composition_counts_every_value_in_every_cluster(parts):
    _, _, combos, frame, mapping = parts
    table = composition.cluster_composition(combos, frame, ["kind", "number"]).toPandas()
    sizes = {r.comb: (r.n, r.kind, r.number) for r in combos.collect()}
    for (g, c), part in table.groupby(["segment_group", "cluster"]):
        combs = [m[2] for m in mapping if m[0] == g and m[3] == c]
        total = sum(sizes[k][0] for k in combs)
        assert (part["total_rows"] == total).all()
        values = {("kind", "x0"), ("kind", "x1")} | {("number", str(i)) for i in range(1, 7)}
        assert set(zip(part["column"], part["value"])) == values
        for r in part.itertuples():
            at = 1 if r.column == "kind" else 2
            expected = sum(sizes[k][0] for k in combs if str(sizes[k][at]) == r.value)
            assert r.count == expected
            assert r.percentage == np.round(expected / total * 100, 2)


def test_union_and_documents(parts):
    _, rows, combos, frame, _ = parts
    counted = composition.cluster_composition(combos, frame, ["kind"])
    described = composition.cluster_describe(rows, frame, ["v"])
    both = composition.composition_union(counted, described)
    assert both.where("feature_value is null").count() == described.count()
    assert both.where("mean is null").count() == counted.count()
    document = composition.composition_documents(counted).where("segment_group = 'a' and cluster = 1").first()
    assert set(document.composition) == {"kind_x0", "kind_x1"}
    assert document.composition["kind_x0"]["count"] == 0
    with pytest.raises(ValueError):
        composition.cluster_composition(combos, frame, ["kind"], scope="some")
    with pytest.raises(ValueError):
        composition.cluster_describe(rows, frame, ["v"], scope="some")
