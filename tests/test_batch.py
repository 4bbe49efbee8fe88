import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from massif.operators import bounded
from massif.operators.segments import KEYS
from massif.plans.batch import analyze, run_all, save
from massif.plans.spec import AnalysisSpec
from massif.sources.runs import find_latest_run, gather_artifacts
from massif.sources.tables import read_table
from massif.streaming import score as streaming


def trips(seed=2, rows=1500):
    """Trips by route, weekday and weight; heavy trucks are slow, some values are missing."""
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(
        {
            "trip": np.arange(rows),
            "route": rng.choice(["north", "south"], rows).astype(object),
            "weekday": rng.integers(1, 6, rows),
            "weight": rng.choice(["light", "heavy"], rows).astype(object),
            "weight_kg": rng.normal(900, 50, rows),
        }
    )
    pdf["hours"] = np.where(pdf["weight"] == "heavy", rng.normal(9, 1, rows), rng.normal(4, 1, rows))
    pdf.loc[::31, "hours"] = np.nan
    pdf.loc[::13, "route"] = None
    pdf.loc[::17, "weight"] = None
    pdf.loc[0, "weekday"] = 77
    return pdf


SPEC = AnalysisSpec(
    name="trips",
    grouping="route",
    categorical=["weekday", "weight"],
    continuous=["hours", "weight_kg"],
    units={"hours": "h"},
    min_combination_size=5,
    min_k=2,
    max_k=4,
    hdr_excluded_percent=50.0,
)


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(trips())


@pytest.fixture(scope="module")
def result(data):
    return analyze(data, SPEC)


def test_segments_include_the_null_group(result):
    params = result["bin_params"].toPandas()
    assert set(zip(params["segment_group"], params["feature"])) == {
        (g, f) for g in ("north", "south", "NaN") for f in ("hours", "weight_kg")
    }
    assert set(params.loc[params["feature"] == "hours", "unit"]) == {"h"}


def test_rare_combination_is_dropped(result):
    kept = result["combos"].toPandas()
    assert 77 not in set(kept["weekday"])
    # five weekdays by light, heavy and missing weight
    assert len(kept) == 15 and sorted(kept["comb"]) == list(range(1, 16))
    assert result["filtered"].count() == kept["n"].sum() == 1499
    assert tuple(result["retention"].first())[:2] == (1499, 1500)


def test_profiles_account_for_every_row(result, data):
    cells = result["comb_profile"].groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("bin").isNull(), F.col("n"))).alias("missing"))
    for r in cells.collect():
        group = F.col("route").isNull() if r.segment_group == "NaN" else F.col("route") == r.segment_group
        rows = result["filtered"].where(group)
        assert r.n == rows.count()
        assert (r.missing or 0) == rows.where(F.col(r.feature).isNull()).count()
    clustered = result["cluster_profile"].groupBy(*KEYS).agg(F.sum("n").alias("n"))
    binned = result["comb_profile"].where("bin is not null").groupBy(*KEYS).agg(F.sum("n").alias("m"))
    assert clustered.join(binned, KEYS).where("n <> m").isEmpty()


def test_clusters_separate_light_from_heavy(result):
    cats = result["combos"].select("comb", "weight")
    hours = result["comb_cluster"].where("feature = 'hours' and segment_group = 'north'").join(cats, "comb").toPandas()
    means = {r.comb: r.m for r in result["filtered"].groupBy("comb").agg(F.avg("hours").alias("m")).collect()}
    hours["mean"] = hours["comb"].map(means)
    ordered = hours.groupby("cluster")["mean"].mean()
    assert ordered.is_monotonic_increasing
    light, heavy = (set(hours.loc[hours["weight"] == w, "cluster"]) for w in ("light", "heavy"))
    assert not light & heavy


def test_optimal_k_is_flagged_once_per_segment(result):
    flagged = result["k_scores"].where("is_optimal").groupBy(*KEYS).count().toPandas()
    assert len(flagged) == 6 and (flagged["count"] == 1).all()


def test_without_grouping_or_columns(data):
    spec = AnalysisSpec(name="plain", categorical=["weekday"], min_combination_size=5, max_k=3, n_bins=8)
    out = analyze(data, spec)
    params = out["bin_params"].toPandas()
    assert set(params["segment_group"]) == {"all_data"} and set(params["n_bins"]) == {8}
    # without listed measures all numeric columns but the categoricals are analysed
    assert set(params["feature"]) == {"trip", "weight_kg", "hours"}


def test_single_combination_ends_without_clusters(data):
    out = analyze(data, AnalysisSpec(name="one", continuous=["hours"], min_combination_size=1))
    assert out["comb_profile"].count() > 1
    for name in ("k_labels", "k_scores", "comb_cluster", "cluster_profile", "hdr", "bin_model", "model_metadata"):
        assert out[name].isEmpty(), name


def test_chosen_groups(data):
    spec = AnalysisSpec(name="some", grouping="route", groups=["NaN", "south"], categorical=["weekday"], continuous=["hours"], min_combination_size=5, max_k=3)
    out = analyze(data, spec)
    assert {r.segment_group for r in out["bin_params"].collect()} == {"NaN", "south"}
    assert {r.segment_group for r in out["initial_density"].collect()} == {"NaN", "south"}
    # the cut-off and the kept combinations look at all groups
    assert out["filtered"].count() == 1499


def test_errors(data):
    with pytest.raises(ValueError, match="minimum combination size"):
        analyze(data, AnalysisSpec(categorical=["weekday"], continuous=["hours"], min_combination_size=10**6))
    with pytest.raises(ValueError, match="groups left"):
        analyze(data, AnalysisSpec(grouping="route", groups=["east"], categorical=["weekday"], continuous=["hours"], min_combination_size=1))
    with pytest.raises(ValueError, match="continuous"):
        analyze(data.select("route", "weight"), AnalysisSpec(categorical=["weight"]))
    with pytest.raises(ValueError, match="aggregation"):
        analyze(data.withColumn("flat", F.lit(1.0)), AnalysisSpec(categorical=["weekday"], continuous=["flat"], min_combination_size=1))


def test_saved_run_reads_back_and_scores_a_stream(spark, data, result, tmp_path):
    folder = str(tmp_path / "out")
    save(result, folder, ["parquet", "csv"])
    assert find_latest_run(spark, folder) == result.run_id
    assert read_table(spark, folder, "hdr", result.run_id).count() == result["hdr"].count()
    documents = [
        json.loads(line)
        for r in gather_artifacts(spark, f"{folder}/profile_documents", "json").collect()
        for line in r.content.splitlines()
    ]
    assert {d["segment_name"] for d in documents} == {f"{g}_{f}" for g in ("north", "south", "NaN") for f in ("hours", "weight_kg")}
    for d in documents:
        axis = d["axis"]
        assert axis["edges"] == d["quantization_bins"] + 1 and axis["first_edge"] < axis["minimum"] < axis["maximum"]
        assert axis["minimum"] + axis["step"] * d["quantization_bins"] == pytest.approx(axis["maximum"])
        assert len(d["clusters"]) == d["optimal_k_used"]
        for c in d["clusters"]:
            # runs follow each other without gaps over the whole axis
            ends = [0, *(r["last_bin"] for r in c["bin_profiles"])]
            assert [r["first_bin"] - 1 for r in c["bin_profiles"]] == ends[:-1] and ends[-1] == d["quantization_bins"]

    scoring = streaming.load_scoring_tables(spark, folder)
    assert scoring.spec == SPEC and scoring.run_id == result.run_id
    pdf = trips(seed=9, rows=400)
    pdf.loc[3, "route"] = "unheard"
    pdf.loc[5] = None
    incoming = tmp_path / "incoming"
    incoming.mkdir()
    columns = ["trip", "route", "weekday", "weight", "weight_kg", "hours"]
    schema = "trip double, route string, weekday double, weight string, weight_kg double, hours double"

    def arrive(name, part):
        rows = [tuple(None if pd.isna(v) else v for v in r) for r in part[columns].astype(object).itertuples(index=False)]
        rows = [tuple(float(v) if isinstance(v, (int, np.integer)) else v for v in r) for r in rows]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(incoming / name))

    for i in range(3):
        arrive(f"p{i}", pdf.iloc[i * 100 : (i + 1) * 100])

    def run():
        rows = streaming.read_rows(spark, str(incoming / "p*"), schema, "parquet", files_per_batch=1)
        query = streaming.start_scoring(rows, scoring, f"{folder}/scored_stream", f"{folder}/checkpoint", available_now=True)
        query.awaitTermination()
        results = f"{folder}/scored_stream"
        return streaming.read_results(spark, results), streaming.read_results(spark, results, "rejected")

    good, bad = run()
    # two measures per row; one row has no known group, one no content, all others score
    assert good.count() == 2 * 298 and bad.count() == 4
    reasons = {(r.reject_reason, r.instance.route) for r in bad.collect()}
    assert reasons == {("no model or parameters", "unheard"), ("no payload", None)}
    assert good.where("segment_group = 'NaN'").count() > 0
    assert good.where("processed_at is null or run_id is null or source <> 'stream'").isEmpty()

    # what arrives later is scored by a restarted query, once
    arrive("p3", pdf.iloc[300:])
    good, bad = run()
    assert good.count() == 2 * 398 and bad.count() == 4

    batch = streaming.score(spark.read.schema(schema).parquet(str(incoming / "p*")), scoring)
    same = ["run_id", "instance", "segment_group", "feature", "bin", "predicted_cluster", "probabilities", "title", "cluster_total", "cluster_in_bin"]
    assert sorted(map(str, good.select(*same).collect())) == sorted(
        map(str, batch.where("reject_reason is null").select(*same).collect())
    )


def test_stream_without_grouping_or_with_a_missing_column(spark, data, result, tmp_path):
    folder = str(tmp_path / "out")
    save(result, folder)
    scoring = streaming.load_scoring_tables(spark, folder, result.run_id)
    scored = streaming.score(spark.createDataFrame(trips(rows=50)).drop("route"), scoring)
    assert {r.reject_reason for r in scored.select("reject_reason").distinct().collect()} == {"no grouping column"}
    with pytest.raises(FileNotFoundError):
        streaming.load_scoring_tables(spark, folder, "20000101_000000_run_x")
    plain = analyze(data, AnalysisSpec(name="plain", categorical=["weekday", "weight"], continuous=["hours"], min_combination_size=5, max_k=3))
    save(plain, folder)
    scoring = streaming.load_scoring_tables(spark, folder, plain.run_id)
    scored = streaming.score(spark.createDataFrame(trips(rows=50)), scoring)
    assert scored.where("reject_reason is not null").isEmpty() and scored.count() == 50

    incoming = tmp_path / "csv"
    incoming.mkdir()
    trips(rows=50)[["trip", "hours"]].to_csv(incoming / "a.csv", index=False)
    rows = streaming.read_rows(spark, str(incoming), "trip bigint, hours double")
    streaming.start_scoring(rows, scoring, f"{folder}/s", f"{folder}/c", available_now=True, source="a.csv").awaitTermination()
    found = streaming.read_results(spark, f"{folder}/s")
    assert found.count() == 50 and found.where("source = 'a.csv'").count() == 50
    assert found.where("value is null and bin is null and predicted_cluster is not null").count() == 2
    with pytest.raises(ValueError):
        streaming.read_results(spark, f"{folder}/s", "lost")


def test_rows_that_cannot_be_read_are_rejects(spark, data, result, tmp_path):
    folder = str(tmp_path / "out")
    plain = analyze(data, AnalysisSpec(name="plain", categorical=["weekday", "weight"], continuous=["hours"], min_combination_size=5, max_k=3))
    save(plain, folder)
    scoring = streaming.load_scoring_tables(spark, folder)
    for source, lines in {
        "csv": ["trip,hours", "1,2.5", "2,soon", "3,2.5,more", ",", '4,"2.5', "5,2.5"],
        "json": ['{"trip": 1, "hours": 2.5}', '{"trip": 2, "hours": "soon"}', '{"trip": 3, "hours"', "{}", "[4", '{"trip": 5, "hours": 2.5}'],
    }.items():
        incoming = tmp_path / source
        incoming.mkdir()
        (incoming / "rows").write_text("\n".join(lines) + "\n")
        rows = streaming.read_rows(spark, str(incoming), "trip bigint, hours double", source)
        out = f"{folder}/{source}"
        streaming.start_scoring(rows, scoring, out, f"{folder}/{source}_state", available_now=True).awaitTermination()
        good, bad = streaming.read_results(spark, out).collect(), streaming.read_results(spark, out, "rejected").collect()
        assert sorted(r.instance.trip for r in good) == [1, 5] and all(r.predicted_cluster is not None for r in good)
        assert sorted(r.reject_reason for r in bad) == ["malformed row"] * 3 + ["no payload"]
        broken = [r for r in bad if r.reject_reason == "malformed row"]
        assert all(r.instance.corrupt_record in lines and r.predicted_cluster is None and r.bin is None for r in broken)

    text = spark.createDataFrame([(1, "2.5"), (2, "soon"), (3, None), (4, "NaN")], "trip int, hours string")
    found = {r.instance.trip: r for r in streaming.score(text, scoring).collect()}
    assert found[2].reject_reason == "measure is no number" and found[2].predicted_cluster is None and found[2].title is None
    assert all(found[t].reject_reason is None and found[t].predicted_cluster is not None for t in (1, 3, 4))


def test_several_analyses_in_order(spark, data, tmp_path):
    path = str(tmp_path / "trips.parquet")
    data.write.parquet(path)
    specs = [
        AnalysisSpec(name=n, input_path=path, categorical=["weekday"], continuous=[m], min_combination_size="p15", max_k=3)
        for n, m in (("first", "hours"), ("second", "weight_kg"))
    ]
    done = run_all(spark, specs, str(tmp_path / "out"))
    assert list(done) == ["first", "second"]
    assert spark.read.parquet(str(tmp_path / "out" / "runs")).count() == 2
    with pytest.raises(ValueError):
        run_all(spark, [AnalysisSpec(name="nameless")], str(tmp_path / "out"))


def test_stored_tables_and_shuffle_joins_give_the_same_result(spark, data, result, monkeypatch):
    """Nothing fits the driver or a broadcast: every settled table is stored, every join shuffles."""
    monkeypatch.setattr(bounded.settle, "__defaults__", (0, 0))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = analyze(data, SPEC)
        for name in ("combos", "comb_profile", "k_labels", "hdr", "cluster_describe", "composition", "model_metadata"):
            mine, usual = (
                sorted(
                    tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r)
                    for r in frame.select(sorted(frame.columns)).collect()
                )
                for frame in (out[name], result[name])
            )
            assert mine == usual, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_found_measures_and_absent_columns_can_be_scored(spark, data, tmp_path):
    """What the run resolved is what it stores: measures found, no grouping, known categoricals."""
    folder = str(tmp_path / "out")
    spec = AnalysisSpec(name="found", grouping="nowhere", categorical=["weekday", "weight", "unknown"], min_combination_size=5, max_k=3)
    run = analyze(data.select("weekday", "weight", "hours", "weight_kg"), spec)
    save(run, folder)
    scoring = streaming.load_scoring_tables(spark, folder)
    assert (scoring.spec.continuous, scoring.spec.grouping, scoring.spec.categorical) == (["hours", "weight_kg"], None, ["weekday", "weight"])
    rows = spark.createDataFrame(trips(rows=40))
    assert streaming.score(rows, scoring).where("reject_reason is not null").isEmpty()
    found = streaming.score(rows.drop("hours"), scoring).groupBy("feature", "reject_reason").count().collect()
    assert {tuple(r) for r in found} == {("hours", "measure absent", 40), ("weight_kg", None, 40)}
    for name in ("silhouette_samples", "projection"):
        assert read_table(spark, folder, name, run.run_id).count() > 0


def test_infinite_measure_leaves_the_other_segments(data):
    endless = data.withColumn("hours", F.when(F.col("trip") == 7, float("inf")).otherwise(F.col("hours")))
    out = analyze(endless, AnalysisSpec(categorical=["weekday", "weight"], continuous=["hours", "weight_kg"], min_combination_size=5, max_k=3))
    assert {r.feature for r in out["bin_params"].collect()} == {"weight_kg"}


def test_one_outlier_leaves_a_long_axis_and_short_tables(spark, data, tmp_path):
    """A range of 1e12 quartile distances: as many bins, but rows for counted bins and stretches only."""
    folder = str(tmp_path / "out")
    far = data.withColumn("hours", F.when(F.col("trip") == 7, 1e13).otherwise(F.col("hours")))
    spec = AnalysisSpec(name="far", categorical=["weekday", "weight"], continuous=["hours", "weight_kg"], min_combination_size=5, max_k=3)
    out = analyze(far, spec)
    params = {r.feature: r for r in out["bin_params"].collect()}
    assert params["hours"].n_bins > 1e12 and params["weight_kg"].n_bins < 1000
    save(out, folder)
    axes = out["cluster_counts"].groupBy("feature", "cluster").agg(F.count("*").alias("runs"), F.sum(F.col("last_bin") - F.col("first_bin") + 1).alias("bins"))
    for r in axes.collect():
        assert r.bins == params[r.feature].n_bins and r.runs < 4000
    assert out["hdr"].where("feature = 'hours' and start_bin is not null").count() > 0
    assert out["bin_model"].count() < 10_000
    scoring = streaming.load_scoring_tables(spark, folder)
    rows = spark.createDataFrame([(1.0, "light", 5e12, 1.0), (1.0, "light", 1e13, 1.0)], "weekday double, weight string, hours double, weight_kg double")
    found = {r.value: r for r in streaming.score(rows, scoring).where("feature = 'hours'").collect()}
    # a bin without training rows has the shares of the segment, and no row of the cluster
    empty = found[5e12]
    assert empty.reject_reason is None and empty.cluster_in_bin == 0 and sum(empty.probabilities) == pytest.approx(1.0)
    assert found[1e13].bin == params["hours"].n_bins and found[1e13].cluster_in_bin >= 1


def test_a_range_that_no_double_can_cut_leaves_the_other_segments(data):
    far = data.withColumn("hours", F.when(F.col("trip") == 7, 1e300).otherwise(F.col("hours")))
    out = analyze(far, AnalysisSpec(categorical=["weekday", "weight"], continuous=["hours", "weight_kg"], min_combination_size=5, max_k=3))
    assert {r.feature for r in out["bin_params"].collect()} == {"weight_kg"}
    assert out["hdr"].count() > 0


def test_unknown_categoricals_are_left_out_with_a_warning(data, caplog):
    out = analyze(data, AnalysisSpec(categorical=["weekday", "nope"], continuous=["hours"], min_combination_size=5, max_k=3))
    assert out.spec.categorical == ["weekday"] and "nope" in caplog.text
