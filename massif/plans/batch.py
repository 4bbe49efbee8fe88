"""The batch analysis: from a table of rows to clustered, described distributions."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massif.operators import binning, clustering, combos, composition, density, kselect, model, profiles, segments, silhouette
from massif.operators.bounded import settle, stored
from massif.operators.segments import KEYS
from massif.plans.spec import AnalysisSpec
from massif.sources.tables import load_table, nan_to_null, numeric_columns, write_json, write_table

log = logging.getLogger(__name__)


class Analysis:
    """The result tables of one analysis, each computed when first asked for.

    A table is built by the maker of that name, which may ask for other tables.
    """

    def __init__(self, spec: AnalysisSpec, run_id: str, threshold: int, makers: dict[str, Callable[[], DataFrame]]):
        self.spec = spec
        self.run_id = run_id
        self.threshold = threshold
        self._makers = makers
        self._tables: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self._makers[name]()
        return self._tables[name]

    @property
    def names(self) -> list[str]:
        return list(self._makers)


def run_id_for(spec: AnalysisSpec, moment: datetime | None = None) -> str:
    moment = moment or datetime.now(timezone.utc)
    return f"{moment:%Y%m%d_%H%M%S}_run_{spec.name}"


@dataclass
class Prepared:
    """What the first pass over the input gives."""

    cells: DataFrame
    sizes: DataFrame
    threshold: int
    kept: DataFrame
    kept_cells: DataFrame
    filtered: DataFrame


def prepare(df: DataFrame, spec: AnalysisSpec, measures: list[str], grouping: str | None) -> Prepared:
    """Cells, cut-off, kept combinations and the filtered rows with their combination id.

    One pass over the input summarises each (group, combination); sizes, cut-off,
    composition counts and segment statistics all follow from those cells. A
    second pass writes the filtered rows, reduced to the columns in use, for the
    steps that need values.
    """
    cats = spec.categorical
    cells = settle(binning.cell_stats(df, measures, grouping, cats))
    sizes = settle(cells.groupBy(*cats).agg(F.sum("n").alias("n")))
    threshold = combos.cutoff(sizes, spec.min_combination_size)
    kept = settle(combos.number_combos(sizes.where(F.col("n") >= threshold), cats))
    if kept.isEmpty():
        raise ValueError(f"No combination reaches the minimum combination size of {threshold}.")
    columns = list(dict.fromkeys(c for c in [grouping, *cats, *measures] if c))
    filtered = stored(combos.with_comb(df.select(*columns), kept, cats), "filtered")
    return Prepared(cells, sizes, threshold, kept, settle(combos.with_comb(cells, kept, cats)), filtered)


def analyze(df: DataFrame, spec: AnalysisSpec, threads: int = 8, run_id: str | None = None) -> Analysis:
    """Run every step of the analysis on a table of rows."""
    spark = df.sparkSession
    df = nan_to_null(df)
    measures = [m for m in spec.continuous if m in df.columns] or numeric_columns(df, spec.categorical)
    measures = [m for m in measures if m != spec.grouping]
    grouping = segments.check_roles(df, spec.grouping, spec.categorical, measures)
    unknown = [c for c in spec.categorical if c not in df.columns]
    if unknown:
        log.warning("categorical columns that the rows lack are left out: %s", ", ".join(unknown))
        spec = replace(spec, categorical=[c for c in spec.categorical if c in df.columns])
    run_id = run_id or run_id_for(spec)

    base = prepare(df, spec, measures, grouping)
    kept, filtered = base.kept, base.filtered
    in_scope = segments.select_groups(filtered, grouping, spec.groups)
    long = segments.to_long(in_scope, measures, grouping, ["comb"])
    kept_cells = segments.select_groups(base.kept_cells, "segment_group", spec.groups if grouping else ())
    stats = settle(binning.stats_from_cells(kept_cells, measures))
    if stats.isEmpty():
        raise ValueError("The selection of groups left no rows: no groups left to analyse.")
    params = binning.bin_params(long, spec.n_bins, spec.units, stats=stats)
    if params.isEmpty():
        raise ValueError("No segment can be cut into bins; aggregation leaves nothing to cluster.")

    profile = settle(profiles.comb_profile(binning.quantize(long, params)))
    cats = spec.categorical
    group_names = spec.value_names.get(spec.grouping or "", {})

    def initial_density():
        initial = segments.to_long(segments.select_groups(df, grouping, spec.groups), measures, grouping)
        all_cells = segments.select_groups(base.cells, "segment_group", spec.groups if grouping else ())
        seen = settle(binning.stats_from_cells(all_cells, measures))
        cut = binning.bin_params(initial, spec.n_bins, spec.units, stats=seen)
        return density.density_histogram(initial, seen, cut, group_names, spec.column_names)

    def optimal_k():
        peaked = kselect.from_first_peak(made["k_metrics"])
        return settle(kselect.optimal_k(peaked, spec.max_drop_percent / 100.0))

    def flagged_scores():
        best = made["optimal_k"].select(*KEYS, F.col("k").alias("best"))
        is_optimal = F.coalesce(F.col("k") == F.col("best"), F.lit(False))
        return made["k_metrics"].join(best, KEYS, "left").withColumn("is_optimal", is_optimal).drop("best")

    def clustered():
        return settle(profiles.cluster_profile(profile.join(made["comb_cluster"], [*KEYS, "comb"])))

    def at_best():
        return made["k_labels"].join(made["optimal_k"].select(*KEYS, "k"), [*KEYS, "k"])

    makers: dict[str, Callable[[], DataFrame]] = {
        "initial_density": initial_density,
        "comb_size_stats": lambda: combos.size_stats(base.sizes),
        "retention": lambda: combos.retention(base.sizes, base.threshold),
        "combos": lambda: kept,
        "comb_cells": lambda: base.kept_cells.select("segment_group", "comb", "n"),
        "filtered": lambda: filtered,
        "bin_params": lambda: binning.with_axis(params),
        "comb_profile": lambda: profile,
        "k_labels": lambda: clustering.sweep_labels(profile, params, spec.min_k, spec.max_k, threads),
        "k_metrics": lambda: settle(clustering.k_scores(profile, made["k_labels"])),
        "optimal_k": optimal_k,
        "k_scores": flagged_scores,
        "comb_cluster": lambda: settle(clustering.final_clusters(profile, made["k_labels"], made["optimal_k"])),
        "filled_counts": clustered,
        "cluster_counts": lambda: settle(profiles.run_profile(made["filled_counts"], params)),
        "cluster_profile": lambda: profiles.profile_share(made["cluster_counts"]),
        "hdr": lambda: settle(
            density.high_density_region(made["filled_counts"], params, spec.hdr_excluded_percent)
        ),
        "cluster_describe": lambda: settle(composition.cluster_describe(filtered, made["comb_cluster"], measures)),
        "bin_model": lambda: settle(
            model.count_bin_model(model.training_cells(profile, made["comb_cluster"]))
        ),
        "silhouette_samples": lambda: silhouette.order_samples(settle(silhouette.silhouette_samples(profile, at_best()))),
        "projection": lambda: clustering.project_2d(profile, params, made["comb_cluster"]),
        "model_metadata": lambda: model.model_metadata(made["bin_model"], params),
        "classification_report": lambda: model.classification_report(made["bin_model"]),
        "profile_documents": lambda: profiles.profile_documents(
            made["cluster_counts"], params, density.hdr_profile(made["hdr"]), made["optimal_k"]
        ),
        # the stored parameters are those in effect, so that the run can be scored
        "runs": lambda: run_summary(spark, replace(spec, continuous=measures, grouping=grouping), run_id, measures, base.threshold),
    }
    if cats:
        makers["composition"] = lambda: settle(composition.cluster_composition(kept, made["comb_cluster"], cats))
        makers["composition_union"] = lambda: composition.composition_union(
            made["composition"], made["cluster_describe"]
        )
        makers["composition_documents"] = lambda: composition.composition_documents(made["composition"])
    made = Analysis(spec, run_id, base.threshold, makers)
    return made


def run_summary(spark: SparkSession, spec: AnalysisSpec, run_id: str, measures: list[str], threshold: int) -> DataFrame:
    """The one-row record that marks a run as done and keeps its parameters."""
    row = (
        run_id,
        spec.name,
        "done",
        spec.input_path,
        spec.grouping or "N/A",
        ", ".join(spec.groups) or "all_available_groups_processed",
        list(spec.categorical),
        list(measures),
        threshold,
        spec.to_json(),
    )
    return spark.createDataFrame(
        [row],
        "run_id string, config_name string, status string, input_path string, grouping_column string, "
        "filter_values string, categorical_columns array<string>, continuous_columns array<string>, "
        "min_combination_size bigint, parameters string",
    )


# tables that others repeat with more columns
STEPS_ONLY = ("k_metrics", "cluster_counts", "filled_counts")
JSON_TABLES = ("profile_documents", "composition_documents")


def save(analysis: Analysis, folder: str, formats: Iterable[str] = ("parquet",)) -> str:
    """Write all tables of a run; the run record comes last and marks it as done."""
    for name in analysis.names:
        if name in ("runs", *STEPS_ONLY):
            continue
        table = analysis[name]
        if name in JSON_TABLES:
            write_json(table, folder, name, analysis.run_id)
            continue
        # nested columns cannot go to CSV
        flat = all(f.dataType.typeName() not in ("array", "map", "struct") for f in table.schema.fields)
        write_table(table, folder, name, analysis.run_id, [f for f in formats if f != "csv" or flat])
    analysis["runs"].write.mode("append").parquet(f"{folder}/runs")
    return analysis.run_id


def run_all(
    spark: SparkSession, specs: Iterable[AnalysisSpec], folder: str, threads: int = 8
) -> dict[str, Analysis]:
    """Load, analyse and save each parameter set in turn."""
    done = {}
    for spec in specs:
        if not spec.input_path:
            raise ValueError(f"Analysis '{spec.name}' names no input.")
        log.info("running analysis %s", spec.name)
        result = analyze(load_table(spark, spec.input_path), spec, threads)
        save(result, folder)
        done[spec.name] = result
    return done
