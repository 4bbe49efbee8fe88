"""Segments: (value of the grouping column) x (measure), as rows of one long table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massif.functions.columns import NULL_GROUP, group_label, measure

KEYS = ["segment_group", "feature"]


def check_roles(df: DataFrame, grouping: str | None, categoricals: Sequence[str], measures: Sequence[str]) -> str | None:
    """Validate column roles; an unknown grouping column means one ungrouped segment.

    Unknown categoricals are for the caller to leave out.
    """
    if grouping is not None and grouping in categoricals:
        raise ValueError(f"'{grouping}' is named both as grouping and as categorical column.")
    if not [m for m in measures if m in df.columns]:
        raise ValueError("There is no continuous column to analyse, neither named nor numeric.")
    return grouping if grouping in df.columns else None


def select_groups(df: DataFrame, grouping: str | None, wanted: Sequence[str] = ()) -> DataFrame:
    """Rows of the wanted groups, ``NaN`` naming the null group; no list means all."""
    if grouping is None or grouping not in df.columns or not wanted:
        return df
    named = [str(w) for w in wanted]
    chosen = F.col(grouping).cast("string").isin(named)
    if NULL_GROUP in named:
        chosen = chosen | F.col(grouping).isNull()
    return df.where(chosen)


def to_long(
    df: DataFrame, measures: Sequence[str], grouping: str | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """``segment_group``, the kept columns, ``feature`` and ``value``: one row per measure."""
    present = [m for m in measures if m in df.columns]
    if grouping is not None and grouping not in df.columns:
        grouping = None
    group = group_label(grouping).alias("segment_group")
    kept = [F.col(c) for c in keep]
    if len(present) == 1:
        return df.select(group, *kept, F.lit(present[0]).alias("feature"), measure(present[0]).alias("value"))
    renamed = {m: f"__m{i}" for i, m in enumerate(present)}
    wide = df.select(group, *kept, *[measure(m).alias(a) for m, a in renamed.items()])
    names = F.create_map(*[F.lit(part) for m, a in renamed.items() for part in (a, m)])
    return (
        wide.unpivot(["segment_group", *keep], list(renamed.values()), "feature", "value")
        .withColumn("feature", F.element_at(names, F.col("feature")))
    )
