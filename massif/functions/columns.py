"""Column expressions: null handling, bin arithmetic, names, run times."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the segment that holds every row, and of the null group.
ALL_DATA = "all_data"
NULL_GROUP = "NaN"
DEFAULT_UNIT = "units"


def round_half_even(value: Column, digits: int) -> Column:
    """Round the scaled value to the nearest whole number, halves to even."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def measure(name: str) -> Column:
    """A measure as DOUBLE with NaN turned into NULL."""
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def group_label(name: str | None) -> Column:
    """The segment key of a row: the grouping value as text, nulls named."""
    if name is None:
        return F.lit(ALL_DATA)
    return F.coalesce(F.col(name).cast("string"), F.lit(NULL_GROUP))


# --- bins -----------------------------------------------------------------
# Bins are numbered 1..n. Edge 0 is published 0.1 % of the range below the
# minimum, edge i is mn + i * step, edge n is exactly the maximum.


#: Doubles count in steps of one up to here, so an axis of more bins has edges that are equal.
MOST_BINS = float(1 << 53)


def _step(mn: Column, mx: Column, n_bins: Column) -> Column:
    return (mx - mn) / n_bins


def inner_edge(i: Column, mn: Column, mx: Column, n_bins: Column) -> Column:
    """Edge i used for placing values (edge 0 is the minimum itself)."""
    return F.when(i >= n_bins, mx).otherwise(mn + i * _step(mn, mx, n_bins))


def published_edge(i: Column, mn: Column, mx: Column, n_bins: Column) -> Column:
    """Edge i as reported, with the first edge lowered."""
    return F.when(i <= 0, mn - (mx - mn) * 0.001).otherwise(inner_edge(i, mn, mx, n_bins))


def bin_edges(mn: Column, mx: Column, n_bins: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0).cast("bigint"), n_bins.cast("bigint")), lambda i: published_edge(i, mn, mx, n_bins)
    )


def axis_struct(mn: Column, mx: Column, n_bins: Column) -> Column:
    """What all edges of an axis follow from, however many bins it has."""
    first = published_edge(F.lit(0), mn, mx, n_bins)
    return F.struct(first.alias("first_edge"), mn.alias("minimum"), _step(mn, mx, n_bins).alias("step"), mx.alias("maximum"), (n_bins + 1).alias("edges"))


def _clamp(position: Column, n_bins: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.least(n_bins.cast("bigint"), position.cast("bigint")))


def right_closed_bin(x: Column, mn: Column, mx: Column, n_bins: Column) -> Column:
    """Bin (edge i-1, edge i] of x; outside values go to the end bins, null stays null.

    Division can land one bin off for values that sit on an edge, so the guess
    is compared with its own two edges.
    """
    guess = _clamp(F.ceil((x - mn) / _step(mn, mx, n_bins)), n_bins)
    return (
        F.when(x.isNull(), F.lit(None))
        .when((guess > 1) & (x <= inner_edge(guess - 1, mn, mx, n_bins)), guess - 1)
        .when((guess < n_bins) & (x > inner_edge(guess, mn, mx, n_bins)), guess + 1)
        .otherwise(guess)
        .cast("bigint")
    )


def left_closed_bin(x: Column, mn: Column, mx: Column, n_bins: Column) -> Column:
    """Bin [edge i-1, edge i) of x, clipped to 1..n, null stays null."""
    guess = _clamp(F.floor((x - mn) / _step(mn, mx, n_bins)) + 1, n_bins)
    return (
        F.when(x.isNull(), F.lit(None))
        .when((guess > 1) & (x < inner_edge(guess - 1, mn, mx, n_bins)), guess - 1)
        .when((guess < n_bins) & (x >= inner_edge(guess, mn, mx, n_bins)), guess + 1)
        .otherwise(guess)
        .cast("bigint")
    )


def bin_third(bin_number: Column, n_bins: Column) -> Column:
    """head / body / tail third of the bin axis; the last third takes the rest."""
    third = F.floor(n_bins / 3)
    return (
        F.when(bin_number <= third, "head")
        .when(bin_number <= 2 * third, "body")
        .when(bin_number.isNotNull(), "tail")
    )


def freedman_diaconis(n: Column, mn: Column, mx: Column, q25: Column, q75: Column) -> Column:
    """Bin count by Freedman-Diaconis, Sturges when the quartiles coincide.

    Null where the bins would be too many for a double to tell their edges apart.
    """
    iqr = q75 - q25
    width = 2 * iqr / F.pow(n.cast("double"), F.lit(1.0 / 3.0))
    bins = F.ceil((mx - mn) / F.when(width > 0, width))
    return (
        F.when(n < 2, F.lit(1))
        .when((iqr > 0) & (width > 0), F.when((mx - mn) / F.when(width > 0, width) <= MOST_BINS, bins))
        .otherwise(F.ceil(1 + F.log2(n.cast("double"))))
        .cast("bigint")
    )


# --- names ----------------------------------------------------------------


def display_name(value: Column, names: Mapping[str, str] | None) -> Column:
    """The mapped display name, or the raw value where none is given."""
    if not names:
        return value
    pairs = [F.lit(part) for item in sorted(names.items()) for part in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), value), value)


def unit_of(feature: Column, units: Mapping[str, str] | None) -> Column:
    if not units:
        return F.lit(DEFAULT_UNIT)
    pairs = [F.lit(part) for item in sorted(units.items()) for part in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), feature), F.lit(DEFAULT_UNIT))


def segment_name(group: Column, feature: Column) -> Column:
    return F.concat_ws("_", group, feature)


def parse_segment_name(name: Column, features: list[str], grouped: bool = True) -> Column:
    """Split a segment name into (segment_group, feature).

    The first listed feature that ends the name wins; otherwise the name is an
    ungrouped one, with or without its prefix.
    """
    prefix = ALL_DATA + "_"
    parsed = F.when(
        name.startswith(prefix),
        F.struct(
            F.lit(ALL_DATA).alias("segment_group"),
            F.substr(name, F.lit(len(prefix) + 1)).alias("feature"),
        ),
    ).otherwise(F.struct(F.lit(ALL_DATA).alias("segment_group"), name.alias("feature")))
    if not grouped:
        return parsed
    for feature in reversed(features):
        tail = "_" + feature
        parsed = F.when(
            name.endswith(tail),
            F.struct(
                F.substr(name, F.lit(1), F.length(name) - len(tail)).alias("segment_group"),
                F.lit(feature).alias("feature"),
            ),
        ).otherwise(parsed)
    return parsed


def safe_file_name(name: Column) -> Column:
    return F.translate(name, " /", "_-")


def model_file_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[/: .]", "_")


def run_time_text(run_name: Column) -> Column:
    """Readable time from the first 15 characters of a run name."""
    stamp = F.try_to_timestamp(F.substr(run_name, F.lit(1), F.lit(15)), F.lit("yyyyMMdd_HHmmss"))
    return F.coalesce(
        F.date_format(stamp, "MMMM dd, yyyy, 'at' HH:mm:ss 'UTC'"), F.lit("an unknown time")
    )
