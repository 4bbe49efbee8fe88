"""SQL for DuckDB that gives the same answers as the named queries.

Written apart from the operators where a second way exists: bins are found by
comparing with every edge, the density level by trying every level, the knee by
walking every combination.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

EV = """
ev AS (SELECT *, CAST(dayofweek(ts) + 1 AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour FROM events)"""

NULLED = """
ev AS (SELECT event_id, ts, user_id,
    CASE WHEN event_type <> 'error' THEN event_type END AS event_type,
    CASE WHEN value >= 1 THEN value END AS value,
    CAST(dayofweek(ts) + 1 AS INTEGER) AS weekday,
    CASE WHEN hour(ts) <> 0 THEN CAST(hour(ts) AS INTEGER) END AS hour FROM events)"""

LINES = """
lines AS (SELECT l.*, o.o_orderpriority, date_diff('day', CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE)) AS ship_lag
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
line_long AS (
    SELECT l_returnflag AS segment_group, l_linenumber, o_orderpriority, l_linestatus, 'l_quantity' AS feature, l_quantity AS value FROM lines
    UNION ALL SELECT l_returnflag, l_linenumber, o_orderpriority, l_linestatus, 'l_extendedprice', l_extendedprice FROM lines
    UNION ALL SELECT l_returnflag, l_linenumber, o_orderpriority, l_linestatus, 'ship_lag', CAST(ship_lag AS DOUBLE) FROM lines)"""


def params(source: str, name: str = "par", n_bins: str | None = None) -> str:
    """Bin parameters of ``source(segment_group, feature, value)``."""
    fd = """CAST(CASE WHEN n < 2 THEN 1 WHEN q75 > q25
        THEN ceil((mx - mn) / (2e0 * (q75 - q25) / pow(CAST(n AS DOUBLE), 1e0 / 3e0)))
        ELSE ceil(1e0 + log2(CAST(n AS DOUBLE))) END AS BIGINT)"""
    return f"""
{name}0 AS (SELECT segment_group, feature, count(value) AS n, min(value) AS mn, max(value) AS mx,
    quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75
    FROM {source} GROUP BY segment_group, feature HAVING min(value) < max(value)),
{name} AS (SELECT *, (mx - mn) / n_bins AS step FROM (SELECT *, {n_bins or fd} AS n_bins FROM {name}0) WHERE n_bins > 1)"""


def inner_edge(i: str) -> str:
    return f"(CASE WHEN {i} >= n_bins THEN mx ELSE mn + ({i}) * step END)"


def edge(i: str) -> str:
    return f"(CASE WHEN ({i}) <= 0 THEN mn - (mx - mn) * 0.001e0 ELSE {inner_edge(i)} END)"


RIGHT_BIN = """CASE WHEN value IS NULL THEN NULL
    ELSE CAST(1 + len(list_filter(range(1, n_bins), lambda i: mn + i * step < value)) AS BIGINT) END"""
LEFT_BIN = """CASE WHEN value IS NULL THEN NULL
    ELSE CAST(1 + len(list_filter(range(1, n_bins), lambda i: mn + i * step <= value)) AS BIGINT) END"""

KEPT = f"""{EV},
sizes AS (SELECT weekday, hour, count(*) AS n FROM ev GROUP BY weekday, hour),
cut AS (SELECT greatest(2, CAST(ceil(quantile_cont(n, 0.15)) AS BIGINT)) AS threshold FROM sizes),
kept AS (SELECT weekday, hour, n, row_number() OVER (ORDER BY weekday, hour) AS comb
    FROM sizes, cut WHERE n >= threshold),
f AS (SELECT ev.*, kept.comb FROM ev JOIN kept USING (weekday, hour)),
long AS (SELECT event_id, comb, event_type AS segment_group, 'value' AS feature, value FROM f),
{params('long')},
binned AS (SELECT long.*, {RIGHT_BIN} AS bin FROM long JOIN par USING (segment_group, feature)),
profile AS (SELECT segment_group, feature, comb, bin, count(*) AS n FROM binned GROUP BY ALL),
ruled AS (SELECT DISTINCT segment_group, feature, comb, CAST(hour // 8 AS INTEGER) AS cluster
    FROM profile JOIN kept USING (comb)),
cp AS (SELECT segment_group, feature, cluster, bin, CAST(sum(n) AS BIGINT) AS n
    FROM profile JOIN ruled USING (segment_group, feature, comb) WHERE bin IS NOT NULL GROUP BY ALL),
spine AS (SELECT segment_group, feature, cluster, CAST(unnest(range(1, n_bins + 1)) AS BIGINT) AS bin
    FROM (SELECT DISTINCT segment_group, feature, cluster FROM cp) JOIN par USING (segment_group, feature)),
dense AS (SELECT segment_group, feature, cluster, bin, coalesce(n, 0) AS n
    FROM spine LEFT JOIN cp USING (segment_group, feature, cluster, bin))"""


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


# --- scans ------------------------------------------------------------------

ORACLE["scan_parquet"] = "SELECT * FROM customer"
ORACLE["scan_csv"] = "SELECT * FROM customer"

LINE_NUMBERS = [
    "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]
ORACLE["numeric_columns"] = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS non_null, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM lineitem"
    for c in LINE_NUMBERS
)


def _numeric_profile(c: str, dtype: str) -> str:
    return f"""SELECT '{c}' AS "column", '{dtype}' AS dtype, count({c}) AS count, round(avg({c}), 4) AS mean,
    round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont({c}, 0.25), 4) AS p25,
    round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75, CAST(max({c}) AS DOUBLE) AS max,
    NULL AS "unique", NULL AS top, NULL AS freq FROM part"""


def _text_profile(c: str) -> str:
    return f"""SELECT '{c}' AS "column", 'string' AS dtype, CAST(sum(n) AS BIGINT) AS count, NULL AS mean, NULL AS std,
    NULL AS min, NULL AS p25, NULL AS p50, NULL AS p75, NULL AS max, count(*) AS "unique",
    (SELECT {c} FROM part GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS top, max(n) AS freq
    FROM (SELECT {c}, count(*) AS n FROM part WHERE {c} IS NOT NULL GROUP BY {c})"""


ORACLE["profile_table"] = " UNION ALL ".join(
    [
        _numeric_profile("p_size", "int"),
        _numeric_profile("p_retailprice", "double"),
        *[_text_profile(c) for c in ("p_name", "p_brand", "p_type")],
    ]
)
ORACLE["value_counts"] = "SELECT p_brand, count(*) AS count FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand"
ORACLE["top_values"] = (
    "SELECT p_type, count(*) AS count FROM part WHERE p_type IS NOT NULL GROUP BY p_type ORDER BY 2 DESC, 1 LIMIT 20"
)
ORACLE["n_unique"] = with_(
    NULLED,
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique FROM ev"
        for c in ("event_type", "user_id", "weekday", "hour")
    ),
)

# --- combinations -----------------------------------------------------------


def _hot(column: str, value: str | int, literal: str) -> str:
    return f"CASE WHEN {column} = {literal} THEN 1e0 ELSE 0e0 END AS \"{column}_{value}\""


ORACLE["one_hot"] = with_(
    NULLED,
    "SELECT event_id, user_id, value, "
    + ", ".join(
        [_hot("event_type", t, f"'{t}'") for t in ("click", "purchase", "signup", "view")]
        + [_hot("weekday", d, str(d)) for d in range(1, 8)]
    )
    + " FROM ev",
)
ORACLE["comb_sizes"] = with_(NULLED, "SELECT event_type, weekday, hour, count(*) AS n FROM ev GROUP BY ALL")
ORACLE["comb_id"] = with_(
    LINES,
    """SELECT *, dense_rank() OVER (ORDER BY l_linenumber NULLS FIRST, o_orderpriority NULLS FIRST, l_linestatus NULLS FIRST) AS comb
FROM (SELECT l_linenumber, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS o_orderpriority,
    l_linestatus, count(*) AS n FROM lines GROUP BY ALL)""",
)
ORACLE["comb_id_partitioned"] = with_(
    NULLED,
    """SELECT *, dense_rank() OVER (ORDER BY user_id NULLS FIRST, event_type NULLS FIRST) AS comb
FROM (SELECT user_id, event_type, count(*) AS n FROM ev GROUP BY ALL)""",
)
ORACLE["comb_size_stats"] = with_(
    EV,
    """SELECT count(*) AS count, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS min,
    round(quantile_cont(n, 0.10), 6) AS p10, round(quantile_cont(n, 0.25), 6) AS p25, round(quantile_cont(n, 0.5), 6) AS p50,
    round(quantile_cont(n, 0.75), 6) AS p75, round(quantile_cont(n, 0.9), 6) AS p90, max(n) AS max
FROM (SELECT weekday, hour, count(*) AS n FROM ev GROUP BY ALL)""",
)
ORACLE["comb_threshold_pct"] = with_(
    f"{EV}, sizes AS (SELECT weekday, hour, count(*) AS n FROM ev GROUP BY ALL)",
    " UNION ALL ".join(
        f"SELECT {p} AS pct, greatest(2, CAST(ceil(quantile_cont(n, {p / 100})) AS BIGINT)) AS threshold FROM sizes"
        for p in (0, 15, 50, 99)
    ),
)


def _knee(name: str, source: str) -> str:
    return f"""SELECT '{name}' AS sizes, CASE WHEN max(m) < 3 THEN 2 ELSE greatest(2, coalesce(
        arg_min(peak, i) FILTER (WHERE nx < lim AND peak IS NOT NULL AND r > 0),
        CAST(ceil(quantile_cont(n, 0.25)) AS BIGINT))) END AS threshold
FROM (SELECT *,
        last_value(CASE WHEN dip THEN 0 WHEN top THEN d - r END IGNORE NULLS) OVER walk AS lim,
        last_value(CASE WHEN top THEN n END IGNORE NULLS) OVER walk AS peak
    FROM (SELECT *, lead(d) OVER (ORDER BY i) AS nx,
            coalesce(d >= lag(d) OVER (ORDER BY i), true) AND coalesce(d >= lead(d) OVER (ORDER BY i), true) AS top,
            coalesce(d <= lag(d) OVER (ORDER BY i), true) AND coalesce(d <= lead(d) OVER (ORDER BY i), true) AS dip
        FROM (SELECT n, i, m, s0 - s9 AS r, CAST(s0 - n AS HUGEINT) * (m - 1) - CAST(i AS HUGEINT) * (s0 - s9) AS d
            FROM (SELECT n, row_number() OVER (ORDER BY n DESC) - 1 AS i, count(*) OVER () AS m,
                max(n) OVER () AS s0, min(n) OVER () AS s9 FROM ({source}))))
    WINDOW walk AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


ORACLE["comb_threshold_knee"] = with_(
    f"{EV}, {LINES}",
    " UNION ALL ".join(
        _knee(name, source)
        for name, source in {
            "weekday_hour": "SELECT count(*) AS n FROM ev GROUP BY weekday, hour",
            "user": "SELECT count(*) AS n FROM ev GROUP BY user_id",
            "part": "SELECT count(*) AS n FROM part GROUP BY p_type, p_size",
            "event_type": "SELECT count(*) AS n FROM ev GROUP BY event_type",
            "line": "SELECT count(*) AS n FROM lines GROUP BY l_linenumber, o_orderpriority, l_linestatus",
        }.items()
    ),
)
ORACLE["comb_min_size_filter"] = with_(
    f"""{NULLED}, sizes AS (SELECT weekday, hour, count(*) AS n FROM ev GROUP BY ALL),
cut AS (SELECT greatest(2, CAST(ceil(quantile_cont(n, 0.5)) AS BIGINT)) AS threshold FROM sizes)""",
    """SELECT event_id, ev.weekday, ev.hour, value FROM ev JOIN sizes
    ON ev.weekday IS NOT DISTINCT FROM sizes.weekday AND ev.hour IS NOT DISTINCT FROM sizes.hour, cut WHERE n >= threshold""",
)
ORACLE["retention"] = with_(
    f"""{EV}, sizes AS (SELECT weekday, hour, count(*) AS n FROM ev GROUP BY ALL),
cut AS (SELECT greatest(2, CAST(ceil(quantile_cont(n, 0.15)) AS BIGINT)) AS threshold FROM sizes)""",
    """SELECT CAST(sum(CASE WHEN n >= threshold THEN n ELSE 0 END) AS BIGINT) AS retained_rows, CAST(sum(n) AS BIGINT) AS total_rows,
    round(sum(CASE WHEN n >= threshold THEN n ELSE 0 END) * 100e0 / sum(n), 6) AS percent_retained FROM sizes, cut""",
)

# --- segments and bins ------------------------------------------------------

ORACLE["segment_filter"] = with_(
    NULLED,
    """SELECT event_id, coalesce(event_type, 'NaN') AS segment_group, 'value' AS feature, value
FROM ev WHERE event_type IN ('click', 'view') OR event_type IS NULL""",
)
ORACLE["segment_eligible"] = with_(
    LINES,
    """SELECT segment_group, feature, count(*) AS rows, count(value) AS n, min(value) AS mn, max(value) AS mx
FROM line_long GROUP BY ALL HAVING count(DISTINCT value) > 1""",
)
ORACLE["segment_name"] = """
SELECT l_returnflag || '_' || feature AS name, count(*) AS n, l_returnflag AS parsed_group, feature AS parsed_feature,
    l_returnflag || '_' || feature || '_a-b' AS file_name
FROM (SELECT l_returnflag, unnest(['l_quantity', 'l_tax']) AS feature FROM lineitem) GROUP BY ALL"""
ORACLE["display_names"] = with_(
    NULLED,
    """SELECT event_id, CASE coalesce(event_type, 'NaN') WHEN 'click' THEN 'Clicks' WHEN 'view' THEN 'Page views'
    WHEN 'NaN' THEN 'Unknown' ELSE event_type END AS group_name, 'Event value' AS feature_name, 'units' AS unit FROM ev""",
)
ORACLE["percentiles_exact"] = """
SELECT l_returnflag AS segment_group, 'l_extendedprice' AS feature,
    round(quantile_cont(l_extendedprice, 0.0), 4) AS p0, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25,
    round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90,
    round(quantile_cont(l_extendedprice, 1.0), 4) AS p100
FROM lineitem GROUP BY l_returnflag"""
ORACLE["fd_bins"] = with_(
    f"{LINES}, {params('line_long')}",
    """SELECT segment_group, feature, n, mn, mx, round(q25, 4) AS q25, round(q75, 4) AS q75, n_bins,
    CASE feature WHEN 'ship_lag' THEN 'days' ELSE 'units' END AS unit FROM par""",
)
ORACLE["document_bins"] = with_(
    f"long AS (SELECT lang AS segment_group, doc_id, 'n_chars' AS feature, CAST(n_chars AS DOUBLE) AS value FROM documents), {params('long')}",
    f"SELECT segment_group, doc_id, feature, value, {RIGHT_BIN} AS bin FROM long JOIN par USING (segment_group, feature)",
)
ORACLE["bin_edges"] = with_(
    f"{LINES}, {params('line_long', n_bins='CAST(12 AS BIGINT)')}",
    f"""SELECT segment_group, feature, n_bins, CAST(i AS INTEGER) AS i, round({edge('i')}, 4) AS edge
FROM (SELECT *, unnest(range(0, n_bins + 1)) AS i FROM par)""",
)
ORACLE["quantize"] = with_(
    f"{NULLED}, long AS (SELECT event_id, coalesce(event_type, 'NaN') AS segment_group, 'value' AS feature, value FROM ev), {params('long')}",
    f"SELECT segment_group, feature, event_id, value, {RIGHT_BIN} AS bin FROM long JOIN par USING (segment_group, feature)",
)
QUANTITY = f"""long AS (SELECT 'all_data' AS segment_group, 'l_quantity' AS feature, l_orderkey, l_linenumber, l_quantity AS value
    FROM lineitem), {params('long', n_bins='CAST(49 AS BIGINT)')}"""
ORACLE["quantize_left"] = with_(
    QUANTITY,
    f"SELECT segment_group, feature, l_orderkey, l_linenumber, value, {LEFT_BIN} AS bin FROM long JOIN par USING (segment_group, feature)",
)
ORACLE["quantize_edges"] = with_(
    QUANTITY,
    f"SELECT segment_group, feature, l_orderkey, l_linenumber, value, {RIGHT_BIN} AS bin FROM long JOIN par USING (segment_group, feature)",
)
THIRD = "CASE WHEN bin - 1 < n_bins // 3 THEN 'head' WHEN bin - 1 < 2 * (n_bins // 3) THEN 'body' WHEN bin IS NOT NULL THEN 'tail' END"
ORACLE["bin_third"] = with_(
    KEPT,
    f"""SELECT segment_group, feature, {THIRD} AS third, count(*) AS n, min(bin) AS low, max(bin) AS high
FROM binned JOIN par USING (segment_group, feature) GROUP BY ALL""",
)
ORACLE["density_histogram"] = with_(
    f"""{NULLED}, long AS (SELECT coalesce(event_type, 'NaN') AS segment_group, 'value' AS feature, value FROM ev), {params('long')},
stats AS (SELECT segment_group, feature, count(*) AS group_rows, count(value) > 0 AS has_data FROM long GROUP BY ALL),
bars AS (SELECT segment_group, feature, bin, count(*) AS count, n, step
    FROM (SELECT *, {RIGHT_BIN} AS bin FROM long JOIN par USING (segment_group, feature)) WHERE bin IS NOT NULL GROUP BY ALL)""",
    """SELECT segment_group, feature, group_rows, has_data, bin, count, round(count / (n * step), 9) AS density,
    CASE segment_group WHEN 'click' THEN 'Clicks' WHEN 'view' THEN 'Page views' WHEN 'NaN' THEN 'Unknown' ELSE segment_group END AS group_name,
    'Event value' AS feature_name
FROM stats LEFT JOIN bars USING (segment_group, feature)""",
)
ORACLE["box_stats"] = """
WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q25, quantile_cont(l_extendedprice, 0.5) AS median,
    quantile_cont(l_extendedprice, 0.75) AS q75 FROM lineitem GROUP BY l_returnflag),
b AS (SELECT q.*, l_extendedprice AS v, l_extendedprice BETWEEN q25 - 1.5e0 * (q75 - q25) AND q75 + 1.5e0 * (q75 - q25) AS inside
    FROM lineitem JOIN q USING (l_returnflag))
SELECT l_returnflag, round(q25, 4) AS q25, round(median, 4) AS median, round(q75, 4) AS q75,
    round(min(v) FILTER (WHERE inside), 4) AS whisker_low, round(max(v) FILTER (WHERE inside), 4) AS whisker_high,
    count(*) FILTER (WHERE NOT inside) AS outliers
FROM b GROUP BY l_returnflag, b.q25, b.median, b.q75"""

# --- profiles ---------------------------------------------------------------

ORACLE["comb_profile"] = with_(KEPT, "SELECT segment_group, feature, comb, bin, n FROM profile")
ORACLE["line_profile"] = with_(
    f"{LINES}, {params('line_long', n_bins='CAST(20 AS BIGINT)')}",
    f"""SELECT segment_group, feature, l_linenumber, o_orderpriority, l_linestatus, bin, count(*) AS n
FROM (SELECT *, {RIGHT_BIN} AS bin FROM line_long JOIN par USING (segment_group, feature)) GROUP BY ALL""",
)
ORACLE["cluster_profile"] = with_(KEPT, "SELECT segment_group, feature, cluster, bin, n FROM cp")
ORACLE["cluster_profile_pct"] = with_(
    KEPT,
    """SELECT segment_group, feature, cluster, bin, n, CAST(sum(n) OVER c AS BIGINT) AS total_items,
    round(n * 100e0 / sum(n) OVER c, 6) AS percentage FROM cp WINDOW c AS (PARTITION BY segment_group, feature, cluster)""",
)
ORACLE["profile_dense"] = with_(KEPT, "SELECT segment_group, feature, cluster, bin, n FROM dense")
ORACLE["unpivot_profile"] = with_(
    KEPT,
    """SELECT segment_group, feature, cluster, 'c_' || bin AS classes, CAST(n AS DOUBLE) AS count, bin AS class_num FROM dense""",
)


def hdr(excluded: float) -> str:
    """Every whole level is tried; the highest that keeps the target mass is taken."""
    return f"""{KEPT},
hc AS (SELECT segment_group, feature, cluster, list(n) AS ns, max(n) AS top, sum(n) * (100e0 - {excluded}e0) / 100e0 AS target
    FROM cp WHERE n > 0 GROUP BY ALL),
hl AS (SELECT segment_group, feature, cluster, CAST(max(y) AS DOUBLE) AS level
    FROM (SELECT *, unnest(range(0, top + 1)) AS y FROM hc)
    WHERE list_sum(list_transform(ns, lambda v: greatest(v - y, 0))) >= target GROUP BY ALL),
hb AS (SELECT cp.*, level, bin - row_number() OVER (PARTITION BY segment_group, feature, cluster ORDER BY bin) AS block,
    sum(n) OVER (PARTITION BY segment_group, feature, cluster) AS mass_above
    FROM cp JOIN hl USING (segment_group, feature, cluster) WHERE n > level),
hk AS (SELECT segment_group, feature, cluster, block, min(bin) AS start_bin, max(bin) AS end_bin, sum(n) AS mass, max(n) AS peak_count,
    min(bin) FILTER (WHERE n = block_peak) AS peak_bin
    FROM (SELECT *, max(n) OVER (PARTITION BY segment_group, feature, cluster, block) AS block_peak FROM hb WHERE mass_above >= 2)
    GROUP BY ALL),
h1 AS (SELECT * FROM hk QUALIFY row_number() OVER (PARTITION BY segment_group, feature, cluster ORDER BY mass DESC, start_bin) = 1),
hdr AS (SELECT segment_group, feature, cluster, level AS hdr_threshold_count, start_bin, end_bin,
    (start_bin + end_bin) / 2e0 AS median_bin, peak_bin, {edge('start_bin - 1')} AS start_edge, {edge('end_bin')} AS end_edge,
    ({edge('peak_bin - 1')} + {edge('peak_bin')}) / 2e0 AS most_probable, CASE WHEN start_bin IS NOT NULL THEN 'units' END AS unit,
    CAST(mass AS DOUBLE) AS mass, CAST(peak_count AS DOUBLE) AS peak_count
    FROM hl LEFT JOIN h1 USING (segment_group, feature, cluster) JOIN par USING (segment_group, feature))"""


HDR_SELECT = """SELECT segment_group, feature, cluster, hdr_threshold_count, start_bin, end_bin, median_bin, peak_bin,
    round(start_edge, 6) AS start_edge, round(end_edge, 6) AS end_edge, round(most_probable, 6) AS most_probable, unit, mass, peak_count FROM hdr"""
ORACLE["hdr"] = with_(hdr(75.0), HDR_SELECT)
ORACLE["hdr_wide"] = with_(hdr(33.3), HDR_SELECT)
ORACLE["profile_json"] = with_(
    hdr(75.0),
    """SELECT segment_group || '_' || feature AS segment_name, 3 AS optimal_k_used, n_bins AS quantization_bins, n_bins + 1 AS edges,
    cluster AS cluster_id, CAST(sum(dense.n) AS DOUBLE) AS total_items, hdr_threshold_count, CAST(count(*) AS INTEGER) AS bins_listed, 100e0 AS percent
FROM dense JOIN par USING (segment_group, feature) JOIN hdr USING (segment_group, feature, cluster)
GROUP BY segment_group, feature, cluster, n_bins, hdr_threshold_count""",
)

# --- clusters and composition -----------------------------------------------

ORACLE["label_rows"] = with_(
    KEPT,
    "SELECT event_id, segment_group, feature, comb, bin, cluster FROM binned JOIN ruled USING (segment_group, feature, comb)",
)


def composition(members: str) -> str:
    """``members`` is (segment_group, feature, cluster, weekday, hour, n)."""
    return f"""{KEPT}, members AS ({members}),
totals AS (SELECT segment_group, feature, cluster, CAST(sum(n) AS BIGINT) AS total_rows FROM members GROUP BY ALL),
listed AS (SELECT DISTINCT 'weekday' AS "column", CAST(weekday AS VARCHAR) AS value FROM kept
    UNION SELECT DISTINCT 'hour', CAST(hour AS VARCHAR) FROM kept),
counted AS (SELECT segment_group, feature, cluster, 'weekday' AS "column", CAST(weekday AS VARCHAR) AS value, sum(n) AS count FROM members GROUP BY ALL
    UNION ALL SELECT segment_group, feature, cluster, 'hour', CAST(hour AS VARCHAR), sum(n) FROM members GROUP BY ALL),
composition AS (SELECT segment_group, feature, cluster, total_rows, "column", value, CAST(coalesce(count, 0) AS BIGINT) AS count,
    round_even(coalesce(count, 0) / total_rows * 100e0 * 100e0, 0) / 100e0 AS percentage
    FROM totals CROSS JOIN listed LEFT JOIN counted USING (segment_group, feature, cluster, "column", value))"""


ALL_ROWS = "SELECT segment_group, feature, cluster, weekday, hour, n FROM ruled JOIN kept USING (comb)"
SEGMENT_ROWS = """SELECT segment_group, feature, cluster, weekday, hour, count(*) AS n
    FROM long JOIN ruled USING (segment_group, feature, comb) JOIN kept USING (comb) GROUP BY ALL"""
ORACLE["cluster_composition"] = with_(composition(ALL_ROWS), "SELECT * FROM composition")
ORACLE["cluster_composition_segment"] = with_(composition(SEGMENT_ROWS), "SELECT * FROM composition")


def _describe(column: str, digits: int, segment_only: bool = False) -> str:
    only = "WHERE f.event_type = ruled.segment_group" if segment_only else ""
    return f"""SELECT ruled.segment_group, ruled.feature, cluster, '{column}' AS "column", CAST(count(f.{column}) AS DOUBLE) AS count,
    round(avg(f.{column}), {digits}) AS mean, round(stddev_samp(f.{column}), {digits}) AS std,
    round(CAST(min(f.{column}) AS DOUBLE), {digits}) AS min, round(quantile_cont(f.{column}, 0.25), {digits}) AS p25,
    round(quantile_cont(f.{column}, 0.5), {digits}) AS p50, round(quantile_cont(f.{column}, 0.75), {digits}) AS p75,
    round(CAST(max(f.{column}) AS DOUBLE), {digits}) AS max
    FROM ruled JOIN f USING (comb) {only} GROUP BY ALL"""


ORACLE["cluster_describe_segment"] = with_(
    KEPT, _describe("value", 5, True) + " UNION ALL " + _describe("user_id", 5, True)
)
ORACLE["cluster_describe"] = with_(KEPT, _describe("value", 5) + " UNION ALL " + _describe("user_id", 5))
ORACLE["composition_union"] = with_(
    f"{composition(ALL_ROWS)}, described AS ({_describe('value', 5)})",
    """SELECT segment_group, feature, cluster, "column" || '_' || value AS feature_value, CAST(count AS DOUBLE) AS count, percentage,
    NULL AS "column", NULL AS mean, NULL AS std, NULL AS min, NULL AS p25, NULL AS p50, NULL AS p75, NULL AS max FROM composition
UNION ALL SELECT segment_group, feature, cluster, NULL, count, NULL, "column", mean, std, min, p25, p50, p75, max FROM described""",
)

RULED_K = f"""{KEPT},
lab AS (SELECT DISTINCT segment_group, feature, comb, k, CAST(hour % k AS INTEGER) AS cluster
    FROM profile JOIN kept USING (comb) CROSS JOIN (SELECT CAST(unnest(range(2, 7)) AS INTEGER) AS k)),
csize AS (SELECT segment_group, feature, k, cluster, count(*) AS size FROM lab GROUP BY ALL),
wcss AS (SELECT segment_group, feature, k, sum(s2 - s * s / CAST(size AS DOUBLE)) AS wcss
    FROM (SELECT segment_group, feature, k, cluster, bin, CAST(sum(n) AS DOUBLE) AS s, CAST(sum(n * n) AS DOUBLE) AS s2
        FROM lab JOIN profile USING (segment_group, feature, comb) WHERE bin IS NOT NULL GROUP BY ALL)
    JOIN csize USING (segment_group, feature, k, cluster) GROUP BY ALL),
norm AS (SELECT segment_group, feature, comb, sum(CASE WHEN bin IS NULL THEN 0 ELSE n * n END) AS sq FROM profile GROUP BY ALL),
dots AS (SELECT a.segment_group, a.feature, a.comb AS i, b.comb AS j, sum(a.n * b.n) AS dot
    FROM profile a JOIN profile b ON a.segment_group = b.segment_group AND a.feature = b.feature AND a.bin = b.bin GROUP BY ALL),
dist AS (SELECT x.segment_group, x.feature, x.comb AS i, y.comb AS j, sqrt(CAST(x.sq + y.sq - 2 * coalesce(dot, 0) AS DOUBLE)) AS d
    FROM norm x JOIN norm y ON x.segment_group = y.segment_group AND x.feature = y.feature
    LEFT JOIN dots ON dots.segment_group = x.segment_group AND dots.feature = x.feature AND dots.i = x.comb AND dots.j = y.comb),
sums AS (SELECT dist.segment_group, dist.feature, lab.k, dist.i AS comb, lab.cluster AS other, sum(d) AS ds
    FROM dist JOIN lab ON lab.segment_group = dist.segment_group AND lab.feature = dist.feature AND lab.comb = dist.j GROUP BY ALL),
ab AS (SELECT lab.segment_group, lab.feature, lab.k, lab.comb, lab.cluster, own.size,
    max(CASE WHEN other = lab.cluster AND own.size > 1 THEN ds / (own.size - 1) END) AS a,
    min(CASE WHEN other <> lab.cluster THEN ds / oth.size END) AS b
    FROM lab JOIN csize own USING (segment_group, feature, k, cluster) JOIN sums USING (segment_group, feature, k, comb)
    JOIN csize oth ON oth.segment_group = lab.segment_group AND oth.feature = lab.feature AND oth.k = lab.k AND oth.cluster = sums.other
    GROUP BY ALL),
samples AS (SELECT segment_group, feature, k, comb, cluster,
    CASE WHEN b IS NULL THEN NULL WHEN size = 1 OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END AS silhouette FROM ab),
sil AS (SELECT segment_group, feature, k, CASE WHEN count(DISTINCT cluster) BETWEEN 2 AND count(*) - 1 THEN avg(silhouette) END AS silhouette
    FROM samples GROUP BY ALL),
peak AS (SELECT segment_group, feature, min(k) AS peak_k
    FROM (SELECT *, max(r) OVER (PARTITION BY segment_group, feature) AS best
        FROM (SELECT *, round_even(silhouette * 100, 0) AS r FROM sil WHERE silhouette IS NOT NULL)) WHERE r = best GROUP BY ALL),
best AS (SELECT segment_group, feature, max(k) AS k
    FROM (SELECT *, max(stop) OVER (PARTITION BY segment_group, feature ORDER BY k) AS stopped
        FROM (SELECT *, CASE WHEN prev IS NULL THEN 0
                WHEN (CASE WHEN prev <> 0 THEN (prev - silhouette) / abs(prev) WHEN silhouette < 0 THEN 1 ELSE 0 END) > 0.05e0 THEN 1 ELSE 0 END AS stop
            FROM (SELECT *, lag(silhouette) OVER (PARTITION BY segment_group, feature ORDER BY k) AS prev FROM sil)))
    WHERE stopped = 0 GROUP BY ALL)"""

ORACLE["wcss"] = with_(RULED_K, "SELECT segment_group, feature, k, round(wcss, 5) AS wcss FROM wcss")
ORACLE["silhouette"] = with_(
    RULED_K, "SELECT segment_group, feature, k, round(silhouette, 6) AS silhouette FROM sil"
)
ORACLE["silhouette_squared"] = with_(
    RULED_K.replace("sqrt(CAST(x.sq + y.sq - 2 * coalesce(dot, 0) AS DOUBLE)) AS d", "CAST(x.sq + y.sq - 2 * coalesce(dot, 0) AS DOUBLE) AS d"),
    "SELECT segment_group, feature, k, round(silhouette, 6) AS silhouette FROM sil",
)
ORACLE["silhouette_ordered"] = with_(
    RULED_K,
    """SELECT segment_group, feature, k, comb, cluster, round(silhouette, 6) AS silhouette,
    row_number() OVER (PARTITION BY segment_group, feature, k, cluster ORDER BY round(silhouette, 9), comb) AS rank_in_cluster,
    row_number() OVER (PARTITION BY segment_group, feature, k ORDER BY cluster, round(silhouette, 9), comb) - 1 AS position FROM samples""",
)
ORACLE["first_peak_k"] = with_(
    RULED_K,
    """SELECT segment_group, feature, k, round(silhouette, 6) AS silhouette
FROM sil JOIN peak USING (segment_group, feature) WHERE k >= peak_k AND silhouette IS NOT NULL""",
)
ORACLE["optimal_k"] = with_(RULED_K, "SELECT segment_group, feature, k FROM best")
ORACLE["elbow"] = with_(
    RULED_K,
    """SELECT wcss.segment_group, wcss.feature, wcss.k, round(wcss, 5) AS wcss, coalesce(wcss.k = best.k, false) AS is_current
FROM wcss LEFT JOIN best USING (segment_group, feature)""",
)

# --- model ------------------------------------------------------------------

MODEL = f"""{KEPT},
cells AS (SELECT segment_group, feature, bin, cluster, sum(n) AS n FROM profile JOIN ruled USING (segment_group, feature, comb) GROUP BY ALL),
classes AS (SELECT *, row_number() OVER s - 1 AS label, class_n / CAST(sum(class_n) OVER (PARTITION BY segment_group, feature) AS DOUBLE) AS prior
    FROM (SELECT segment_group, feature, cluster, sum(n) AS class_n FROM cells GROUP BY ALL)
    WINDOW s AS (PARTITION BY segment_group, feature ORDER BY cluster)),
allbins AS (SELECT segment_group, feature, CAST(unnest(range(1, n_bins + 1)) AS INTEGER) AS bin FROM par
    UNION ALL SELECT segment_group, feature, NULL FROM par),
grid AS (SELECT c.segment_group, c.feature, b.bin, c.cluster, CAST(c.label AS INTEGER) AS label, c.prior, CAST(coalesce(x.n, 0) AS BIGINT) AS n
    FROM classes c JOIN allbins b ON b.segment_group = c.segment_group AND b.feature = c.feature
    LEFT JOIN cells x ON x.segment_group = c.segment_group AND x.feature = c.feature AND x.cluster = c.cluster AND x.bin IS NOT DISTINCT FROM b.bin),
model AS (SELECT *, CASE WHEN bin_n > 0 THEN n / CAST(bin_n AS DOUBLE) ELSE prior END AS p
    FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY segment_group, feature, bin) AS BIGINT) AS bin_n FROM grid)),
guess AS (SELECT segment_group, feature, bin, cluster AS predicted_cluster, p AS probability FROM model
    QUALIFY row_number() OVER (PARTITION BY segment_group, feature, bin ORDER BY p DESC, label) = 1),
conf AS (SELECT m.segment_group, m.feature, m.cluster, m.label, g.predicted_cluster, sum(m.n) AS n
    FROM model m JOIN guess g ON m.segment_group = g.segment_group AND m.feature = g.feature AND m.bin IS NOT DISTINCT FROM g.bin GROUP BY ALL),
acc AS (SELECT segment_group, feature, sum(CASE WHEN cluster = predicted_cluster THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE) AS accuracy FROM conf GROUP BY ALL),
per_class AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1
    FROM (SELECT t.segment_group, t.feature, t.cluster, t.label, support,
            CASE WHEN coalesce(guessed, 0) > 0 THEN hits / CAST(guessed AS DOUBLE) ELSE 0 END AS precision,
            CASE WHEN support > 0 THEN hits / CAST(support AS DOUBLE) ELSE 0 END AS recall
        FROM (SELECT segment_group, feature, cluster, label, sum(n) AS support, sum(CASE WHEN cluster = predicted_cluster THEN n ELSE 0 END) AS hits FROM conf GROUP BY ALL) t
        LEFT JOIN (SELECT segment_group, feature, predicted_cluster AS cluster, sum(n) AS guessed FROM conf GROUP BY ALL) g USING (segment_group, feature, cluster))),
roc AS (SELECT a.segment_group, a.feature, a.cluster, sum(a.n * (CASE WHEN b.p < a.p THEN 1e0 WHEN b.p = a.p THEN 0.5e0 ELSE 0 END) * (b.bin_n - b.n)) AS wins,
    (SELECT sum(n) FROM model z WHERE z.segment_group = a.segment_group AND z.cluster = a.cluster) AS pos,
    (SELECT sum(bin_n - n) FROM model z WHERE z.segment_group = a.segment_group AND z.cluster = a.cluster) AS neg
    FROM model a JOIN model b ON a.segment_group = b.segment_group AND a.feature = b.feature AND a.cluster = b.cluster GROUP BY a.segment_group, a.feature, a.cluster),
auroc AS (SELECT segment_group, feature, sum(wins / (CAST(pos AS DOUBLE) * neg) * pos) / sum(pos) AS auroc_weighted_ovr FROM roc GROUP BY ALL)"""

ORACLE["train_bin_model"] = with_(
    MODEL, "SELECT segment_group, feature, bin, cluster, label, n, bin_n, round(p, 6) AS p FROM model"
)
ORACLE["clf_accuracy"] = with_(MODEL, "SELECT segment_group, feature, round(accuracy, 6) AS accuracy FROM acc")
ORACLE["clf_report"] = with_(
    MODEL,
    """SELECT segment_group, feature, CAST(label AS VARCHAR) AS class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM per_class
UNION ALL SELECT segment_group, feature, 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM per_class GROUP BY ALL
UNION ALL SELECT segment_group, feature, 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
    round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM per_class GROUP BY ALL""",
)
ORACLE["clf_auroc"] = with_(MODEL, "SELECT segment_group, feature, round(auroc_weighted_ovr, 6) AS auroc_weighted_ovr FROM auroc")
ORACLE["model_metadata"] = with_(
    MODEL,
    """SELECT segment_group, feature, CAST(sum(model.n) AS BIGINT) AS num_samples_trained, CAST(count(DISTINCT label) AS INTEGER) AS num_classes,
    (SELECT string_agg(label || ':' || cluster, ',' ORDER BY label) FROM classes c WHERE c.segment_group = model.segment_group AND c.feature = model.feature) AS label_mapping,
    n_bins AS num_features, round(accuracy, 6) AS accuracy, round(auroc_weighted_ovr, 6) AS auroc_weighted_ovr
FROM model JOIN par USING (segment_group, feature) JOIN acc USING (segment_group, feature) JOIN auroc USING (segment_group, feature)
GROUP BY segment_group, feature, n_bins, accuracy, auroc_weighted_ovr""",
)
SCORED = f"""{MODEL},
scored AS (SELECT event_id, x.segment_group, x.feature, x.value, x.bin, x.n_bins, x.mn, x.mx, x.step, g.predicted_cluster, g.probability
    FROM (SELECT *, least(n_bins, {RIGHT_BIN}) AS bin FROM (SELECT event_id, event_type AS segment_group, 'value' AS feature, value FROM ev)
        JOIN (SELECT segment_group, feature, mn, mx, n_bins, step FROM par) USING (segment_group, feature)) x
    JOIN guess g ON g.segment_group = x.segment_group AND g.feature = x.feature AND g.bin IS NOT DISTINCT FROM x.bin)"""
ORACLE["score_batch"] = with_(
    SCORED,
    f"""SELECT event_id, segment_group, feature, bin, predicted_cluster, round(probability, 6) AS probability,
    (SELECT CAST(count(*) AS INTEGER) FROM classes c WHERE c.segment_group = scored.segment_group) AS n_classes,
    round({edge('bin - 1')}, 6) AS bin_lower, round({edge('bin')}, 6) AS bin_upper, {THIRD} AS bin_third,
    format('value {{:.2f}}: cluster {{}}', value, predicted_cluster) AS title FROM scored""",
)
ORACLE["stream_score"] = with_(
    SCORED,
    f"""SELECT event_id, segment_group, feature, bin, predicted_cluster, round(probability, 6) AS probability, {THIRD} AS bin_third,
    (SELECT CAST(sum(n) AS BIGINT) FROM cp WHERE cp.segment_group = scored.segment_group AND cp.cluster = scored.predicted_cluster) AS cluster_total,
    (SELECT n FROM dense WHERE dense.segment_group = scored.segment_group AND dense.cluster = scored.predicted_cluster AND dense.bin = scored.bin) AS cluster_in_bin
FROM scored""",
)
ORACLE["stream_rejects"] = """
SELECT event_id, CASE WHEN event_type = 'error' THEN 'NaN' ELSE event_type END AS segment_group,
    CASE WHEN event_type = 'error' THEN 'grouping value absent' ELSE 'no model or parameters' END AS reject_reason
FROM events WHERE event_type IN ('error', 'view')"""

ORACLE["stream_malformed"] = """
SELECT event_id, 'malformed row' AS reject_reason, event_id || CASE event_type WHEN 'error' THEN ',error,unreadable' WHEN 'signup' THEN ',signup,1,more'
    ELSE ',"view,' || CAST(floor(value) AS BIGINT) END AS line
FROM events WHERE event_type IN ('error', 'signup', 'view')"""

# --- runs -------------------------------------------------------------------

RUNS = """runs AS (SELECT CASE WHEN hour(ts) = 0 THEN 'x' ELSE '' END || strftime(ts, '%Y%m%d_%H%M%S') || '_run_' || event_type AS run_id, event_type,
    hour(ts) = 0 AS malformed, ts FROM events)"""
ORACLE["latest_run"] = with_(
    RUNS,
    """SELECT max(run_id) AS run_id, 'finished' AS registry FROM runs WHERE event_type = 'purchase'
UNION ALL SELECT max(run_id), 'unfinished' FROM runs WHERE NOT malformed""",
)
ORACLE["run_time_text"] = with_(
    RUNS,
    """SELECT DISTINCT run_id, CASE WHEN malformed THEN 'an unknown time' ELSE strftime(ts, '%B %d, %Y, at %H:%M:%S UTC') END AS run_time FROM runs""",
)

# --- facts of fitted steps ----------------------------------------------------

WHOLE = f"""{KEPT},
bins_of AS (SELECT segment_group, feature, bin, sum(n) AS s, sum(n * n) AS s2 FROM profile WHERE bin IS NOT NULL GROUP BY ALL),
combos_of AS (SELECT segment_group, feature, count(DISTINCT comb) AS combos FROM profile GROUP BY ALL),
total AS (SELECT segment_group, feature, round(sum(s2 - s * s * 1e0 / combos), 4) AS total_ss
    FROM bins_of JOIN combos_of USING (segment_group, feature) GROUP BY ALL)"""

ORACLE["k_sweep_facts"] = with_(
    WHOLE,
    """SELECT segment_group, feature, k, combos AS labelled, combos, TRUE AS at_most_k, total_ss, TRUE AS not_wider, TRUE AS silhouette_in_range
    FROM (SELECT *, CAST(unnest(range(2, least(6, combos - 1) + 1)) AS INTEGER) AS k FROM combos_of) JOIN total USING (segment_group, feature)""",
)
ORACLE["final_clusters_facts"] = with_(
    WHOLE, "SELECT segment_group, feature, combos, TRUE AS in_order, TRUE AS without_gaps FROM combos_of WHERE combos > 3"
)
ORACLE["pca_facts"] = with_(
    WHOLE,
    """SELECT segment_group, feature, combos, total_ss, TRUE AS centred, TRUE AS orthogonal, TRUE AS falling, TRUE AS part_of_all
    FROM combos_of JOIN total USING (segment_group, feature) WHERE combos > 1""",
)
ORACLE["outcome_facts"] = with_(
    WHOLE,
    """SELECT segment_group, feature, CAST(sum(s) AS BIGINT) AS profile_rows, TRUE AS regions_within
    FROM bins_of JOIN combos_of USING (segment_group, feature) WHERE combos > 3 GROUP BY ALL""",
)
