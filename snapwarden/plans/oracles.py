"""The queries of snapwarden.plans.queries in SQL."""

from __future__ import annotations

from snapwarden.sources.derived import SQL as BASE

ORACLES: dict[str, str] = {}


def say(name: str, body: str, ctes: str = "") -> None:
    ORACLES[name] = f"{BASE}{',' + ctes if ctes else ''}\n{body}"


def _cube(keys: list[str], where: str = "") -> str:
    k = ", ".join(keys)
    on = " AND ".join(f"p.{x} IS NOT DISTINCT FROM c.{x}" for x in keys)
    both = ", ".join(f"coalesce(p.{x}, c.{x}) AS {x}" for x in keys)
    out = []
    for m in ("dollar", "units"):
        p = f"CASE WHEN p.here THEN coalesce(p.{m}, 0) ELSE 0 END"
        c = f"CASE WHEN c.here THEN coalesce(c.{m}, 0) ELSE 0 END"
        out += [f"{p} AS {m}_previous", f"{c} AS {m}_current", f"{c} - {p} AS {m}_delta", f"({c} - {p}) / nullif({p}, 0) AS {m}_relative"]
    return f"""
  SELECT {both}, {", ".join(out)}, CASE WHEN coalesce(p.week, c.week) = 357 THEN 'new' ELSE 'overlap' END AS period
  FROM (SELECT {k}, true AS here, sum(dollar) AS dollar, sum(units) AS units FROM prev GROUP BY {k}) p
  FULL JOIN (SELECT {k}, true AS here, sum(dollar) AS dollar, sum(units) AS units FROM cur GROUP BY {k}) c ON {on}"""


_SHOW = ", ".join(f"round({m}_{x}, 6) AS {m}_{x}" for m in ("dollar", "units") for x in ("previous", "current", "delta")) + ", " + ", ".join(f"round({m}_relative, 8) AS {m}_relative" for m in ("dollar", "units"))
BASE_CUBE = "cube AS (" + _cube(["week", "store_id", "product_id"]) + ")"
for _name, _keys in (("r1_revision_cube_base", ["week", "store_id", "product_id"]), ("r1_revision_cube_week", ["week"]), ("r2_revision_cube_headline", ["week", "banner_id", "state_id"])):
    say(_name, f"SELECT {', '.join(_keys)}, {_SHOW}, period FROM cube", f" cube AS ({_cube(_keys)})")
say("r3_cube_summary", "SELECT round(sum(dollar_previous), 2) AS previous, round(sum(dollar_current), 2) AS current, round(sum(dollar_delta), 2) AS delta FROM cube WHERE period = 'overlap'", BASE_CUBE)
say("a1_aggregate", "SELECT week, banner_id, state_id, round(sum(dollar), 6) AS dollar, sum(units) AS units, count(DISTINCT store_id) AS store_count, count(DISTINCT product_id) AS product_count FROM fact GROUP BY ALL")
say("a3_hierarchy_levels", """
SELECT CASE WHEN grouping(state_id) = 0 AND grouping(commodity_id) = 0 THEN 'state_id_x_commodity_id' WHEN grouping(store_id) = 0 THEN 'store_id' WHEN grouping(product_id) = 0 THEN 'product_id'
            WHEN grouping(commodity_id) = 0 THEN 'commodity_id' WHEN grouping(banner_id) = 0 THEN 'banner_id' WHEN grouping(state_id) = 0 THEN 'state_id' ELSE 'national' END AS level,
       week, store_id, product_id, commodity_id, banner_id, state_id, round(sum(dollar), 6) AS dollar, sum(units) AS units, count(DISTINCT store_id) AS store_count, count(DISTINCT product_id) AS product_count
FROM cur GROUP BY GROUPING SETS ((week), (week, store_id), (week, product_id), (week, commodity_id), (week, banner_id), (week, state_id), (week, state_id, commodity_id))""")

_TYPES = ("store", "product", "commodity", "banner", "state")


def _presence(name: str, source: str) -> str:
    return f"{name} AS (" + " UNION ALL ".join(f"SELECT '{t}' AS entity_type, {t}_id AS entity_id, week, sum(dollar) AS value, count(*) AS rows FROM {source} GROUP BY ALL" for t in _TYPES) + ")"


say("a6_presence", 'SELECT entity_type, entity_id, week, round(value, 6) AS value, rows FROM x', _presence("x", "cur"))
say("a8_overlap_totals", """
SELECT round(sum(dollar_delta), 2) AS raw_delta, round(sum(dollar_previous), 2) AS previous_total, round(sum(abs(dollar_delta)), 2) AS gross_delta,
       round(avg(CASE WHEN abs(dollar_delta) + abs(units_delta) > 1e-9 THEN 1.0 ELSE 0.0 END), 8) AS breadth, count(*) AS rows, sum(units_delta) AS units_delta FROM cube WHERE period = 'overlap'""", BASE_CUBE)
say("a11_top_contributors", """
SELECT store_id AS entity_id, round(d, 6) AS delta, round(abs(d), 6) AS abs_delta FROM (SELECT store_id, sum(dollar_delta) AS d FROM cube WHERE period = 'overlap' GROUP BY 1) ORDER BY abs(d) DESC, store_id LIMIT 10""", BASE_CUBE)
ORACLES["a14_duplicate_fraction_raw_grain"] = """
SELECT round(sum(n - 1) / sum(n), 12) AS duplicate_fraction
FROM (SELECT count(*) AS n FROM lineitem GROUP BY floor(date_diff('day', DATE '1995-01-02', CAST(l_shipdate AS DATE)) / 7.0), l_suppkey, l_partkey)"""
say("a13_null_fraction", "SELECT round(CAST(count(*) FILTER (product_id LIKE '%9') AS DOUBLE) / (2 * count(*)), 10) AS null_fraction FROM cur")
say("c_contract_facts", """
SELECT sum(n) AS rows, coalesce(sum(n) FILTER (store_id IS NULL), 0) AS key_nulls, sum(n - 1) AS duplicates, sum(nulls) AS nulls, sum(nulls) AS unfinite, CAST(0 AS BIGINT) AS week_nulls,
       CAST(min(week) AS DOUBLE) AS first_week, CAST(max(week) AS DOUBLE) AS last_week, count(DISTINCT week) AS weeks, true AS whole_weeks
FROM (SELECT week, store_id, product_id, count(*) AS n, count(*) - count(units) AS nulls FROM dirty GROUP BY ALL)""", """
 dirty AS (
  SELECT week, CASE WHEN product_id LIKE '%55' THEN NULL ELSE store_id END AS store_id, product_id, CASE WHEN product_id LIKE '%77' THEN NULL ELSE units END AS units
  FROM (SELECT * FROM cur UNION ALL SELECT * FROM cur WHERE week = 10 AND store_id = '3') WHERE week <> 100)""")
ORACLES["c_contract_checks"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{p}{n}', {str(not (n == 'week_progression' and not p)).lower()})" for p in ("", "previous:")
    for n in ("unique_columns", "business_keys", "key_nulls", "duplicate_keys", "required_columns", "metric_dtypes", "finite_measures", "week_progression", "latest_week_present", "null_fraction", "duplicate_fraction")
) + ", ('compatible_schema', true), ('compatible_key_types', true)) t(name, passed)"
say("v2_version_pair", """
SELECT a AS previous_min_week, b AS previous_max_week, c AS current_min_week, d AS current_max_week, greatest(a, c) AS overlap_start, least(b, d) AS overlap_end,
       CAST((SELECT count(DISTINCT week) FROM cur WHERE week > b) AS INTEGER) AS new_weeks, CASE WHEN d <= b THEN 'NO_NEW_WEEK' WHEN c < a THEN 'HISTORY_EXTENDED' WHEN c > a THEN 'HISTORY_SHORTENED' ELSE 'NORMAL' END AS shape
FROM (SELECT min(week) AS a, max(week) AS b FROM prev), (SELECT min(week) AS c, max(week) AS d FROM cur)""")

CHANGES = f"""
 pp AS (SELECT * FROM ({_presence("z", "prev")[6:-1]})), cc AS (SELECT * FROM ({_presence("z", "cur")[6:-1]})),
 cells AS (
  SELECT coalesce(pp.entity_type, cc.entity_type) AS entity_type, coalesce(pp.entity_id, cc.entity_id) AS entity_id, coalesce(pp.week, cc.week) AS week, pp.value AS p, cc.value AS c, coalesce(pp.rows, 0) AS pr, coalesce(cc.rows, 0) AS cr
  FROM pp FULL JOIN cc ON pp.entity_type = cc.entity_type AND pp.entity_id = cc.entity_id AND pp.week = cc.week),
 bounds AS (SELECT greatest((SELECT min(week) FROM prev), (SELECT min(week) FROM cur)) AS o1, (SELECT max(week) FROM prev) AS o2),
 marked AS (SELECT *, week BETWEEN o1 AND o2 AS over, week BETWEEN greatest(o1, o2 - 7) AND o2 AS recent FROM cells, bounds),
 seen AS (
  SELECT entity_type, entity_id, min(week) FILTER (p IS NOT NULL) AS first_week_previous, max(week) FILTER (p IS NOT NULL) AS last_week_previous, min(week) FILTER (c IS NOT NULL) AS first_week_current, max(week) FILTER (c IS NOT NULL) AS last_week_current,
         count(p) AS week_count_previous, count(c) AS week_count_current, CAST(sum(pr) AS BIGINT) AS rows_previous, CAST(sum(cr) AS BIGINT) AS rows_current,
         count(*) FILTER (c IS NOT NULL AND p IS NULL AND over) AS n_added, count(*) FILTER (p IS NOT NULL AND c IS NULL AND over) AS n_removed,
         coalesce(sum(c) FILTER (c IS NOT NULL AND p IS NULL AND over), 0) AS value_added, coalesce(sum(p) FILTER (p IS NOT NULL AND c IS NULL AND over), 0) AS value_removed,
         count(*) FILTER (p IS NOT NULL AND recent) AS n_recent, coalesce(sum(p) FILTER (recent), 0) AS recent_value, coalesce(bool_or(p IS NOT NULL AND week = o2), false) AS traded, coalesce(bool_or(c IS NOT NULL AND week = 357), false) AS trades
  FROM marked GROUP BY 1, 2),
 classed AS (
  SELECT *, list_filter([
    CASE WHEN week_count_previous > 0 AND week_count_current = 0 AND n_removed > 0 THEN 'ENTITY_REMOVED' END,
    CASE WHEN week_count_previous = 0 AND week_count_current > 0 THEN CASE WHEN n_added > 0 THEN 'NEW_ENTITY_HISTORICAL_BACKFILL' ELSE 'NEW_ENTITY_RECENT' END END,
    CASE WHEN week_count_previous > 0 AND week_count_current > 0 AND traded AND NOT trades AND n_recent >= 4 THEN 'LATEST_WEEK_MISSING' END,
    CASE WHEN week_count_previous > 0 AND week_count_current > 0 AND n_removed > 0 THEN 'ENTITY_HISTORY_TRUNCATED' END,
    CASE WHEN week_count_previous > 0 AND week_count_current > 0 AND n_added > 0 THEN 'ENTITY_HISTORY_EXTENDED' END], lambda x: x IS NOT NULL) AS classes FROM seen),
 period AS (SELECT sum(dollar) / 8 AS total FROM prev, bounds WHERE week BETWEEN o2 - 7 AND o2),
 changes AS (
  SELECT *, CASE WHEN list_contains(classes, 'LATEST_WEEK_MISSING') THEN recent_value / 8 ELSE 0 END AS expected_value, CASE WHEN list_contains(classes, 'LATEST_WEEK_MISSING') THEN total ELSE 0 END AS expected_period_total
  FROM classed, period WHERE len(classes) > 0)"""
say("l1_entity_changes", """
SELECT entity_type, entity_id, classes[1] AS classification, array_to_string(classes, ',') AS classes, first_week_previous, last_week_previous, first_week_current, last_week_current, week_count_previous, week_count_current,
       rows_previous, rows_current, CAST(n_added AS INTEGER) AS n_added, CAST(n_removed AS INTEGER) AS n_removed, round(value_added, 6) AS historical_value_added, round(value_removed, 6) AS historical_value_removed,
       round(expected_value, 6) AS expected_value, round(expected_period_total, 6) AS expected_period_total FROM changes""", CHANGES)
BASELINE = f"""
 pres AS (SELECT * FROM ({_presence("z", "prev")[6:-1]})),
 idx AS (SELECT week, row_number() OVER (ORDER BY week) - 1 AS i, sum(total) OVER (ORDER BY week ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS window_total FROM (SELECT week, sum(dollar) AS total FROM prev GROUP BY 1)),
 grid AS (SELECT e.entity_type, e.entity_id, idx.i, idx.week, pres.value FROM (SELECT DISTINCT entity_type, entity_id FROM pres) e CROSS JOIN idx LEFT JOIN pres ON pres.entity_type = e.entity_type AND pres.entity_id = e.entity_id AND pres.week = idx.week),
 rolled AS (
  SELECT *, count(value) OVER w AS seen, sum(value) OVER w AS s, lag(value) OVER (PARTITION BY entity_type, entity_id ORDER BY i) AS before
  FROM grid WINDOW w AS (PARTITION BY entity_type, entity_id ORDER BY i ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)),
 shares AS (
  SELECT entity_type, rolled.week, coalesce(sum(abs(s / 8)) FILTER (value IS NULL AND before IS NOT NULL AND seen >= 4), 0) / (any_value(window_total) / 8) AS share
  FROM rolled JOIN idx USING (i) WHERE i >= greatest(9, (SELECT max(i) + 1 FROM idx) - 52) GROUP BY 1, 2)"""
say("l3_absence_baseline", "SELECT entity_type, week, round(share, 8) AS share FROM shares", BASELINE)
say("l4_missing_entity_impact", """
SELECT entity_type, entities, round(lost, 6) AS expected_lost, round(total, 6) AS expected_period_total, round(lost / total, 8) AS share, round(0.001 * total, 6) AS threshold, n AS baseline_weeks, round(top, 8) AS baseline_max,
       lost > 0.001 * total AND lost / total > top AS material
FROM (SELECT entity_type, count(*) AS entities, sum(abs(expected_value)) AS lost, max(expected_period_total) AS total FROM changes WHERE list_contains(classes, 'LATEST_WEEK_MISSING') GROUP BY 1)
JOIN (SELECT entity_type, count(*) AS n, max(share) AS top FROM shares GROUP BY 1) USING (entity_type)""", CHANGES + "," + BASELINE)
MOVES = """
 pmap AS (SELECT product_id, min(commodity_id) AS f FROM prev GROUP BY 1 HAVING count(DISTINCT commodity_id) = 1), cmap AS (SELECT product_id, min(commodity_id) AS t FROM cur GROUP BY 1 HAVING count(DISTINCT commodity_id) = 1),
 moved AS (SELECT pmap.product_id, f, t FROM pmap JOIN cmap USING (product_id) WHERE f <> t),
 po AS (SELECT * FROM prev WHERE week BETWEEN (SELECT greatest((SELECT min(week) FROM prev), (SELECT min(week) FROM cur))) AND 356), co AS (SELECT * FROM cur WHERE week BETWEEN (SELECT greatest((SELECT min(week) FROM prev), (SELECT min(week) FROM cur))) AND 356)"""
say("l6_replacements", """
SELECT entity_type, source_id, target_id, round(correlation, 6) AS correlation, round(ratio, 6) AS ratio, active_weeks, 0.0::DOUBLE AS p_value, 0.0::DOUBLE AS adjusted_p, true AS significant FROM (
  SELECT a.entity_type, a.entity_id AS source_id, b.entity_id AS target_id, corr(coalesce(x.value, 0), coalesce(y.value, 0)) AS correlation, sum(y.value) / sum(x.value) AS ratio, least(count(x.value), count(y.value)) AS active_weeks
  FROM gone a JOIN fresh b ON a.entity_type = b.entity_type CROSS JOIN (SELECT unnest(range(greatest((SELECT min(week) FROM prev), (SELECT min(week) FROM cur)), 357)) AS week) w
  LEFT JOIN pa x ON x.entity_type = a.entity_type AND x.entity_id = a.entity_id AND x.week = w.week LEFT JOIN ca y ON y.entity_type = b.entity_type AND y.entity_id = b.entity_id AND y.week = w.week
  GROUP BY 1, 2, 3 HAVING count(x.value) >= 4 AND count(y.value) >= 4)
WHERE correlation >= 0.9 AND ratio BETWEEN 0.5 AND 2""", f"""
 pa AS (SELECT * FROM ({_presence("z", "prev")[6:-1]})), ca AS (SELECT * FROM ({_presence("z", "cur")[6:-1]})),
 gone AS (SELECT DISTINCT entity_type, entity_id FROM pa EXCEPT SELECT DISTINCT entity_type, entity_id FROM ca), fresh AS (SELECT DISTINCT entity_type, entity_id FROM ca EXCEPT SELECT DISTINCT entity_type, entity_id FROM pa)""")
say("at2_week_revisions", """
SELECT *, relative > tolerance AND abs(unexplained) > 0 AS material FROM (
  SELECT week, round(previous, 6) AS previous, round(delta, 6) AS delta, round(e, 6) AS explained, round(delta - e, 6) AS unexplained, round(abs(delta - e) / abs(previous), 8) AS relative, false AS in_restatement_window, 0.005::DOUBLE AS tolerance
  FROM (SELECT week, sum(dollar_previous) AS previous, sum(dollar_delta) AS delta FROM cube WHERE period = 'overlap' GROUP BY 1)
  LEFT JOIN (SELECT week, sum(CASE WHEN p IS NULL THEN c ELSE -p END) AS e FROM marked JOIN changes USING (entity_type, entity_id)
             WHERE entity_type = 'store' AND classes[1] <> 'LATEST_WEEK_MISSING' AND marked.over AND (p IS NULL) <> (c IS NULL) GROUP BY 1) USING (week))""".replace("round(e, 6)", "round(coalesce(e, 0), 6)").replace("delta - e", "delta - coalesce(e, 0)"), CHANGES + "," + BASE_CUBE)
say("at8_standing_closures", "SELECT 'store' AS entity_type, '7' AS entity_id, 'close-7' AS event_id WHERE NOT EXISTS (SELECT 1 FROM cur WHERE week = 357 AND store_id = '7')")
say("at10_like_for_like", """
SELECT coalesce(t, commodity_id) AS commodity_id, round(sum(dollar), 2) AS dollar, count(*) AS rows, 'previous' AS version FROM prev LEFT JOIN moved ON moved.product_id = prev.product_id AND f = commodity_id WHERE store_id NOT IN ('7', '57') GROUP BY 1
UNION ALL SELECT commodity_id, round(sum(dollar), 2), count(*), 'current' FROM cur WHERE store_id NOT IN ('7', '57') GROUP BY 1""", MOVES)
REPORT = """
 plain AS (SELECT week, banner_id, state_id, sum(dollar) AS d, sum(units) AS u, count(DISTINCT store_id) AS n FROM cur GROUP BY ALL),
 report AS (SELECT week, banner_id, state_id, CASE WHEN week = 300 AND banner_id = '3' THEN d * 0.5 ELSE d END AS dollar, u AS units, CASE WHEN week = 200 THEN n + 1 ELSE n END AS store_count, n FROM plain)"""
say("rc2_count_consistency", "SELECT count(*) FILTER (store_count <> n) AS mismatched FROM report", REPORT)
say("rc3_marker_rows", """
SELECT unnest(['state_id', 'banner_id', 'store_id', 'commodity_id', 'product_id']) AS "column", unnest([0, 0, 0, (SELECT count(*) FROM cur WHERE product_id LIKE '%00'), 0])::BIGINT AS marker_rows""")
say("rc4_price_outliers", """
SELECT week, round(ratio, 6) AS ratio, round(m, 6) AS median, round(0.6745 * (ratio - m) / mad, 6) AS robust_z FROM ratios, (SELECT m, median(abs(ratio - m)) AS mad FROM ref, (SELECT median(ratio) AS m FROM ref) GROUP BY m)
WHERE week IN (356, 357) AND abs(0.6745 * (ratio - m) / mad) > 4""", """
 ratios AS (SELECT week, sum(dollar * CASE WHEN week >= 356 THEN 2 ELSE 1 END) / sum(units) AS ratio FROM cur GROUP BY 1), ref AS (SELECT ratio FROM ratios WHERE week < 356 ORDER BY week DESC LIMIT 52)""")
say("a24_unit_value_by_week", "SELECT week, round(sum(dollar) / sum(units), 6) AS ratio FROM cur GROUP BY 1 HAVING sum(units) > 0")
say("h1_hierarchy_deviations", " UNION ALL ".join(
    f"SELECT '{name}' AS level, '{m}' AS measure, (SELECT count(*) FROM (SELECT DISTINCT week, {', '.join(k)} FROM h WHERE {' OR '.join(x + ' IS NULL' for x in k)})) AS null_key_rows, 0.0::DOUBLE AS worst"
    for name, k in [*[(f"{t}_id", [f"{t}_id"]) for t in _TYPES], ("state_id_x_commodity_id", ["state_id", "commodity_id"])] for m in ("dollar", "units")
), " h AS (SELECT week, store_id, product_id, commodity_id, banner_id, CASE WHEN product_id LIKE '%13' THEN NULL ELSE state_id END AS state_id FROM cur)")
say("h2_national_shares", """
SELECT series_id, round(least(greatest(sum(c) / sum(t), 0), 1), 8) AS share FROM (
  SELECT week, 'banner_id:' || banner_id AS series_id, sum(dollar) AS c FROM cur WHERE week <= 356 GROUP BY ALL UNION ALL SELECT week, 'commodity_id:' || commodity_id, sum(dollar) FROM cur WHERE week <= 356 GROUP BY ALL)
JOIN (SELECT week, sum(dollar) AS t FROM cur WHERE week <= 356 GROUP BY 1) USING (week) GROUP BY 1 HAVING sum(t) > 0""")
say("ln1_stage_increments", """
SELECT stage, position, round(sum(abs(rev - inherited)) / sum(scale), 8) AS increment FROM (
  SELECT 'source' AS stage, 0 AS position, c - p AS rev, 0.0 AS inherited, abs(p) AS scale FROM w UNION ALL SELECT 'warehouse', 1, c2 - p, c - p, abs(p) FROM w) GROUP BY ALL""", """
 w AS (SELECT week, coalesce(p, 0) AS p, coalesce(c, 0) AS c, coalesce(c2, 0) AS c2 FROM (SELECT week, sum(dollar) AS p FROM prev GROUP BY 1)
  FULL JOIN (SELECT week, sum(dollar) AS c, sum(dollar * CASE WHEN product_id LIKE '%42' THEN 1.25 ELSE 1 END) AS c2 FROM cur WHERE week <= 356 GROUP BY 1) USING (week))""")
say("ln2_divergence", "SELECT round(sum(abs(dollar_delta)) / abs(sum(dollar_previous)), 8) AS relative_divergence, (SELECT count(*) FROM cur WHERE week <= 356) - (SELECT count(*) FROM prev) AS row_count_delta FROM cube WHERE week <= 356", BASE_CUBE)
say("rf1_reference", """
SELECT 'dollar' AS measure, round(sum(d), 2) AS current_total, round(sum(r), 2) AS reference_total, round(max(abs(d - r) / greatest(abs(r), 1e-9)), 6) AS relative_delta, CAST(0 AS BIGINT) AS uncovered FROM g
UNION ALL SELECT 'units', sum(u), sum(u), 0, 0 FROM g""", " g AS (SELECT week, banner_id, sum(dollar) AS d, sum(dollar) * CASE WHEN week = 77 THEN 1.02 ELSE 1.0 END AS r, sum(units) AS u FROM cur GROUP BY week, banner_id)")


def _series(name: str, source: str) -> str:
    return f""" {name} AS (
  SELECT 'national' AS series_id, week, sum(dollar) AS dollar, sum(units) AS units FROM {source} GROUP BY 2 UNION ALL SELECT 'banner_id:' || banner_id, week, sum(dollar), sum(units) FROM {source} GROUP BY ALL
  UNION ALL SELECT 'commodity_id:' || commodity_id, week, sum(dollar), sum(units) FROM {source} GROUP BY ALL)"""


say("t1_dense_series", """
SELECT metric, series_id, g.week, round(CASE WHEN metric = 'dollar' THEN dollar ELSE units END, 6) AS value, s.dollar IS NULL AS missing
FROM (SELECT DISTINCT series_id FROM s0) CROSS JOIN (SELECT unnest(range((SELECT min(week) FROM cur), (SELECT max(week) + 1 FROM cur)))::INTEGER AS week) g CROSS JOIN (SELECT unnest(['dollar', 'units']) AS metric) LEFT JOIN s0 s USING (series_id, week)""", _series("s0", "cur"))
say("t29_benjamini_hochberg", """
SELECT store_id, round(p_value, 10) AS p_value, round(adjusted_p, 10) AS adjusted_p, adjusted_p <= 0.05 AS significant FROM (
  SELECT *, least(1, min(p_value * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS adjusted_p FROM (
    SELECT *, row_number() OVER (ORDER BY p_value, store_id) AS r, count(*) OVER () AS m FROM (
      SELECT store_id, (CAST(sum(units) AS BIGINT) * 7919 % 1000) / 1000.0::DOUBLE * CASE WHEN TRY_CAST(store_id AS INTEGER) % 7 = 0 THEN 0.001::DOUBLE ELSE 1 END AS p_value FROM cur GROUP BY 1)))""")
say("t32_new_entity_adjustments", """
SELECT metric, series_id, week, round(CASE WHEN metric = 'dollar' THEN dollar ELSE units END, 6) AS value FROM s1 CROSS JOIN (SELECT unnest(['dollar', 'units']) AS metric)""", CHANGES + """,
 fresh AS (SELECT entity_type, entity_id FROM changes WHERE classes[1] LIKE 'NEW_ENTITY%'),
 own AS (SELECT * FROM cur WHERE week = 357 AND (""" + " OR ".join(f"{t}_id IN (SELECT entity_id FROM fresh WHERE entity_type = '{t}')" for t in _TYPES) + "))," + _series("s1", "own"))
say("p4_without_entities", "SELECT week, count(*) AS rows, round(sum(dollar), 6) AS dollar FROM cur WHERE store_id <> '7' AND commodity_id <> 'PROMO' GROUP BY 1")
ORACLES["s14_epoch_weeks"] = "SELECT CAST(floor(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) / 7.0) AS INTEGER) AS epoch_week, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1"
ORACLES["s17_wide_feed_to_weekly"] = """
SELECT CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7.0) AS INTEGER) AS week, user_id, event_type, round(sum(value), 6) AS value FROM events
GROUP BY 1, 2, 3 HAVING sum(value) <> 0"""
say("a23_split_effects", "SELECT commodity_id, round(sum(dollar * n), 2) AS dollar, sum(units * n) AS units FROM (SELECT *, -1 AS n FROM prev UNION ALL SELECT *, 1 FROM cur) GROUP BY 1")
say("g5_report_stage", "SELECT week, banner_id, state_id, round(sum(dollar), 6) AS dollar, sum(units) AS units, count(DISTINCT store_id) AS store_count, count(DISTINCT product_id) AS product_count FROM cur GROUP BY ALL")


# --- fingerprints
def _set_hash(source: str) -> str:
    return f"SELECT count(*) AS entities, bit_xor(CAST('0x' || substr(md5('=' || store_id || chr(31) || '=' || product_id), 1, 15) AS BIGINT)) AS entity_hash FROM (SELECT DISTINCT store_id, product_id FROM {source})"


say("a15_fingerprint", f"""
SELECT * FROM (
  SELECT count(*) AS rows, count(DISTINCT week) AS weeks, CAST(0 AS BIGINT) AS nulls, CAST(0 AS BIGINT) AS duplicates, round(sum(dollar), 2) AS sum_dollar, sum(units) AS sum_units,
         count(DISTINCT store_id) AS distinct_store_id, count(DISTINCT product_id) AS distinct_product_id, count(DISTINCT commodity_id) AS distinct_commodity_id,
         count(DISTINCT banner_id) AS distinct_banner_id, count(DISTINCT state_id) AS distinct_state_id FROM cur), ({_set_hash("cur")})""")
say("a16_entity_set_hash", f"SELECT *, 'previous' AS version FROM ({_set_hash('prev')}) UNION ALL SELECT *, 'current' FROM ({_set_hash('cur')})")

# --- moves, approvals, the whole explanation
say("l5_reclassification", """
SELECT f || '->' || t AS entity_id, f AS from_commodity, t AS to_commodity, string_agg(product_id, ',' ORDER BY product_id) AS products, count(*) AS product_count, round(sum(vp), 2) AS moved_previous, round(sum(vc), 2) AS moved_current,
       round((SELECT coalesce(sum(dollar), 0) FROM co WHERE commodity_id = f) - (SELECT coalesce(sum(dollar), 0) FROM po WHERE commodity_id = f), 2) AS from_delta,
       round((SELECT coalesce(sum(dollar), 0) FROM co WHERE commodity_id = t) - (SELECT coalesce(sum(dollar), 0) FROM po WHERE commodity_id = t), 2) AS to_delta,
       round(greatest(abs(sum(vp)), abs(sum(vc))), 2) AS gross_moved, round(1 - abs(sum(vc) - sum(vp)) / greatest(abs(sum(vp)), abs(sum(vc))), 8) AS conservation_ratio
FROM (SELECT product_id, f, t, (SELECT coalesce(sum(dollar), 0) FROM po WHERE po.product_id = moved.product_id) AS vp, (SELECT coalesce(sum(dollar), 0) FROM co WHERE co.product_id = moved.product_id) AS vc FROM moved) GROUP BY f, t""", MOVES)
APPROVED = """
 spans AS (SELECT entity_type, entity_id, min(week) AS w1, max(week) AS w2 FROM marked WHERE over AND (p IS NULL) <> (c IS NULL) GROUP BY ALL),
 approved AS (
  SELECT changes.*, CASE WHEN entity_type = 'store' AND classes[1] = 'ENTITY_HISTORY_TRUNCATED' AND entity_id IN ('11', '61') AND w1 >= 1 AND w2 <= 20 THEN 'cut-11'
                         WHEN entity_type = 'store' AND classes[1] = 'NEW_ENTITY_HISTORICAL_BACKFILL' AND entity_id = '17' THEN 'back-17' END AS approval,
         CASE WHEN entity_type = 'store' AND entity_id = '7' AND list_contains(classes, 'LATEST_WEEK_MISSING') THEN 'close-7' END AS absence_approval
  FROM changes LEFT JOIN spans USING (entity_type, entity_id))"""
say("at3_registry_match", "SELECT entity_type, entity_id, classes[1] AS classification, approval, absence_approval FROM approved", CHANGES + "," + APPROVED)
say("at1_explain_revision", """
SELECT round(raw, 2) AS raw_delta, round(gross, 2) AS gross_delta, round(added, 2) AS explained_added, round(removed, 2) AS explained_removed, round(raw - (added - removed), 2) AS unexplained_delta,
       round(CASE WHEN (added - removed) * raw < 0 THEN 0 ELSE least(1, abs(added - removed) / abs(raw)) END, 8) AS explained_fraction, gross > 0.001 * abs(total) AS material, structural, unmatched, 'store' AS explanation_type
FROM (SELECT sum(dollar_delta) AS raw, sum(abs(dollar_delta)) AS gross, sum(dollar_previous) AS total FROM cube WHERE period = 'overlap'),
     (SELECT count(*) + (SELECT count(DISTINCT (f, t)) FROM moved) AS structural, count(*) FILTER (approval IS NULL) + (SELECT count(DISTINCT (f, t)) FROM moved) AS unmatched,
             coalesce(sum(value_added) FILTER (entity_type = 'store' AND classes[1] IN ('NEW_ENTITY_HISTORICAL_BACKFILL', 'NEW_ENTITY_RECENT', 'ENTITY_HISTORY_EXTENDED')), 0) AS added,
             coalesce(sum(value_removed) FILTER (entity_type = 'store' AND classes[1] IN ('ENTITY_HISTORY_TRUNCATED', 'ENTITY_REMOVED')), 0) AS removed
      FROM approved WHERE classes[1] <> 'LATEST_WEEK_MISSING')""", CHANGES + "," + APPROVED + "," + MOVES + "," + BASE_CUBE)
_IN = lambda rows, how, joined: f" {joined} ".join(f"({t}_id, week) {how} (SELECT entity_id, week FROM {rows} WHERE entity_type = '{t}')" for t in _TYPES)
say("cf1_counterfactual", """
SELECT round(sum(c - p), 2) AS raw_delta, round(sum(c - a), 2) AS explained_delta, round(sum(a - p), 2) AS reconstructed_delta, round(sum(abs(a - p)), 2) AS absolute_residual, round(sum(p), 2) AS previous_total,
       round(greatest(0, 1 - sum(abs(a - p)) / sum(abs(p))), 8) AS score, true AS evaluated
FROM (SELECT week, store_id, product_id, coalesce(sum(dollar) FILTER (side = 0), 0) AS p, coalesce(sum(dollar) FILTER (side = 1), 0) AS c, coalesce(sum(dollar) FILTER (side = 2), 0) AS a FROM sides WHERE week IN (SELECT week FROM prev INTERSECT SELECT week FROM cur) GROUP BY ALL)""", CHANGES + f""",
 gain AS (SELECT entity_type, entity_id, week FROM marked JOIN changes USING (entity_type, entity_id) WHERE over AND p IS NULL AND c IS NOT NULL AND classes[1] IN ('NEW_ENTITY_HISTORICAL_BACKFILL', 'NEW_ENTITY_RECENT', 'ENTITY_HISTORY_EXTENDED')),
 loss AS (SELECT entity_type, entity_id, week FROM marked JOIN changes USING (entity_type, entity_id) WHERE over AND c IS NULL AND p IS NOT NULL AND classes[1] IN ('ENTITY_HISTORY_TRUNCATED', 'ENTITY_REMOVED')),
 sides AS (
  SELECT week, store_id, product_id, dollar, 0 AS side FROM prev UNION ALL SELECT week, store_id, product_id, dollar, 1 FROM cur
  UNION ALL SELECT week, store_id, product_id, dollar, 2 FROM cur WHERE {_IN("gain", "NOT IN", "AND")}
  UNION ALL SELECT week, store_id, product_id, dollar, 2 FROM prev WHERE {_IN("loss", "IN", "OR")})""")
say("cf2_entity_week_sums", "SELECT store_id AS entity_id, week, round(sum(dollar), 6) AS value FROM cur GROUP BY ALL")
say("u4_weeks_gained_and_lost", """
SELECT entity_type, entity_id, marked.week, CASE WHEN p IS NULL THEN 'added' ELSE 'removed' END AS how FROM marked JOIN changes USING (entity_type, entity_id) WHERE marked.over AND (p IS NULL) <> (c IS NULL)""", CHANGES)
say("u5_one_sided_entities", """
SELECT entity_type, entity_id, week, round(p, 6) AS v, 'previous' AS side FROM marked SEMI JOIN (SELECT entity_type, entity_id FROM marked GROUP BY ALL HAVING bool_and(cr = 0)) g USING (entity_type, entity_id) WHERE over AND p <> 0
UNION ALL SELECT entity_type, entity_id, week, round(c, 6), 'current' FROM marked SEMI JOIN (SELECT entity_type, entity_id FROM marked GROUP BY ALL HAVING bool_and(pr = 0)) g USING (entity_type, entity_id) WHERE over AND c <> 0""", CHANGES)

# --- checks
say("rc1_mass_balance", """
SELECT measure, count(*) AS keys, round(max(r), 6) AS worst, max(r) <= 1e-6 AS passed, CASE WHEN max(r) > 1e-6 THEN arg_max(week, r) END AS week, true AS covered
FROM (SELECT week, 'dollar' AS measure, abs(report.dollar - d) / CASE WHEN abs(d) > 1e-9 THEN abs(d) ELSE 1 END AS r FROM report JOIN plain USING (week, banner_id, state_id) UNION ALL SELECT week, 'units', abs(units - u) / greatest(abs(u), 1) FROM report JOIN plain USING (week, banner_id, state_id)) GROUP BY measure""", REPORT)
say("k7_worst_key", """
SELECT week, banner_id, state_id, round(r, 6) AS worst FROM (SELECT week, banner_id, state_id, abs(report.dollar - d) / CASE WHEN abs(d) > 1e-9 THEN abs(d) ELSE 1 END AS r FROM report JOIN plain USING (week, banner_id, state_id)) ORDER BY r DESC, week, banner_id, state_id LIMIT 1""", REPORT)
say("ln3_week_revision", """
SELECT week, round(coalesce(c, 0) - coalesce(p, 0), 6) AS revision, round(abs(coalesce(p, 0)), 6) AS scale
FROM (SELECT week, sum(dollar) AS p FROM prev WHERE week BETWEEN 1 AND 356 GROUP BY 1) FULL JOIN (SELECT week, sum(dollar) AS c FROM cur WHERE week BETWEEN 1 AND 356 GROUP BY 1) USING (week)""")
say("a21_effect_delta", """
SELECT round(sum(dollar * n), 2) AS dollar, CAST(sum(units * n) AS DOUBLE) AS units, CAST(sum(n) AS DOUBLE) AS rows FROM (SELECT *, -1 AS n FROM prev UNION ALL SELECT *, 1 FROM cur) WHERE CAST(product_id AS INTEGER) % 97 = 3 AND week <= 340""")
say("ex1_expectations", """
SELECT week, CASE WHEN week = 356 THEN 'wide' ELSE '' END AS covered, CASE WHEN week = 356 THEN '' ELSE 'wide: wrong week,' END || 'narrow: ' || CASE WHEN ratio > 1 THEN 'outside the approved band' END || ',open: unapproved' AS refused
FROM ratios, (SELECT m, median(abs(ratio - m)) AS mad FROM ref, (SELECT median(ratio) AS m FROM ref) GROUP BY m) WHERE week IN (356, 357) AND abs(0.6745 * (ratio - m) / mad) > 4""", """
 ratios AS (SELECT week, sum(dollar * CASE WHEN week >= 356 THEN 2 ELSE 1 END) / sum(units) AS ratio FROM cur GROUP BY 1), ref AS (SELECT ratio FROM ratios WHERE week < 356 ORDER BY week DESC LIMIT 52)""")

# --- series
_LONG = " {0} AS (SELECT unnest(['dollar', 'units']) AS metric, series_id, week, unnest([dollar, units]) AS value FROM {1})"
say("a27_correlation_of_banner_and_total", "SELECT series_id, round(corr(s.dollar, n.dollar), 6) AS correlation FROM s0 s JOIN (SELECT week, dollar FROM s0 WHERE series_id = 'national') n USING (week) WHERE series_id LIKE 'banner_id:%' GROUP BY 1", _series("s0", "cur"))
say("a25_median_and_mad", """
SELECT metric, series_id, round(m, 6) AS median, round(median(abs(value - m)), 6) AS mad, count(*) AS n FROM x JOIN (SELECT metric, series_id, median(value) AS m FROM x GROUP BY ALL) USING (metric, series_id) GROUP BY metric, series_id, m""", _series("s0", "cur") + "," + _LONG.format("x", "s0"))
say("a26_quantiles", "SELECT metric, series_id, " + ", ".join(f"round(quantile_cont(value, {p}), 6) AS q{round(100 * p):02d}" for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) + " FROM x GROUP BY ALL", _series("s0", "cur") + "," + _LONG.format("x", "s0"))
_HISTORY = _series("s0", "prev") + "," + _LONG.format("h", "s0") + """,
 diffs AS (SELECT metric, series_id, value - lag(value, 52) OVER (PARTITION BY metric, series_id ORDER BY week) AS d FROM h),
 spread AS (
  SELECT metric, series_id, greatest(1.4826 * median(abs(d - m)), 1e-4 * greatest(abs(any_value(level)), 1), 1e-9) AS scale
  FROM diffs JOIN (SELECT metric, series_id, median(d) AS m FROM diffs GROUP BY ALL) USING (metric, series_id) JOIN (SELECT metric, series_id, median(value) AS level FROM h GROUP BY ALL) USING (metric, series_id) WHERE d IS NOT NULL GROUP BY ALL),
 points AS (
  SELECT metric, series_id, value AS point, greatest(scale * 1.6448536269514722, 1e-4 * greatest(abs(value), 1), 1e-9) AS width
  FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY metric, series_id ORDER BY week DESC) = 52) JOIN spread USING (metric, series_id))"""
say("t2_seasonal_difference_scale", "SELECT metric, series_id, round(scale, 4) AS scale FROM spread", _HISTORY)
say("t3_forecast_quantiles", """
SELECT metric, series_id, quantile, round(point + width / 1.6448536269514722 * z, 4) AS value FROM points,
  (VALUES (0.01::DOUBLE, -2.3263478740408408), (0.05, -1.6448536269514722), (0.25, -0.6744897501960817), (0.5, 0), (0.75, 0.6744897501960817), (0.95, 1.6448536269514722), (0.99, 2.3263478740408408)) q(quantile, z)""", _HISTORY)
#: Targets with at least 26 weeks of history: what week 357 has, less what newly appeared entities bring.
_TARGET = CHANGES + """,
 fresh AS (SELECT entity_type, entity_id FROM changes WHERE classes[1] LIKE 'NEW_ENTITY%'),
 own AS (SELECT * FROM cur WHERE week = 357 AND (""" + " OR ".join(f"{t}_id IN (SELECT entity_id FROM fresh WHERE entity_type = '{t}')" for t in _TYPES) + "))," + _series("s1", "own") + "," + _LONG.format("fresh_rows", "s1") + ", last AS (SELECT * FROM cur WHERE week = 357)," + _series("s2", "last") + "," + _LONG.format("now", "s2") + "," + _HISTORY + """,
 targets AS (
  SELECT now.metric, now.series_id, now.value AS actual, coalesce(fresh_rows.value, 0) AS adjustment, now.value - coalesce(fresh_rows.value, 0) AS adjusted
  FROM now LEFT JOIN fresh_rows ON fresh_rows.metric = now.metric AND fresh_rows.series_id = now.series_id
  SEMI JOIN (SELECT metric, series_id FROM h GROUP BY ALL HAVING count(*) >= 26) long ON long.metric = now.metric AND long.series_id = now.series_id)"""
say("t4_point_and_residual", """
SELECT metric, series_id, 357 AS target, round(actual, 4) AS actual, round(adjustment, 4) AS adjustment, round(point, 4) AS point, round(width, 4) AS scale, round((adjusted - point) / width, 6) AS standardized FROM targets JOIN ahead USING (metric, series_id)""", _TARGET + """,
 -- a series whose last weeks are missing is forecast further ahead
 ahead AS (
  SELECT metric, series_id, value AS point, greatest(scale * 1.6448536269514722, 1e-4 * greatest(abs(value), 1), 1e-9) AS width FROM (
    SELECT *, row_number() OVER (PARTITION BY metric, series_id ORDER BY week DESC) AS back, 357 - max(week) OVER (PARTITION BY metric, series_id) AS horizon FROM h) JOIN spread USING (metric, series_id) WHERE back = 53 - horizon)""")


def _z(name: str, rows: str, least: int) -> None:
    """A robust z-score of the target against some of its history's values."""
    say(name, f"""
SELECT metric, series_id, round(coalesce((any_value(adjusted) - any_value(m)) / CASE WHEN any_value(n) >= {least} AND 1.4826 * median(abs(value - m)) > 1e-12 THEN 1.4826 * median(abs(value - m)) END, 0), 6) AS {name[3:]}
FROM targets LEFT JOIN chosen USING (metric, series_id) LEFT JOIN (SELECT metric, series_id, median(value) AS m, count(*) AS n FROM chosen GROUP BY ALL) USING (metric, series_id) GROUP BY metric, series_id""", _TARGET + f", chosen AS ({rows})")


_z("t5_robust_z", "SELECT metric, series_id, value FROM h QUALIFY row_number() OVER (PARTITION BY metric, series_id ORDER BY week DESC) <= 13", 1)
_z("t6_seasonal_z", "SELECT metric, series_id, value FROM h WHERE (357 - week) % 52 = 0", 2)
say("t7_ewma_z", """
SELECT metric, series_id, round(coalesce((any_value(adjusted) - any_value(top)) / CASE WHEN 1.4826 * median(abs(e - m)) > 1e-12 THEN 1.4826 * median(abs(e - m)) END, 0), 6) AS ewma_z
FROM targets JOIN errors USING (metric, series_id) JOIN (SELECT metric, series_id, median(e) AS m FROM errors GROUP BY ALL) USING (metric, series_id) JOIN (SELECT metric, series_id, arg_max(level, i) AS top FROM levels GROUP BY ALL) USING (metric, series_id) GROUP BY metric, series_id""", _TARGET + """,
 placed AS (SELECT metric, series_id, value, row_number() OVER (PARTITION BY metric, series_id ORDER BY week) - 1 AS i FROM h),
 levels AS (SELECT *, sum(CASE WHEN i = 0 THEN value ELSE 2.0::DOUBLE / 14 * value END * power(6.0::DOUBLE / 7, -i)) OVER (PARTITION BY metric, series_id ORDER BY i) * power(6.0::DOUBLE / 7, i) AS level FROM placed),
 errors AS (SELECT * FROM (SELECT metric, series_id, value - lag(level) OVER (PARTITION BY metric, series_id ORDER BY i) AS e FROM levels) WHERE e IS NOT NULL)""")
say("t8_change_point", """
SELECT metric, series_id, round(max(CASE WHEN k BETWEEN 3 AND n - 3 THEN abs((st - s) / (n - k) - s / k) / (sqrt(greatest(ss / k - (s / k) ** 2, 0) / k + greatest((sst - ss) / (n - k) - ((st - s) / (n - k)) ** 2, 0) / (n - k)) + 1e-12) ELSE 0 END), 6) AS change_point
FROM targets JOIN sums USING (metric, series_id) GROUP BY metric, series_id""", _TARGET + """,
 recent AS (SELECT metric, series_id, week, value FROM h QUALIFY row_number() OVER (PARTITION BY metric, series_id ORDER BY week DESC) <= 26),
 sums AS (
  SELECT metric, series_id, row_number() OVER w AS k, sum(value) OVER w AS s, sum(value * value) OVER w AS ss, count(*) OVER a AS n, sum(value) OVER a AS st, sum(value * value) OVER a AS sst
  FROM recent WINDOW w AS (PARTITION BY metric, series_id ORDER BY week), a AS (PARTITION BY metric, series_id))""")
_SHARE = """
 shares AS (SELECT h.metric, h.series_id, h.week, h.value / n.value AS share FROM h JOIN h n ON n.series_id = 'national' AND n.metric = h.metric AND n.week = h.week WHERE h.series_id <> 'national' AND n.value > 0),
 yearly AS (SELECT *, avg(share) FILTER (share > 0) OVER (PARTITION BY metric, series_id ORDER BY week RANGE BETWEEN 53 PRECEDING AND 51 PRECEDING) AS year_ago FROM shares)"""
say("j20_share_of_parent", "SELECT metric, series_id, week, round(share, 10) AS share FROM shares", _HISTORY + "," + _SHARE)
say("j21_year_ago_share", "SELECT metric, series_id, week, round(ln(share / year_ago), 8) AS change FROM yearly WHERE year_ago IS NOT NULL AND share > 0", _HISTORY + "," + _SHARE)
say("t24_share_test", """
SELECT metric, series_id, CASE WHEN recent_wins THEN 'trailing' ELSE 'seasonal' END AS share_method, CASE WHEN recent_wins THEN n1 ELSE n2 END AS share_n, round(CASE WHEN recent_wins THEN (now - m1) / s1 ELSE (ln(now / year) - m2) / s2 END, 5) AS share_t,
       round(CASE WHEN recent_wins THEN s1 / abs(m1) ELSE s2 END, 8) AS share_spread, round(CASE WHEN recent_wins THEN m1 ELSE year * exp(m2) END, 8) AS share_level, round((now - CASE WHEN recent_wins THEN m1 ELSE year * exp(m2) END) * parent, 2) AS share_impact
FROM (SELECT *, s1 IS NOT NULL AND (s2 IS NULL OR year IS NULL OR now <= 0 OR s1 / abs(m1) <= s2) AS recent_wins FROM joined) WHERE s1 IS NOT NULL OR (s2 IS NOT NULL AND year IS NOT NULL AND now > 0)""", _TARGET + "," + _SHARE + """,
 one AS (
  SELECT metric, series_id, avg(share) AS m1, CASE WHEN stddev_samp(share) > 1e-12 * greatest(abs(avg(share)), 1e-12) THEN stddev_samp(share) * sqrt(1 + 1.0 / count(*)) END AS s1, count(*) AS n1
  FROM (SELECT * FROM shares QUALIFY row_number() OVER (PARTITION BY metric, series_id ORDER BY week DESC) <= 26) GROUP BY ALL HAVING count(*) >= 8),
 moves AS (SELECT metric, series_id, week, ln(share / year_ago) AS x FROM yearly WHERE share > 0 AND year_ago > 0),
 two AS (
  SELECT metric, series_id, avg(x) AS m2, CASE WHEN stddev_samp(x) > 1e-12 * greatest(abs(avg(x)), 1e-12) THEN stddev_samp(x) * sqrt(1 + 1.0 / count(*)) END AS s2, count(*) AS n2
  FROM (SELECT * FROM moves QUALIFY row_number() OVER (PARTITION BY metric, series_id ORDER BY week DESC) <= 26) GROUP BY ALL HAVING count(*) >= 8),
 before AS (SELECT metric, series_id, avg(share) FILTER (share > 0) AS year FROM shares WHERE week BETWEEN 357 - 53 AND 357 - 51 GROUP BY ALL),
 joined AS (
  SELECT t.metric, t.series_id, t.adjusted / n.adjusted AS now, n.adjusted AS parent, m1, s1, n1, m2, s2, n2, year
  FROM targets t JOIN targets n ON n.series_id = 'national' AND n.metric = t.metric LEFT JOIN one ON one.metric = t.metric AND one.series_id = t.series_id LEFT JOIN two ON two.metric = t.metric AND two.series_id = t.series_id
  LEFT JOIN before ON before.metric = t.metric AND before.series_id = t.series_id WHERE t.series_id <> 'national' AND n.adjusted > 0)""")
say("t33_series_reasons", """
SELECT metric, series_id, 357 AS target,
       CASE WHEN n < 26 THEN CASE WHEN series_id <> 'national' AND first > 331 THEN 'new series' ELSE 'insufficient observed history' END
            WHEN NOT here THEN CASE WHEN series_id = 'national' THEN 'missing target observation' WHEN there THEN 'vanished series' ELSE 'dormant series' END END AS reason,
       CASE WHEN n < 26 THEN NOT (series_id <> 'national' AND first > 331) WHEN NOT here THEN series_id = 'national' ELSE false END AS required,
       CASE WHEN n >= 26 AND here THEN 'model' END AS support, CASE WHEN n >= 26 AND here THEN n END AS history_observed
FROM (SELECT metric, series_id, min(week) AS first, count(*) FILTER (week <= 356) AS n, bool_or(week = 357) AS here, bool_or(week = 356) AS there FROM (SELECT * FROM h UNION ALL SELECT * FROM now) GROUP BY ALL)""", _TARGET)

# --- feeds and scores
ORACLES["s18_daily_sales_to_weekly"] = """
SELECT CAST(floor(date_diff('day', DATE '1995-01-02', CAST(l_shipdate AS DATE)) / 7.0) AS INTEGER) + 1 AS week, 'S' || l_suppkey AS store_id, CAST(n_regionkey AS VARCHAR) AS state_id, p_type AS commodity_id, 'I' || l_partkey AS product_id, CAST(sum(l_quantity) AS DOUBLE) AS units
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE CAST(l_shipdate AS DATE) >= DATE '1995-01-02' GROUP BY ALL HAVING sum(l_quantity) <> 0"""
say("x7_real_absences", " UNION ALL ".join(f"SELECT '{t}' AS entity_type, {t}_id AS entity_id, min(week) AS first_week FROM cur WHERE week <= 357 GROUP BY 2 HAVING bool_or(week = 356) AND NOT bool_or(week = 357)" for t in _TYPES))
say("x8_share_rules", """
SELECT week, planted, count(*) AS tests, count(*) FILTER (adjusted <= 0.05) AS found FROM (
  SELECT *, min(p * m / r) OVER (PARTITION BY week ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS adjusted FROM (
    SELECT *, row_number() OVER (PARTITION BY week ORDER BY p) AS r, count(*) OVER (PARTITION BY week) AS m FROM (
      SELECT week, planted, CASE WHEN b IS NULL THEN a ELSE least(1, 2 * least(a, b)) END AS p FROM (
        SELECT week, store_id LIKE '%7' AS planted, (u * 7919 % 1009) / 1009.0::DOUBLE * 0.05::DOUBLE AS a, CASE WHEN u % 5 > 0 THEN (u * 104729 % 997) / 997.0::DOUBLE END AS b
        FROM (SELECT week, store_id, CAST(sum(units) AS BIGINT) AS u FROM cur GROUP BY ALL))))) GROUP BY ALL""")
_CASES = " cases AS (SELECT store_id, any_value(banner_id) AS family, any_value(CAST(state_id AS DOUBLE)) AS magnitude, CAST(sum(units) AS BIGINT) AS u, round(sum(dollar), 2) AS effect FROM cur GROUP BY 1)"
say("a32_sweep_summary", "SELECT family, magnitude, count(*) AS n, count(*) FILTER (u % 3 = 0) AS detected, quantile_disc(effect, 0.5) AS median_effect FROM cases GROUP BY ALL", _CASES)
say("a33_case_metrics", """
SELECT family, count(*) FILTER (u % 2 = 0) AS actionable, count(*) FILTER (u % 2 = 0 AND u % 3 = 0) AS detected, count(*) FILTER (u % 2 <> 0) AS controls, count(*) FILTER (u % 2 <> 0 AND u % 3 = 0) AS false_alarms,
       quantile_cont(CASE WHEN u % 6 = 0 THEN CAST(u % 13 AS DOUBLE) END, 0.5) AS median_latency FROM cases GROUP BY ALL""", _CASES)
