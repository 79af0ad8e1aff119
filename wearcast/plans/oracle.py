"""DuckDB oracle SQL for the registered queries.

Written independently of the Spark plans with plain window frames (DuckDB
handles 1440-row frames directly), over the same `events` view, with the
same adapter rules and the same floating-point operation order as the
Column functions.  All literals are cast to DOUBLE so no DECIMAL
arithmetic sneaks in.
"""

from __future__ import annotations

from ..functions.formulas import QK
from ..config import (CORE_SENSORS, CURRENT_SENSOR, ELONG_SENSOR, FIXTURE_BELTS, MODEL_FEATURES, SHORT,
                      TEMP_SENSOR, Thresholds, internal_feature_name)

TH = Thresholds()


def D(v) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


def q4(x: str) -> str:
    return f"round(({x}) * {D(QK)}) / {D(QK)}"


def clip(x: str, lo=None, hi=None) -> str:
    out = x
    if lo is not None:
        out = f"greatest({out}, {D(lo)})"
    if hi is not None:
        out = f"least({out}, {D(hi)})"
    return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE {out} END)"


def day(mi: str = "mi") -> str:
    return f"strftime(DATE '1970-01-01' + CAST({mi} // 1440 AS INTEGER), '%Y-%m-%d')"


SENSOR_CASE = (f"CASE event_type WHEN 'view' THEN '{TEMP_SENSOR}' WHEN 'click' THEN '{ELONG_SENSOR}' "
               f"WHEN 'purchase' THEN '{CURRENT_SENSOR}' ELSE event_type END")
CORE_LIST = ", ".join(f"'{s}'" for s in CORE_SENSORS)

READINGS = f"""
r0 AS (
  SELECT 'belt-' || CAST(user_id % 4 AS VARCHAR) AS belt_id, {SENSOR_CASE} AS sensorid,
         CAST(ts AS TIMESTAMP) AS ts,
         CASE WHEN event_type = 'click' THEN {D(250)} + value ELSE value END AS avg_value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_id AS ingest_seq
  FROM events),
readings AS (
  SELECT belt_id, sensorid, ts, avg_value,
         CASE WHEN k >= 10 THEN avg_value - CAST(k AS DOUBLE) / {D(10)} END AS min_value,
         avg_value + CAST(k AS DOUBLE) / {D(10)} AS max_value,
         CAST(k AS DOUBLE) / {D(20)} AS std_deviation, ingest_seq
  FROM r0)"""

CORE = """
core AS (
  SELECT belt_id, trim(sensorid) AS sensorid, ts, avg_value, min_value, max_value, std_deviation, ingest_seq
  FROM {src} WHERE trim(sensorid) IN ({core}) AND ts IS NOT NULL AND avg_value IS NOT NULL)"""

CLEAN = """
clean AS (
  SELECT * FROM core
  QUALIFY row_number() OVER (PARTITION BY belt_id, sensorid, ts ORDER BY ingest_seq DESC) = 1)"""

MEANS = """
means AS (
  SELECT belt_id, sensorid, epoch_us(ts) // 60000000 AS mi, avg(avg_value) AS avg_value,
         avg(min_value) AS min_value, avg(max_value) AS max_value, avg(std_deviation) AS std_deviation
  FROM clean GROUP BY belt_id, sensorid, epoch_us(ts) // 60000000)"""


def _scan_cols(cols) -> str:
    parts = []
    for c in cols:
        parts.append(f"max(CASE WHEN {c} IS NOT NULL THEN mi END) OVER wup AS p_{c}_o, "
                     f"last_value({c} IGNORE NULLS) OVER wup AS p_{c}_v, "
                     f"min(CASE WHEN {c} IS NOT NULL THEN mi END) OVER wdn AS n_{c}_o, "
                     f"first_value({c} IGNORE NULLS) OVER wdn AS n_{c}_v")
    return ",\n    ".join(parts)


def _interp(c: str) -> str:
    return (f"CASE WHEN p_{c}_o IS NULL THEN n_{c}_v WHEN t <= p_{c}_o THEN p_{c}_v "
            f"WHEN n_{c}_o IS NULL THEN p_{c}_v "
            f"ELSE (n_{c}_v - p_{c}_v) / (n_{c}_o - p_{c}_o) * (t - p_{c}_o) + p_{c}_v END")


def grid_cte(name: str, span: str, cols=("avg_value", "min_value", "max_value"), std=True) -> str:
    part = "PARTITION BY belt_id, sensorid"
    rng = "PARTITION BY belt_id" if span == "belt" else part
    std_sql = ", CASE WHEN t = mi THEN coalesce(std_deviation, 0.0) ELSE 0.0 END AS std_deviation" if std else ""
    return f"""
{name}_scan AS (
  SELECT *, min(mi) OVER ({rng}) AS lo, max(mi) OVER ({rng}) AS hi, min(mi) OVER ({part}) AS first_mi,
    lead(mi) OVER ({part} ORDER BY mi) AS nxt,
    {_scan_cols(cols)}
  FROM means
  WINDOW wup AS ({part} ORDER BY mi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         wdn AS ({part} ORDER BY mi ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
{name}_x AS (
  SELECT *, unnest(generate_series(CASE WHEN mi = first_mi THEN lo ELSE mi END, coalesce(nxt - 1, hi))) AS t
  FROM {name}_scan),
{name} AS (
  SELECT belt_id, sensorid, t AS mi, {", ".join(f"{_interp(c)} AS {c}" for c in cols)}{std_sql}
  FROM {name}_x)"""


WIDE = f"""
wide AS (
  SELECT belt_id, mi,
         max(CASE WHEN sensorid = '{TEMP_SENSOR}' THEN avg_value END) AS temp_avg,
         max(CASE WHEN sensorid = '{ELONG_SENSOR}' THEN avg_value END) AS elong_avg,
         max(CASE WHEN sensorid = '{CURRENT_SENSOR}' THEN avg_value END) AS curr_avg
  FROM wgrid GROUP BY belt_id, mi)"""

WINDOWS = {"1h": 60, "6h": 360, "12h": 720, "24h": 1440}


def _flag(cond: str) -> str:
    return f"coalesce(CAST(({cond}) AS INTEGER), 0)"


def features_ctes() -> str:
    th = TH
    wins = ",\n    ".join(
        f"w{lbl} AS (PARTITION BY belt_id ORDER BY mi ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
        for lbl, w in WINDOWS.items())
    roll = []
    for lbl in WINDOWS:
        for s in ("temp", "elong", "curr"):
            roll.append(f"avg({s}_avg) OVER w{lbl} AS {s}_{lbl}_mean")
            roll.append(f"coalesce(stddev_samp({s}_avg) OVER w{lbl}, 0.0) AS {s}_{lbl}_std")
            roll.append(f"min({s}_avg) OVER w{lbl} AS {s}_{lbl}_min")
            roll.append(f"max({s}_avg) OVER w{lbl} AS {s}_{lbl}_max")
        roll.append(f"count(*) OVER w{lbl} AS n_{lbl}")
    for s in ("elong", "temp"):
        for lbl in ("1h", "6h", "24h"):
            roll.append(f"CASE WHEN count(*) OVER w{lbl} >= 10 THEN coalesce(regr_slope({s}_avg, mi) OVER w{lbl}, 0.0)"
                        f" ELSE 0.0 END AS {s}_trend_{lbl}")
    roll += [
        "CAST(sum(active) OVER w1h AS DOUBLE) / count(*) OVER w1h AS utilization_1h",
        "CAST(sum(active) OVER w6h AS DOUBLE) / count(*) OVER w6h AS utilization_6h",
        "CAST(sum(high_load) OVER w6h AS DOUBLE) / count(*) OVER w6h AS high_load_share_6h",
        f"CAST(sum(warn_event) OVER w24h AS DOUBLE) / {D(60)} AS warning_event_count_24h",
        f"CAST(sum(crit_event) OVER w24h AS DOUBLE) / {D(60)} AS critical_event_count_24h",
        "coalesce(elong_avg - lag(elong_avg, 720) OVER wl, 0.0) AS elong_rate_12h",
        "coalesce(elong_delta - lag(elong_delta, 60) OVER wl, 0.0) AS elong_delta_rate",
        "coalesce(elong_avg - lag(elong_avg, 5) OVER wl, 0.0) AS elong_micro_trend",
    ]
    tw, tc = th.warn(TEMP_SENSOR), th.crit(TEMP_SENSOR)
    ew, ec = th.warn(ELONG_SENSOR), th.crit(ELONG_SENSOR)
    cw, cc = th.warn(CURRENT_SENSOR), th.crit(CURRENT_SENSOR)
    belts = ", ".join(f"('{b.belt_id}', TIMESTAMP '{b.installation_date} 00:00:00', "
                      f"TIMESTAMP '{b.replace_date} 00:00:00')" for b in FIXTURE_BELTS)
    tr6 = "elong_trend_6h"
    tnorm = clip(f"{tr6} / {D(0.03)}", 0, 2)
    deg = clip(f"{D(0.55)} * {clip(f'elong_delta / {D(th.elong_span)}', 0, 2)} + {D(0.30)} * {tnorm} + "
               f"{D(0.15)} * {clip(f'elong_volatility_6h / {D(6)}', 0, 2)}", 0, 2)
    us_day, us_hour = "CAST(86400000000 AS DOUBLE)", "CAST(3600000000 AS DOUBLE)"
    lifecycle = f"greatest(CAST(epoch_us(replace_ts) - epoch_us(install_ts) AS DOUBLE) / {us_day}, {D(1)})"
    return f"""
fb AS (
  SELECT belt_id, mi, temp_avg, elong_avg, curr_avg,
    {_flag(f'curr_avg < {D(th.idle_current)}')} AS is_idle, {_flag(f'curr_avg >= {D(th.high_load)}')} AS high_load,
    {_flag(f'temp_avg >= {D(tw)}')} AS temp_warning, {_flag(f'temp_avg >= {D(tc)}')} AS temp_critical,
    {_flag(f'elong_avg >= {D(ew)}')} AS elong_warning, {_flag(f'elong_avg >= {D(ec)}')} AS elong_critical,
    {_flag(f'curr_avg >= {D(cw)}')} AS current_warning, {_flag(f'curr_avg >= {D(cc)}')} AS current_critical,
    elong_avg - {D(th.baseline_elong)} AS elong_delta
  FROM wide),
fb2 AS (
  SELECT *, 1 - is_idle AS active,
    temp_warning + elong_warning + current_warning AS warning_count,
    temp_critical + elong_critical + current_critical AS critical_count
  FROM fb),
fb3 AS (SELECT *, {_flag('warning_count > 0')} AS warn_event, {_flag('critical_count > 0')} AS crit_event FROM fb2),
fw AS (
  SELECT *,
    {(","+chr(10)+"    ").join(roll)}
  FROM fb3
  WINDOW {wins},
    wl AS (PARTITION BY belt_id ORDER BY mi)),
fw2 AS (
  SELECT *,
    CASE WHEN n_12h >= 10 THEN (curr_avg - curr_12h_min) / (curr_12h_max - curr_12h_min + {D(1e-6)}) * {D(100)}
         ELSE 0.0 END AS current_percentile,
    CASE WHEN n_6h >= 10 THEN curr_6h_std ELSE 0.0 END AS current_volatility_6h,
    CASE WHEN n_6h >= 10 THEN elong_6h_std ELSE 0.0 END AS elong_volatility_6h,
    CASE WHEN n_12h >= 2 THEN temp_12h_std ELSE 0.0 END AS temp_variability_12h,
    coalesce(elong_trend_1h - elong_trend_6h, 0.0) AS elong_accel_6h,
    {clip(f'temp_avg - {D(th.baseline_temp)}', 0)} AS temp_above_baseline
  FROM fw),
fs AS (
  SELECT *,
    {deg} AS degradation_index,
    {_flag(f'({tr6} > {D(0.01)}) OR (elong_accel_6h > {D(0.005)})')} AS degradation_rising_flag,
    {clip(f'temp_above_baseline / {D(20)} + temp_variability_12h / {D(8)}', 0, 3)} AS temp_spike_index,
    {clip(f'temp_above_baseline / {D(25)} * {tnorm}', 0, 3)} AS temp_elong_coupling,
    temp_above_baseline * {clip('elong_delta', 0)} AS temp_elong_interaction,
    {_flag(f'(temp_above_baseline >= {D(15)}) AND ({tr6} > {D(0.01)})')} AS temp_elong_risk_flag
  FROM fw2),
fc AS (
  SELECT *,
    {clip(f'{D(0.55)} * critical_count + {D(0.20)} * warning_count + {D(0.35)} * coalesce(degradation_index, 0.0) + {D(0.20)} * degradation_rising_flag', 0, 4)} AS condition_risk_score
  FROM fs),
fc2 AS (
  SELECT *,
    CASE WHEN (critical_count >= 2 AND (degradation_index >= 0.80 OR {tr6} > 0.01 OR temp_above_baseline >= 15.0))
              OR condition_risk_score >= 2.20 THEN 2
         WHEN warning_count >= 1 OR degradation_index >= 0.45 OR degradation_rising_flag >= 1 OR {tr6} > 0.005
              OR condition_risk_score >= 0.80 THEN 1 ELSE 0 END AS condition_state_code,
    {clip(f'coalesce(degradation_index, 0.0) + {D(0.5)} * critical_count + {D(0.2)} * warning_count', 0, 5)} AS failure_proximity,
    {_flag('critical_count >= 2 AND coalesce(degradation_index, 0.0) >= 0.8')} AS failure_trigger
  FROM fc),
belts(belt_id, install_ts, replace_ts) AS (VALUES {belts}),
ft AS (
  SELECT f.*, CAST(condition_state_code = 2 AS INTEGER) AS is_failure,
    CASE condition_state_code WHEN 2 THEN 'CRITICAL' WHEN 1 THEN 'WARNING' ELSE 'NORMAL' END AS condition_state,
    coalesce(least({clip(f"CAST(epoch_us(b.replace_ts) - mi * 60000000 AS DOUBLE) / {us_day}", 0)}, {lifecycle}),
             {lifecycle}) AS calendar_rul_days,
    {clip(f"CAST(mi * 60000000 - epoch_us(b.install_ts) AS DOUBLE) / {us_hour}", 0)} AS runtime_age_hours
  FROM fc2 f LEFT JOIN belts b USING (belt_id)),
feats AS (
  SELECT *,
    {clip(f"{D(100)} - {clip('coalesce(degradation_index, 0.0)', 0, 2)} * {D(80)} - coalesce(warning_event_count_24h, 0.0) * {D(2)} - coalesce(critical_event_count_24h, 0.0) * {D(5)}", 0, 100)} AS target_health,
    {clip(f"calendar_rul_days * ({D(1)} - {clip('coalesce(degradation_index, 0.0)', 0, 1)}) - coalesce(critical_event_count_24h, 0.0) * {D(50)}", 0, th.baseline_rul_days)} AS target_rul_days
  FROM ft),
featx AS (
  SELECT *, {_flag('target_health < 30.0 OR coalesce(critical_event_count_24h, 0.0) > 0.0')} AS is_critical FROM feats)"""


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + body


def base_chain(src_readings: str = "readings") -> list[str]:
    return [READINGS, CORE.format(src=src_readings, core=CORE_LIST), CLEAN, MEANS]


def feature_chain() -> list[str]:
    return base_chain() + [grid_cte("wgrid", "belt", ("avg_value",), std=False), WIDE, features_ctes()]


def daily_sql(cols: list[str], extra: str = "") -> str:
    sel = ", ".join(f"{q4(f'avg({c})')} AS {c}" for c in cols)
    return with_ctes(*feature_chain(), body=f"""
SELECT belt_id, {day()} AS day, count(*) AS n, {sel}{extra}
FROM featx GROUP BY belt_id, {day()}""")


SAFE = f"""
safe AS (
  SELECT *,
    {clip('coalesce(calendar_rul_days, ' + D(TH.baseline_rul_days) + ')', 0, TH.baseline_rul_days)} AS ml_rul_days,
    {clip(f"coalesce(calendar_rul_days, {D(TH.baseline_rul_days)}) * ({D(1)} - {clip(f'{D(0.15)} * coalesce(degradation_index, 0.0) + {D(0.05)} * coalesce(warning_count, 0)', 0, 0.5)})", 0, TH.baseline_rul_days)} AS frul
  FROM featx),
safe2 AS (
  SELECT *, {clip(f'{D(100)} * (ml_rul_days / {D(TH.baseline_rul_days)})', 0, 100)} AS ml_health,
    coalesce(frul, {D(TH.baseline_rul_days)}) AS final_rul_days,
    coalesce({D(100)} * (frul / {D(TH.baseline_rul_days)}), {D(100)}) AS final_health,
    'MEDIUM' AS confidence_level, 'safe_mode_calendar' AS prediction_status
  FROM safe)"""


def slice_cte(n: int = 100, src: str = "featx") -> str:
    return f"""
sl AS (
  SELECT * FROM (SELECT *, max(mi) OVER (PARTITION BY belt_id) AS _mx FROM {src}) WHERE mi > _mx - {n})"""


PSEUDO = f"""
ps AS (
  SELECT *, {clip('target_health', 0, 100)} AS ml_health_raw,
    {clip('target_rul_days', 0, TH.baseline_rul_days)} AS ml_rul_raw
  FROM sl),
ps2 AS (
  SELECT *,
    least(avg(ml_health_raw) OVER w15, ml_health_raw) AS ml_health,
    least(avg(ml_rul_raw) OVER w15, ml_rul_raw) AS ml_rul_days
  FROM ps WINDOW w15 AS (PARTITION BY belt_id ORDER BY mi ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)),
ps3 AS (
  SELECT *, ml_rul_days * {clip(f'{D(1)} - ({D(0.08)} * coalesce(degradation_index, 0.0) + {D(0.03)} * coalesce(warning_count, 0) + {D(0.08)} * coalesce(critical_count, 0))', 0.65, 1)} AS _fr
  FROM ps2),
ps4 AS (
  SELECT *, {clip(f'{D(0.7)} * ml_health + {D(0.3)} * ({D(100)} * _fr / {D(TH.baseline_rul_days)})', 0, 100)} AS final_health,
    {clip('_fr', 0, TH.baseline_rul_days)} AS final_rul_days,
    CASE WHEN ml_rul_days < 50 OR ml_health < 40 THEN 'LOW' ELSE 'HIGH' END AS confidence_level,
    {clip(f'{D(0.5)} * coalesce(critical_count, 0) + {D(0.3)} * coalesce(warning_count, 0) + {D(0.4)} * coalesce(degradation_index, 0.0)', 0, 5)} AS failure_risk_score,
    coalesce(current_volatility_6h, 0.0) + coalesce(temp_variability_12h, 0.0) AS _anom,
    CAST(coalesce(degradation_index, 0.0) > 0.6 AND coalesce(elong_trend_6h, 0.0) > 0.01 AS INTEGER) AS early_failure_flag,
    'ok' AS prediction_status
  FROM ps3),
scored AS (
  SELECT *, _anom / (max(_anom) OVER (PARTITION BY belt_id) + {D(1e-6)}) AS anomaly_score FROM ps4)"""


def gate_cte(src: str = "sl") -> str:
    feats = [internal_feature_name(f) for f in MODEL_FEATURES]
    nulls = " + ".join(f"CAST({f} IS NULL AS INTEGER)" for f in feats)
    return f"""
gate AS (
  SELECT belt_id, count(*) AS row_count, {len(feats)} AS required_feature_count,
    CAST(sum({nulls}) AS DOUBLE) / (count(*) * {len(feats)}) AS missing_ratio
  FROM {src} GROUP BY belt_id),
gate2 AS (SELECT *, row_count >= {TH.quality_min_rows} AND missing_ratio <= {D(TH.quality_max_missing)} AS quality_ok FROM gate)"""


def report_sql(scored: str, select: str) -> str:
    return f"""
last AS (
  SELECT s.*, g.quality_ok FROM {scored} s JOIN gate2 g USING (belt_id)
  QUALIFY row_number() OVER (PARTITION BY belt_id ORDER BY mi DESC) = 1),
risk AS (
  SELECT *,
    CASE WHEN NOT quality_ok OR confidence_level = 'LOW' THEN 'LOW_CONFIDENCE'
         WHEN (coalesce(critical_count, 0) >= 2 AND (coalesce(degradation_index, 0.0) >= 0.80
               OR coalesce(degradation_rising_flag, 0) > 0 OR coalesce(elong_trend_6h, 0.0) > 0.01
               OR coalesce(condition_state_code, 0) = 2))
              OR (coalesce(final_rul_days, 2190.0) <= 90.0 AND (coalesce(degradation_index, 0.0) >= 0.80
                  OR coalesce(critical_count, 0) >= 2)) THEN 'CRITICAL'
         WHEN coalesce(final_rul_days, 2190.0) <= 180.0 OR coalesce(final_health, 100.0) <= 65.0
              OR coalesce(warning_count, 0) >= 1 OR coalesce(condition_state_code, 0) = 1
              OR coalesce(degradation_index, 0.0) >= 0.45 THEN 'WARNING'
         ELSE 'NORMAL' END AS risk_level,
    array_to_string(list_filter([
        CASE WHEN NOT quality_ok THEN 'data_quality_gate_failed' END,
        CASE WHEN prediction_status NOT IN ('ok', 'ok_ml_only', 'safe_mode_calendar')
             THEN 'prediction_status=' || prediction_status END,
        CASE WHEN coalesce(critical_count, 0) > 0 THEN 'critical_count=' || CAST(critical_count AS VARCHAR) END,
        CASE WHEN coalesce(warning_count, 0) > 0 THEN 'warning_count=' || CAST(warning_count AS VARCHAR) END,
        CASE WHEN coalesce(condition_state_code, 0) = 2 THEN 'condition_state=CRITICAL'
             WHEN coalesce(condition_state_code, 0) = 1 THEN 'condition_state=WARNING' END,
        CASE WHEN coalesce(degradation_rising_flag, 0) > 0 THEN 'degradation_rising' END,
        CASE WHEN coalesce(degradation_index, 0.0) >= 0.8 THEN 'degradation_index=' || printf('%.3f', degradation_index) END
      ], lambda x: x IS NOT NULL)[1:6], ';') AS risk_reasons
  FROM last)
SELECT {select} FROM risk"""


def alert_case(h: str, r: str) -> tuple[str, str, str]:
    hb, rb = TH.health_bands, TH.rul_bands
    risk = (f"CASE WHEN {h} <= {D(hb['critical'])} OR {r} <= {D(rb['critical_days'])} THEN 'CRITICAL' "
            f"WHEN {h} <= {D(hb['warning'])} OR {r} <= {D(rb['warning_days'])} THEN 'WARNING' ELSE 'NORMAL' END")
    hband = (f"CASE WHEN {h} >= {D(hb['excellent'])} THEN 'EXCELLENT' WHEN {h} >= {D(hb['good'])} THEN 'GOOD' "
             f"WHEN {h} >= {D(hb['maintenance_due'])} THEN 'MAINTENANCE_DUE' "
             f"WHEN {h} >= {D(hb['warning'])} THEN 'WARNING' ELSE 'CRITICAL' END")
    rband = (f"CASE WHEN {r} <= {D(rb['critical_days'])} THEN 'CRITICAL' WHEN {r} <= {D(rb['warning_days'])} "
             f"THEN 'WARNING' WHEN {r} <= {D(rb['maintenance_due_days'])} THEN 'MAINTENANCE_DUE' ELSE 'NORMAL' END")
    return risk, hband, rband


# --------------------------------------------------------------------------
# query -> SQL
# --------------------------------------------------------------------------
GROUPS = None  # filled lazily from queries.GROUPS to keep one column list


def _daily_from(src: str, cols: list[str], ctes: list[str], extra: str = "") -> str:
    sel = ", ".join(f"{q4(f'avg({c})')} AS {c}" for c in cols)
    return with_ctes(*ctes, body=f"""
SELECT belt_id, {day()} AS day, count(*) AS n, {sel}{extra}
FROM {src} GROUP BY belt_id, {day()}""")


def _metrics_sql(prefix: str, y: str, p: str, nf: int) -> list[str]:
    sse = f"sum(({y} - {p}) * ({y} - {p}))"
    sst = f"(var_pop({y}) * count(*))"
    r2 = f"(CASE WHEN {sst} > 0 THEN {D(1)} - {sse} / {sst} WHEN {sse} = 0 THEN {D(1)} ELSE {D(0)} END)"
    adj = (f"(CASE WHEN count(*) <= {nf + 1} THEN {r2} ELSE least(greatest({D(1)} - ({D(1)} - {r2}) * "
           f"(count(*) - 1) / (count(*) - {nf} - 1), {D(-1)}), {D(1)}) END)")
    return [f"avg(abs({y} - {p}))", f"sqrt({sse} / count(*))", r2, adj]


def oracle_queries() -> dict[str, str]:
    from .queries import GROUPS as G

    T, E, Cs = TEMP_SENSOR, ELONG_SENSOR, CURRENT_SENSOR
    fc = feature_chain()
    out: dict[str, str] = {}

    out["clean_coerce"] = with_ctes(READINGS, CORE.format(src="readings", core=CORE_LIST), body="""
SELECT belt_id, sensorid, epoch_us(ts) AS ts_us, avg_value, min_value, max_value, std_deviation FROM core""")

    dup = """
dup AS (
  SELECT * FROM readings
  UNION ALL
  SELECT belt_id, sensorid, ts, avg_value + 1, min_value, max_value, std_deviation,
         CASE WHEN avg_value >= 50 THEN ingest_seq + 1000000000000 ELSE ingest_seq - 1000000000000 END
  FROM readings)"""
    out["dedup_last"] = with_ctes(READINGS, dup, CORE.format(src="dup", core=CORE_LIST), CLEAN, body="""
SELECT belt_id, sensorid, epoch_us(ts) AS ts_us, avg_value FROM clean""")

    out["range_filter"] = with_ctes(READINGS, CORE.format(src="readings", core=CORE_LIST), body=f"""
SELECT belt_id, sensorid, count(*) AS n_kept, {q4('sum(avg_value)')} AS sum_avg,
       min(avg_value) AS min_avg, max(avg_value) AS max_avg
FROM core
WHERE (sensorid = '{T}' AND avg_value BETWEEN {D(0)} AND {D(100)})
   OR (sensorid = '{E}' AND avg_value >= {D(260)})
   OR (sensorid = '{Cs}' AND avg_value <= {D(150)})
GROUP BY belt_id, sensorid""")

    out["minute_resample"] = with_ctes(*base_chain(), body="""
SELECT belt_id, sensorid, mi, avg_value, min_value, max_value, std_deviation FROM means""")

    out["minute_grid_interpolated"] = with_ctes(*base_chain(), grid_cte("grid", "sensor"), body=f"""
SELECT belt_id, sensorid, {day()} AS day, count(*) AS n, min(mi) AS first_mi, max(mi) AS last_mi,
       {q4('avg(avg_value)')} AS avg_value, {q4('avg(min_value)')} AS min_value,
       {q4('avg(max_value)')} AS max_value, {q4('avg(std_deviation)')} AS std_deviation,
       sum(CAST(min_value IS NULL AS INTEGER)) AS n_null_min
FROM grid GROUP BY belt_id, sensorid, {day()}""")

    out["sensor_coverage"] = with_ctes(*base_chain()[:3], body=f"""
SELECT belt_id, count(DISTINCT sensorid) AS n_sensors_present,
       array_to_string(list_sort(list_filter([{CORE_LIST}], lambda x: NOT list_contains(list(DISTINCT sensorid), x))), ',')
         AS missing_sensors,
       count(DISTINCT sensorid) = 3 AS coverage_ok
FROM clean GROUP BY belt_id""")

    for name, cols in G.items():
        extra = ""
        if name == "condition_state":
            extra = "".join(f", sum(CAST(condition_state = '{s}' AS INTEGER)) AS n_{s.lower()}"
                            for s in ("CRITICAL", "WARNING", "NORMAL"))
        out[name] = _daily_from("featx", cols, fc, extra)

    out["safe_mode_score"] = _daily_from("safe2", ["ml_rul_days", "ml_health", "final_rul_days", "final_health"],
                                         fc + [SAFE])

    pseudo = fc + [slice_cte(100), PSEUDO]
    out["prediction_smoothing"] = with_ctes(*pseudo, body=f"""
SELECT belt_id, count(*) AS n, {q4('avg(ml_health)')} AS ml_health, {q4('avg(ml_rul_days)')} AS ml_rul_days,
       {q4('min(ml_health)')} AS min_ml_health, {q4('min(ml_rul_days)')} AS min_ml_rul_days
FROM scored GROUP BY belt_id""")
    out["hybrid_fusion"] = with_ctes(*pseudo, body=f"""
SELECT belt_id, {q4('avg(final_health)')} AS final_health, {q4('avg(final_rul_days)')} AS final_rul_days,
       {q4('avg(failure_risk_score)')} AS failure_risk_score, {q4('avg(anomaly_score)')} AS anomaly_score,
       {q4('max(anomaly_score)')} AS max_anomaly, sum(early_failure_flag) AS early_flags,
       sum(CAST(confidence_level = 'LOW' AS INTEGER)) AS n_low,
       sum(CAST(confidence_level = 'HIGH' AS INTEGER)) AS n_high
FROM scored GROUP BY belt_id""")

    formulas = PSEUDO.replace("FROM sl)", "FROM featx)").replace("target_health", "(100 - 45 * degradation_index)").replace("target_rul_days", "(2000 - 330 * failure_proximity)")
    out["batch_model_scores"] = with_ctes(*fc, formulas, body=f"""
SELECT belt_id, {day()} AS day, prediction_status, count(*) AS n, {q4('avg(final_health)')} AS final_health,
  {q4('avg(final_rul_days)')} AS final_rul_days, {q4('min(final_health)')} AS min_health, {q4('max(final_rul_days)')} AS max_rul,
  {q4('max(anomaly_score)')} AS max_anomaly, CAST(sum(CAST(confidence_level = 'LOW' AS INTEGER)) AS BIGINT) AS n_low,
  CAST(sum(early_failure_flag) AS BIGINT) AS n_early
FROM scored GROUP BY ALL""")
    out["quality_gate"] = with_ctes(*fc, slice_cte(100), gate_cte("sl"), body=f"""
SELECT belt_id, row_count, required_feature_count, {q4('missing_ratio')} AS missing_ratio, quality_ok FROM gate2""")

    safe_slice = fc + [slice_cte(100), SAFE.replace("FROM featx", "FROM sl"), gate_cte("sl")]
    out["operational_risk"] = "WITH " + ",".join(safe_slice) + "," + report_sql(
        "safe2", "belt_id, mi, risk_level, quality_ok, confidence_level, prediction_status, risk_reasons")
    out["risk_reasons"] = "WITH " + ",".join(pseudo + [gate_cte("sl")]) + "," + report_sql(
        "scored", f"belt_id, mi, risk_level, confidence_level, {q4('final_health')} AS final_health, "
                  f"{q4('final_rul_days')} AS final_rul_days, risk_reasons")
    ts_txt = "strftime(make_timestamp(mi * 60000000), '%Y-%m-%d %H:%M:%S') || '+00:00'"
    out["summary"] = "WITH " + ",".join(safe_slice) + "," + report_sql(
        "safe2", f"belt_id, {ts_txt} AS timestamp_utc, {q4('final_health')} AS health_score, "
                 f"{q4('final_rul_days')} AS rul_days, prediction_status AS status, confidence_level AS confidence, "
                 f"'hybrid' AS prediction_mode")

    risk, hband, rband = alert_case("final_health", "final_rul_days")
    out["alert_bands"] = with_ctes(*fc, SAFE, body=f"""
SELECT belt_id, {risk} AS risk, {hband} AS health_band, {rband} AS rul_band, count(*) AS n,
       sum(CAST(({risk}) IN ('WARNING', 'CRITICAL') AS INTEGER)) AS n_alert,
       {q4('avg(final_health)')} AS final_health, {q4('avg(final_rul_days)')} AS final_rul_days
FROM safe2 GROUP BY ALL""")

    out["latest_per_belt"] = with_ctes(*fc, body=f"""
SELECT belt_id, mi, {", ".join(f"{q4(c)} AS {c}" for c in ("temp_avg", "elong_avg", "curr_avg", "degradation_index", "calendar_rul_days", "target_health"))}, condition_state
FROM featx QUALIFY row_number() OVER (PARTITION BY belt_id ORDER BY mi DESC) = 1""")

    grid = grid_cte("grid", "sensor")
    out["quality_report"] = with_ctes(*fc, grid, body=f"""
, cov AS (
  SELECT belt_id, count(*) AS rows_after_preprocessing, count(DISTINCT mi) AS minutes,
    count(DISTINCT CASE WHEN sensorid = '{T}' THEN mi END) AS m0,
    count(DISTINCT CASE WHEN sensorid = '{E}' THEN mi END) AS m1,
    count(DISTINCT CASE WHEN sensorid = '{Cs}' THEN mi END) AS m2
  FROM grid GROUP BY belt_id),
fp AS (
  SELECT *, mi - min(mi) OVER (PARTITION BY belt_id) AS pos, count(*) OVER (PARTITION BY belt_id) AS nn FROM featx),
fpa AS (
  SELECT belt_id, sum(warning_count) AS warning_events, sum(critical_count) AS critical_events,
    avg(temp_warning) * {D(100)} AS temp_warning_share, avg(elong_warning) * {D(100)} AS elong_warning_share,
    avg(current_warning) * {D(100)} AS current_warning_share,
    avg(CASE WHEN pos < greatest(nn // 10, 1) THEN degradation_index END) AS degradation_start_mean,
    avg(CASE WHEN pos >= nn - greatest(nn // 10, 1) THEN degradation_index END) AS degradation_end_mean,
    avg(degradation_rising_flag) * {D(100)} AS rising_share
  FROM fp GROUP BY belt_id)
SELECT c.belt_id, rows_after_preprocessing,
  {q4(f'{D(100)} * rows_after_preprocessing / (greatest(minutes, 1) * 3)')} AS coverage_pct,
  {q4(f'm0 / greatest(minutes, 1) * {D(100)}')} AS uptime_temp,
  {q4(f'm1 / greatest(minutes, 1) * {D(100)}')} AS uptime_elong,
  {q4(f'm2 / greatest(minutes, 1) * {D(100)}')} AS uptime_curr,
  warning_events, critical_events, {q4('temp_warning_share')} AS temp_warning_share,
  {q4('elong_warning_share')} AS elong_warning_share, {q4('current_warning_share')} AS current_warning_share,
  {q4('degradation_start_mean')} AS degradation_start_mean, {q4('degradation_end_mean')} AS degradation_end_mean,
  {q4('rising_share')} AS rising_share, {q4('degradation_end_mean - degradation_start_mean')} AS degradation_delta
FROM cov c JOIN fpa USING (belt_id)""".replace("SELECT c.belt_id", "SELECT c.belt_id", 1)).replace(
        ",\n, cov AS", ",\ncov AS").replace(")\n\n, cov AS", "),\ncov AS")

    hm = _metrics_sql("health", "target_health", "final_health", 1)
    rm = _metrics_sql("rul", "target_rul_days", "final_rul_days", 1)
    names = ["mae", "rmse", "r2", "adj_r2"]
    sel = ", ".join([f"{q4(e)} AS health_{n}" for e, n in zip(hm, names)] +
                    [f"{q4(e)} AS rul_{n}" for e, n in zip(rm, names)])
    out["regression_metrics"] = with_ctes(*fc, SAFE, body=f"""
SELECT belt_id, count(*) AS n, {sel} FROM safe2 GROUP BY belt_id""")
    hm0 = _metrics_sql("health", "target_health", "final_health", 0)
    rm0 = _metrics_sql("rul", "target_rul_days", "final_rul_days", 0)
    out["segment_metrics"] = with_ctes(*fc, SAFE, body=f"""
SELECT belt_id, condition_state_code, count(*) AS n,
  CASE WHEN count(*) >= 2 THEN {q4(hm0[0])} END AS health_mae, CASE WHEN count(*) >= 2 THEN {q4(hm0[2])} END AS health_r2,
  CASE WHEN count(*) >= 2 THEN {q4(rm0[0])} END AS rul_mae, CASE WHEN count(*) >= 2 THEN {q4(rm0[2])} END AS rul_r2
FROM safe2 GROUP BY belt_id, condition_state_code""")

    cut = f"least(greatest(CAST(floor(count(*) * {D(0.8)}) AS BIGINT), 1), count(*) - 1)"
    out["chrono_split"] = with_ctes(*fc, body=f"""
SELECT belt_id, count(*) AS n_total, {cut} AS n_train, count(*) - {cut} AS n_test,
       min(mi) + {cut} AS split_mi, count(*) >= 20 AS enough_rows
FROM featx GROUP BY belt_id""")

    label = ("CAST(coalesce(is_critical, 0) = 1 OR coalesce(condition_state_code, 0) = 2 "
             "OR coalesce(critical_event_count_24h, 0.0) > 0.0 AS INTEGER)")
    train = f"""
lab AS (SELECT *, {label} AS is_critical_label FROM featx),
pos AS (SELECT *, mi - min(mi) OVER (PARTITION BY belt_id) AS _pos, count(*) OVER (PARTITION BY belt_id) AS _n FROM lab),
train AS (
  SELECT * FROM pos
  WHERE _pos < least(greatest(CAST(floor(_n * {D(0.8)}) AS BIGINT), 1), _n - 1))"""
    out["cv_folds"] = with_ctes(*fc, train, body="""
, span AS (SELECT belt_id, min(mi) AS lo, count(*) AS n, count(*) // 4 AS fold_size FROM train GROUP BY belt_id)
SELECT belt_id, fold, fold_size, n - (3 - fold + 1) * fold_size AS n_fold_train, fold_size AS n_fold_val,
       lo + n - (3 - fold + 1) * fold_size AS val_start_mi, lo + n - (3 - fold + 1) * fold_size + fold_size AS val_end_mi,
       n >= 30 AS cv_enabled
FROM span, (SELECT unnest([1, 2, 3]) AS fold)""").replace("\n\n, span AS", ",\nspan AS").replace(")\n, span AS", "),\nspan AS")
    out["features_roundtrip"] = out["degradation"]
    out["cv_fold_rows"] = with_ctes(
        *fc, train, "twice AS (SELECT belt_id, mi FROM train UNION ALL SELECT belt_id, mi FROM train WHERE is_critical_label = 1)",
        """numbered AS (SELECT belt_id, mi, row_number() OVER (PARTITION BY belt_id ORDER BY mi) - 1 AS pos,
  count(*) OVER (PARTITION BY belt_id) AS n FROM twice)""",
        """parted AS (SELECT belt_id, mi, fold, CASE WHEN pos < n - (3 - fold + 1) * (n // 4) THEN 'train'
  WHEN pos < n - (3 - fold) * (n // 4) THEN 'validation' END AS part
  FROM numbered, (SELECT unnest([1, 2, 3]) AS fold) WHERE n >= 30)""",
        body="""SELECT belt_id, fold, part, count(*) AS n_rows, CAST(sum(mi) AS BIGINT) AS sum_mi
FROM parted WHERE part IS NOT NULL GROUP BY belt_id, fold, part""")
    weight = (f"CASE WHEN is_critical_label = 1 THEN {D(15)} ELSE {D(1)} END * "
              f"({D(1)} + {clip('coalesce(degradation_index, 0.0)', 0, 2)})")
    out["sample_weights"] = _daily_from("w", ["is_critical_label", "weight"],
                                        fc + [f"lab AS (SELECT *, {label} AS is_critical_label FROM featx)",
                                              f"w AS (SELECT *, {weight} AS weight FROM lab)"])
    out["upsample_counts"] = with_ctes(*fc, train, body="""
, g AS (SELECT belt_id, sum(1 - is_critical_label) AS n_normal, sum(is_critical_label) AS n_critical FROM train GROUP BY belt_id)
SELECT belt_id, n_normal, n_critical,
  CASE WHEN n_normal > 0 AND n_critical > 0 THEN greatest(CAST(floor(n_normal / 2) AS BIGINT), n_critical) ELSE n_critical END
    AS n_critical_upsampled,
  n_normal + CASE WHEN n_normal > 0 AND n_critical > 0 THEN greatest(CAST(floor(n_normal / 2) AS BIGINT), n_critical)
    ELSE n_critical END AS n_train_balanced
FROM g""").replace("\n\n, g AS", ",\ng AS").replace(")\n, g AS", "),\ng AS")
    risk_f, hband_f, rband_f = alert_case("final_health", "final_rul_days")
    out["flagship_report"] = "WITH " + ",".join(safe_slice) + "," + report_sql(
        "safe2", f"belt_id, {ts_txt} AS timestamp_utc, {q4('final_health')} AS health_score, "
                 f"{q4('final_rul_days')} AS rul_days, confidence_level, prediction_status, risk_level, "
                 f"{risk_f} AS risk, {hband_f} AS health_band, {rband_f} AS rul_band, risk_reasons")
    out.update(stream_oracles())
    return out


# --------------------------------------------------------------------------
# streaming semantics (batch form)
# --------------------------------------------------------------------------
STREAM_FIELDS = (["v", "ord"] + [f"w{lbl}_{s}" for lbl in WINDOWS for s in ("mean", "std", "min", "max", "trend")]
                 + ["util_1h", "util_6h", "high_share_6h", "lag719", "lag59", "lag4"])
STREAM_COLS = ["temp_avg", "elong_avg", "curr_avg", "temp_1h_std", "elong_24h_mean", "curr_12h_max",
               "utilization_1h", "current_percentile", "elong_rate_12h", "elong_delta_rate", "elong_micro_trend",
               "elong_trend_6h", "temp_trend_24h", "elong_volatility_6h", "degradation_index", "failure_proximity",
               "warning_count", "critical_count"]


def stream_ctes() -> list[str]:
    th = TH
    wins = ",\n    ".join(
        f"w{lbl} AS (PARTITION BY belt_id, sensorid ORDER BY ingest_seq ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
        for lbl, w in WINDOWS.items())
    stats = []
    for lbl in WINDOWS:
        stats += [f"avg(v) OVER w{lbl} AS w{lbl}_mean",
                  f"CASE WHEN count(*) OVER w{lbl} > 1 THEN stddev_pop(v) OVER w{lbl} ELSE 0.0 END AS w{lbl}_std",
                  f"min(v) OVER w{lbl} AS w{lbl}_min", f"max(v) OVER w{lbl} AS w{lbl}_max",
                  f"CASE WHEN count(*) OVER w{lbl} >= 2 THEN coalesce(regr_slope(v, ord) OVER w{lbl}, 0.0) ELSE 0.0 END"
                  f" AS w{lbl}_trend"]
    stats += [f"avg(CAST(v >= {D(th.idle_current)} AS INTEGER)) OVER w1h AS util_1h",
              f"avg(CAST(v >= {D(th.idle_current)} AS INTEGER)) OVER w6h AS util_6h",
              f"avg(CAST(v >= {D(th.high_load)} AS INTEGER)) OVER w6h AS high_share_6h",
              "lag(v, 719) OVER wo AS lag719", "lag(v, 59) OVER wo AS lag59", "lag(v, 4) OVER wo AS lag4"]
    pack = ", ".join(f"'{f}': {f}" for f in STREAM_FIELDS)
    carry = ",\n    ".join(
        f"last_value(CASE WHEN e.sensorid = '{s}' THEN sst END IGNORE NULLS) OVER wa AS {SHORT[s]}"
        for s in CORE_SENSORS)
    fields = []
    for sh in ("temp", "elong", "curr"):
        fields.append(f"{sh}.v AS {sh}_avg")
        fields.append(f"{sh}.ord + 1 AS {sh}_cnt")
        for lbl in WINDOWS:
            for st in ("mean", "std", "min", "max"):
                fields.append(f"{sh}.w{lbl}_{st} AS {sh}_{lbl}_{st}")
    tw, tc = th.warn(TEMP_SENSOR), th.crit(TEMP_SENSOR)
    ew, ec = th.warn(ELONG_SENSOR), th.crit(ELONG_SENSOR)
    cw, cc = th.warn(CURRENT_SENSOR), th.crit(CURRENT_SENSOR)
    tnorm = clip(f"elong_trend_6h / {D(0.03)}", 0, 2)
    deg = clip(f"{D(0.55)} * {clip(f'elong_delta / {D(30)}', 0, 2)} + {D(0.30)} * {tnorm} + "
               f"{D(0.15)} * {clip(f'elong_volatility_6h / {D(6)}', 0, 2)}", 0, 2)
    return [READINGS, f"""
ev AS (SELECT belt_id, sensorid, ts, avg_value AS v, ingest_seq FROM readings),
cr0 AS (SELECT *, row_number() OVER (PARTITION BY belt_id, sensorid ORDER BY ingest_seq) - 1 AS ord
        FROM ev WHERE sensorid IN ({CORE_LIST})),
cr AS (
  SELECT belt_id, sensorid, ingest_seq, v, ord,
    {(","+chr(10)+"    ").join(stats)}
  FROM cr0
  WINDOW {wins},
    wo AS (PARTITION BY belt_id, sensorid ORDER BY ingest_seq)),
crs AS (SELECT belt_id, sensorid, ingest_seq, {{{pack}}} AS sst FROM cr),
al AS (
  SELECT e.belt_id, e.sensorid, e.ingest_seq, e.ts,
    {carry}
  FROM ev e LEFT JOIN crs c ON e.belt_id = c.belt_id AND e.sensorid = c.sensorid AND e.ingest_seq = c.ingest_seq
  WINDOW wa AS (PARTITION BY e.belt_id ORDER BY e.ingest_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sf0 AS (
  SELECT belt_id, sensorid, ingest_seq, ts, {", ".join(fields)},
    curr.util_1h AS utilization_1h, curr.util_6h AS utilization_6h, curr.high_share_6h AS high_load_share_6h,
    elong.lag719 AS e719, elong.lag59 AS e59, elong.lag4 AS e4,
    elong.w1h_trend AS elong_trend_1h, elong.w6h_trend AS elong_trend_6h, elong.w24h_trend AS elong_trend_24h,
    temp.w1h_trend AS temp_trend_1h, temp.w6h_trend AS temp_trend_6h, temp.w24h_trend AS temp_trend_24h
  FROM al),
sf1 AS (
  SELECT *,
    (curr_avg - curr_12h_min) / (curr_12h_max - curr_12h_min + {D(1e-6)}) * {D(100)} AS current_percentile,
    coalesce(elong_avg - e719, 0.0) AS elong_rate_12h, elong_avg - {D(th.baseline_elong)} AS elong_delta,
    coalesce(elong_avg - e59, 0.0) AS elong_delta_rate, coalesce(elong_avg - e4, 0.0) AS elong_micro_trend,
    elong_6h_std AS elong_volatility_6h, curr_6h_std AS current_volatility_6h, temp_12h_std AS temp_variability_12h,
    coalesce(elong_trend_1h - elong_trend_6h, 0.0) AS elong_accel_6h,
    {clip(f'temp_avg - {D(th.baseline_temp)}', 0)} AS temp_above_baseline,
    {_flag(f'temp_avg >= {D(tw)}')} + {_flag(f'elong_avg >= {D(ew)}')} + {_flag(f'curr_avg >= {D(cw)}')} AS warning_count,
    {_flag(f'temp_avg >= {D(tc)}')} + {_flag(f'elong_avg >= {D(ec)}')} + {_flag(f'curr_avg >= {D(cc)}')} AS critical_count
  FROM sf0
  WHERE temp_cnt >= 30 AND elong_cnt >= 30 AND curr_cnt >= 30),
sf2 AS (SELECT *, {deg} AS degradation_index FROM sf1),
sfx AS (
  SELECT *,
    {clip(f'coalesce(degradation_index, 0.0) + {D(0.5)} * critical_count + {D(0.2)} * warning_count', 0, 5)} AS failure_proximity,
    {clip(f"{D(th.baseline_rul_days)} * ({D(1)} - {clip(f'{D(0.15)} * coalesce(degradation_index, 0.0) + {D(0.05)} * warning_count', 0, 0.5)})", 0, th.baseline_rul_days)} AS s_rul
  FROM sf2),
sfa AS (
  SELECT *, s_rul AS ml_rul_days, {D(100)} * (s_rul / {D(th.baseline_rul_days)}) AS ml_health,
    {clip(f'coalesce(degradation_index, 0.0) * {D(2)}', 0, 5)} AS failure_risk_score
  FROM sfx)"""]


def stream_oracles() -> dict[str, str]:
    out = {}
    k = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
    out["normalize_events"] = f"""
WITH r AS (SELECT *, {k} AS k FROM events),
r2 AS (SELECT *, CASE WHEN k >= 50 THEN CAST(k AS DOUBLE) / {D(20)} ELSE {D(0)} END AS sd FROM r)
SELECT CASE WHEN k >= 6 THEN 'belt-' || CAST(user_id % 4 AS VARCHAR) ELSE 'belt-1' END AS belt_id,
  {SENSOR_CASE} AS sensorid, epoch_us(CAST(ts AS TIMESTAMP)) AS ts_us, value AS avg_value,
  value - sd AS min_value, value + sd AS max_value, sd AS std_deviation, sd * sd AS variance, value AS median
FROM r2
WHERE event_type <> 'error' AND NOT (event_type = 'signup' AND k < 50)"""
    ctes = stream_ctes()
    sel = ", ".join(f"{q4(f'avg({c})')} AS {c}" for c in STREAM_COLS)
    out["stream_features_batch_form"] = with_ctes(*ctes, body=f"""
SELECT belt_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, {sel}
FROM sfa GROUP BY belt_id, strftime(ts, '%Y-%m-%d')""")
    risk, hband, rband = alert_case("ml_health", "ml_rul_days")
    out["stream_alerts"] = with_ctes(*ctes, body=f"""
SELECT belt_id, {risk} AS risk, {hband} AS health_band, {rband} AS rul_band, count(*) AS n,
  {q4('avg(ml_health)')} AS ml_health, {q4('avg(ml_rul_days)')} AS ml_rul_days,
  {q4('avg(failure_risk_score)')} AS failure_risk_score
FROM sfa GROUP BY ALL""")
    out["streaming_alert_counts"] = with_ctes(*ctes, body=f"""
SELECT belt_id, {risk} AS risk, {hband} AS health_band, {rband} AS rul_band, count(*) AS n,
  {q4('min(degradation_index)')} AS min_degradation, {q4('max(degradation_index)')} AS max_degradation,
  {q4('avg(failure_risk_score)')} AS failure_risk_score, {q4('avg(degradation_index)')} AS degradation_index
FROM sfa GROUP BY ALL""")
    out["stream_event_time"] = with_ctes(*ctes, body=f"""
SELECT belt_id, {risk} AS risk, {hband} AS health_band, {rband} AS rul_band, count(*) AS n,
  {q4('min(degradation_index)')} AS min_degradation, {q4('max(degradation_index)')} AS max_degradation,
  {q4('avg(failure_risk_score)')} AS failure_risk_score, {q4('avg(degradation_index)')} AS degradation_index
FROM sfa JOIN (SELECT belt_id, max(ts) - INTERVAL 6 HOUR AS until FROM readings GROUP BY belt_id) c USING (belt_id)
WHERE sfa.ts <= c.until GROUP BY ALL""")
    out["stream_routed"] = f"""
WITH n AS (
  SELECT CASE WHEN {k} >= 6 THEN 'belt-' || CAST(user_id % 4 AS VARCHAR) ELSE 'belt-1' END AS belt_id, {SENSOR_CASE} AS sensorid, event_id,
    event_type = 'error' OR (event_type = 'signup' AND {k} < 50) AS bad
  FROM events),
seen AS (
  SELECT belt_id, {", ".join(f"sum(CAST(sensorid = '{s}' AS INTEGER)) OVER w AS {SHORT[s]}" for s in CORE_SENSORS)}
  FROM n WHERE NOT bad WINDOW w AS (PARTITION BY belt_id ORDER BY event_id))
SELECT 'belt-raw-data' AS sink, CASE WHEN bad THEN '' ELSE belt_id END AS belt_id, count(*) AS n FROM n GROUP BY ALL
UNION ALL SELECT 'belt-predictions', belt_id, count(*) FROM seen WHERE temp >= 30 AND elong >= 30 AND curr >= 30 GROUP BY belt_id
UNION ALL SELECT 'belt-bad-records', '', count(*) FROM n WHERE bad HAVING count(*) > 0"""
    deg = "coalesce(degradation_index, 0.0)"
    days = clip(f"{D(2000)} - {D(330)} * failure_proximity", 0, TH.baseline_rul_days)
    share = clip(f"{D(1)} - ({D(0.08)} * {deg} + {D(0.03)} * warning_count + {D(0.08)} * critical_count)", 0.65, 1)
    blend = clip(f"{D(0.7)} * {clip(f'{D(100)} - {D(45)} * degradation_index', 0, 100)} + {D(0.3)} * ({D(100)} * f_rul / {D(TH.baseline_rul_days)})", 0, 100)
    m_risk, m_health, m_rul = alert_case("f_health", "f_rul")
    out["stream_model_alerts"] = with_ctes(*ctes, body=f"""
SELECT belt_id, {m_risk} AS risk, {m_health} AS health_band, {m_rul} AS rul_band,
  CASE WHEN f_rul < 50 OR f_health < 40 THEN 'LOW' ELSE 'HIGH' END AS confidence_level, 'ok' AS prediction_status, count(*) AS n,
  CAST(sum(CAST({deg} > {D(0.6)} AND elong_trend_6h > {D(0.01)} AS INTEGER)) AS BIGINT) AS n_early,
  {q4(f"avg({clip(f'{D(0.5)} * critical_count + {D(0.3)} * warning_count + {D(0.4)} * {deg}', 0, 5)})")} AS failure_risk_score,
  round(avg(f_health)) AS ml_health, round(avg(f_rul)) AS ml_rul_days
FROM (SELECT *, {blend} AS f_health FROM (SELECT *, {days} * {share} AS f_rul FROM sfa)) GROUP BY ALL""")
    out["topic_routing"] = with_ctes(*ctes, body=f"""
SELECT 'belt-raw-data' AS pipeline, belt_id, count(*) AS n FROM readings WHERE sensorid IN ({CORE_LIST}) GROUP BY belt_id
UNION ALL
SELECT 'belt-predictions' AS pipeline, belt_id, count(*) AS n FROM sfa GROUP BY belt_id""")
    out["replay_rows"] = with_ctes(READINGS, body=f"""
SELECT sensorid, epoch_us(ts) AS ts_us, avg_value FROM readings WHERE sensorid IN ({CORE_LIST})""")
    return out
