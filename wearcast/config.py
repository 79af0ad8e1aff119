"""Thresholds, belt metadata and the feature contract.

Everything here is plain driver-side configuration.  Values reach the
executors only as literals inside column expressions, or as tiny
broadcast tables whose size is bounded by the number of sensors / belts
listed in the config (never by the data).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for identical results.
# (sensor names, default thresholds, baselines, band limits, feature names)
# ---------------------------------------------------------------------------

TEMP_SENSOR = "temperature_boot_material/temperature"
ELONG_SENSOR = "ultrasonic_boot/elongation"
CURRENT_SENSOR = "current_transducer_head/current"
CORE_SENSORS = [TEMP_SENSOR, ELONG_SENSOR, CURRENT_SENSOR]

# internal short names used inside the engine; renamed only at the output edge
SHORT = {TEMP_SENSOR: "temp", ELONG_SENSOR: "elong", CURRENT_SENSOR: "curr"}

DEFAULT_BELT = "belt-1"

BASELINE_RUL_DAYS = 2190.0
BASELINE_TEMP = 60.0
BASELINE_ELONG = 280.0
IDLE_CURRENT = 4.5
HIGH_LOAD_CURRENT = 62.0

SENSOR_LIMITS = {  # warning / critical
    TEMP_SENSOR: (90.0, 100.0),
    ELONG_SENSOR: (300.0, 310.0),
    CURRENT_SENSOR: (62.0, 80.0),
}

# rolling windows in grid rows (1 row = 1 minute)
WINDOWS = {"1h": 60, "6h": 360, "12h": 720, "24h": 1440}

# stream alert bands, shipped config
HEALTH_BANDS = {"critical": 50.0, "warning": 65.0, "maintenance_due": 75.0,
                "good": 85.0, "excellent": 90.0}
RUL_BANDS = {"critical_days": 90.0, "warning_days": 180.0, "maintenance_due_days": 1080.0}
# alert-engine defaults that apply only when no config is given
HEALTH_BANDS_CODE_DEFAULT = {"critical": 40.0, "warning": 55.0, "maintenance_due": 65.0,
                             "good": 75.0, "excellent": 90.0}
RUL_BANDS_CODE_DEFAULT = {"critical_days": 180.0, "warning_days": 540.0,
                          "maintenance_due_days": 1080.0}

# batch report / operational-risk limits
QUALITY_MIN_ROWS = 100
QUALITY_MAX_MISSING = 0.3

STATUS_OK = {"ok", "ok_ml_only", "safe_mode_calendar"}

# model settings of the shipped model config
MODEL_PARAMS = {
    "n_estimators": 200, "max_depth": 12, "min_samples_split": 10,
    "min_samples_leaf": 5, "max_features": "sqrt", "random_state": 42,
    "test_size": 0.2, "cv_folds": 3, "cv_n_estimators": 80, "top_features": 40,
}


# The 77-name model feature contract, in the shipped order.
MODEL_FEATURES = (
    [f"{CURRENT_SENSOR}_avg", f"{TEMP_SENSOR}_avg", f"{ELONG_SENSOR}_avg"]
    + [f"{TEMP_SENSOR}_{lbl}_{st}" for lbl in WINDOWS for st in ("mean", "std", "min", "max")]
    + [f"{ELONG_SENSOR}_{lbl}_{st}" for lbl in WINDOWS for st in ("mean", "std", "min", "max")]
    + [f"{CURRENT_SENSOR}_{lbl}_{st}" for lbl in WINDOWS for st in ("mean", "std", "min", "max")]
    + ["is_idle", "high_load", "utilization_1h", "utilization_6h", "high_load_share_6h",
       "current_percentile", "current_volatility_6h", "elong_rate_12h", "elong_delta",
       "elong_delta_rate", "elong_trend_1h", "elong_trend_6h", "elong_trend_24h",
       "elong_micro_trend", "elong_accel_6h", "elong_volatility_6h", "temp_above_baseline",
       "temp_variability_12h", "temp_trend_1h", "temp_trend_6h", "temp_trend_24h",
       "temp_spike_index", "temp_elong_coupling", "temp_elong_interaction",
       "failure_proximity", "failure_trigger"]
)


def internal_feature_name(name: str) -> str:
    """`ultrasonic_boot/elongation_6h_mean` -> `elong_6h_mean` (no slash, no backticks)."""
    for long, short in SHORT.items():
        if name.startswith(long + "_"):
            return short + name[len(long):]
    return name


def external_feature_name(name: str) -> str:
    for long, short in SHORT.items():
        if name.startswith(short + "_") and name[len(short) + 1:].split("_")[0] in (
                "avg", "1h", "6h", "12h", "24h"):
            return long + name[len(short):]
    return name


@dataclass
class Thresholds:
    """Per-key defaults, overridable from a JSON file (missing/bad file -> defaults)."""

    baseline_rul_days: float = BASELINE_RUL_DAYS
    baseline_temp: float = BASELINE_TEMP
    baseline_elong: float = BASELINE_ELONG
    idle_current: float = IDLE_CURRENT
    high_load: float = HIGH_LOAD_CURRENT
    limits: dict = field(default_factory=lambda: dict(SENSOR_LIMITS))
    # optional per-sensor valid ranges for the cleaning filter: sensor -> (min, max)
    ranges: dict = field(default_factory=dict)
    health_bands: dict = field(default_factory=lambda: dict(HEALTH_BANDS))
    rul_bands: dict = field(default_factory=lambda: dict(RUL_BANDS))
    quality_min_rows: int = QUALITY_MIN_ROWS
    quality_max_missing: float = QUALITY_MAX_MISSING

    def warn(self, sensor: str) -> float:
        return float(self.limits[sensor][0])

    def crit(self, sensor: str) -> float:
        return float(self.limits[sensor][1])

    @property
    def elong_span(self) -> float:
        return max(self.crit(ELONG_SENSOR) - self.baseline_elong, 1.0)

    @classmethod
    def from_dict(cls, cfg: dict[str, Any]) -> "Thresholds":
        t = cls()
        base = cfg.get("baseline_values", {}) or {}
        t.baseline_rul_days = float(base.get("baseline_rul_days", t.baseline_rul_days))
        t.baseline_temp = float(base.get("baseline_temp_celsius", t.baseline_temp))
        t.baseline_elong = float(base.get("baseline_elongation", t.baseline_elong))
        t.idle_current = float((cfg.get("idle_detection", {}) or {}).get("current_threshold", t.idle_current))
        t.high_load = float((cfg.get("operational_states", {}) or {}).get("high_load_threshold", t.high_load))
        sens = cfg.get("sensor_thresholds", {}) or {}
        for s in CORE_SENSORS:
            c = sens.get(s, {}) or {}
            w, k = SENSOR_LIMITS[s]
            t.limits[s] = (float(c.get("warning", w)), float(c.get("critical", k)))
            if "min" in c or "max" in c:
                t.ranges[s] = (c.get("min"), c.get("max"))
        hs = cfg.get("health_score_thresholds")
        if hs is not None:
            t.health_bands = {k: float(hs.get(k, HEALTH_BANDS_CODE_DEFAULT[k])) for k in HEALTH_BANDS_CODE_DEFAULT}
        rb = cfg.get("rul_thresholds")
        if rb is not None:
            t.rul_bands = {k: float(rb.get(k, RUL_BANDS_CODE_DEFAULT[k])) for k in RUL_BANDS_CODE_DEFAULT}
        dq = cfg.get("data_quality", {}) or {}
        t.quality_min_rows = int(dq.get("min_rows_required", t.quality_min_rows))
        t.quality_max_missing = float(dq.get("max_missing_ratio", t.quality_max_missing))
        return t


@dataclass(frozen=True)
class BeltMeta:
    belt_id: str
    installation_date: str
    replace_date: str


# Metadata used with the driver's `events` adapter (FIXTURES.md §2).
FIXTURE_BELTS = [
    BeltMeta("belt-0", "2023-12-01", "2029-11-29"),
    BeltMeta("belt-1", "2023-12-01", "2025-01-01"),
    BeltMeta("belt-2", "2023-12-01", "2024-03-01"),
    BeltMeta("belt-3", "2023-12-01", "2024-01-15"),
]


def validate_belts(belts: list[BeltMeta]) -> None:
    """SRC-7: both dates must parse and replace must come after install."""
    from datetime import date

    for b in belts:
        try:
            i = date.fromisoformat(b.installation_date[:10])
            r = date.fromisoformat(b.replace_date[:10])
        except (TypeError, ValueError) as exc:
            raise ValueError(f"invalid dates for {b.belt_id}: {exc}") from exc
        if r <= i:
            raise ValueError(f"replace_date must be later than installation_date for {b.belt_id}")


def belts_from(raw: Any) -> list[BeltMeta]:
    """One metadata object or a list of them (`installation_date` or `install_date`)."""
    items = raw if isinstance(raw, list) else [raw]
    out = []
    for it in items:
        inst = it.get("installation_date") or it.get("install_date")
        rep = it.get("replace_date")
        if not inst:
            raise ValueError("installation_date/install_date missing")
        if not rep:
            raise ValueError("replace_date missing")
        bid = it.get("belt_id", DEFAULT_BELT)
        bid = str(bid) if isinstance(bid, str) else f"belt-{bid}"
        out.append(BeltMeta(bid, str(inst), str(rep)))
    validate_belts(out)
    return out
