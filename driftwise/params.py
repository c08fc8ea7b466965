"""Frozen parameter objects. Every tunable is passed in explicitly; nothing reads the clock or the environment."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference pipeline's for equal results.
# ---------------------------------------------------------------------------
# Canonical pollutant order of the raw sensor table.
POLLUTANTS = (
    "PM2.5", "PM10", "NO", "NO2", "NOx", "NH3", "CO", "SO2", "O3", "Benzene", "Toluene", "Xylene",
)
# Request-field aliases accepted next to the canonical names.
POLLUTANT_ALIASES = {
    "pm25": "PM2.5", "pm10": "PM10", "no": "NO", "no2": "NO2", "nox": "NOx", "nh3": "NH3",
    "co": "CO", "so2": "SO2", "o3": "O3", "benzene": "Benzene", "toluene": "Toluene", "xylene": "Xylene",
}
# Plausible value range per input column (inclusive): (low, high).
VALUE_RANGES = {
    "PM2.5": (0.0, 2000.0), "PM10": (0.0, 3000.0), "NO": (0.0, 500.0), "NO2": (0.0, 500.0),
    "NOx": (0.0, 1000.0), "NH3": (0.0, 500.0), "CO": (0.0, 100.0), "SO2": (0.0, 500.0),
    "O3": (0.0, 500.0), "Benzene": (0.0, 200.0), "Toluene": (0.0, 200.0), "Xylene": (0.0, 200.0),
    "AQI": (0.0, 1000.0),
}
# AQI category bands: (inclusive upper bound, label, colour); above the last bound is "Severe".
AQI_BANDS = (
    (50.0, "Good", "#00b050"),
    (100.0, "Satisfactory", "#a9d08e"),
    (200.0, "Moderate", "#ffc000"),
    (300.0, "Poor", "#ed7d31"),
    (400.0, "Very Poor", "#c00000"),
)
AQI_SEVERE = ("Severe", "#7030a0")
# PSI severity: below 0.10 none, 0.10 to 0.25 (both inclusive) moderate, above 0.25 significant.
PSI_MODERATE = 0.10
PSI_SIGNIFICANT = 0.25
# Cumulative histogram buckets (upper bounds, "le").
LATENCY_BUCKETS_S = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
PREDICTION_VALUE_BUCKETS = (0.0, 50.0, 100.0, 150.0, 200.0, 250.0, 300.0, 400.0, 500.0, 750.0, 1000.0)
# UUID text pattern.
UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


@dataclass(frozen=True)
class SkewParams:
    """Hot-key splitting for ordered per-entity windows.

    A key with more than ``hot_key_rows`` rows is cut into time segments of about ``segment_rows`` rows;
    the number of hot keys is therefore at most total_rows / hot_key_rows, which bounds every broadcast.
    """

    hot_key_rows: int = 4_000_000
    segment_rows: int = 1_000_000


@dataclass(frozen=True)
class FeatureParams:
    key: str = "city"
    ts: str = "ts"
    tiebreak: str = "event_id"
    pollutants: tuple[str, ...] = ("p1", "p2")
    target: str = "target"
    lags: tuple[int, ...] = (1, 2, 3, 7)
    rolls: tuple[int, ...] = (3, 7, 14)
    skew: SkewParams = field(default_factory=SkewParams)


@dataclass(frozen=True)
class ValidateParams:
    required_columns: tuple[str, ...] = ("City", "Date") + POLLUTANTS + ("AQI",)
    max_missing_pct: float = 0.5
    min_rows: int = 1000
    target: str = "AQI"
    date_col: str = "Date"
    city_col: str = "City"
    target_missing_warn: float = 0.3


@dataclass(frozen=True)
class DriftParams:
    rmse_threshold: float = 100.0
    psi_threshold: float = 0.2
    feedback_count_threshold: int = 10
    window_hours: int = 24
    n_bins: int = 10
    epsilon: float = 1e-4
    cooldown_hours: int = 1


@dataclass(frozen=True)
class SplitParams:
    val_size: float = 0.15
    test_size: float = 0.15
    holdout_frac: float = 0.15
    bucket_seconds: int = 3600
    segment_rows: int = 1_000_000
