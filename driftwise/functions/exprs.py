"""Scalar column expressions (F1-F16). All are native Catalyst expressions; no Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftwise.params import AQI_BANDS, AQI_SEVERE, PSI_MODERATE, PSI_SIGNIFICANT, UUID_PATTERN

__all__ = [
    "col", "parse_ts", "parse_double", "json_field", "aqi_band", "aqi_color", "psi_severity",
    "zero_to_eps", "progress_ratio", "iso_ts", "short_ts", "pct_text", "to_float32", "is_uuid",
    "quantile_grid", "epoch_seconds", "epoch_micros", "event_time", "ntz_from_instant", "ntz_from_seconds",
    "ntz_lit", "as_ntz",
]


def col(name: str) -> Column:
    """Column reference that tolerates dots in names (``PM2.5``)."""
    return F.col(f"`{name}`") if "." in name and not name.startswith("`") else F.col(name)


def parse_ts(c: Column | str, fmt: str | None = None) -> Column:
    """coerce to timestamp; unparseable -> null, never an error (ANSI mode is on)."""
    c = col(c) if isinstance(c, str) else c
    s = c.cast("string")
    return F.try_to_timestamp(s, F.lit(fmt)) if fmt else F.try_to_timestamp(s)


def parse_double(c: Column | str) -> Column:
    """coerce to double; JSON booleans count as 1/0 like the pandas coercion, junk and the text NaN -> null."""
    c = col(c) if isinstance(c, str) else c
    text = c.cast("string")
    s = F.lower(F.trim(text))
    # a number as it stands, nearly always the case, is read once; only the rest is compared
    return F.coalesce(
        F.nanvl(text.try_cast("double"), F.lit(None).cast("double")),
        F.when(s == "true", F.lit(1.0))
        .when(s == "false", F.lit(0.0))
        .when(s.isin("nan", "+nan", "-nan"), F.lit(None).cast("double"))
        .otherwise(s.try_cast("double")),
    )


def json_field(json_col: Column | str, key: str) -> Column:
    """text of one top-level JSON key; dotted keys (``PM2.5``) are addressed with bracket syntax."""
    j = col(json_col) if isinstance(json_col, str) else json_col
    return F.get_json_object(j, f"$['{key}']")


def aqi_band(v: Column) -> Column:
    """AQI category label; null stays null."""
    expr = None
    for hi, label, _ in AQI_BANDS:
        expr = F.when(v <= hi, F.lit(label)) if expr is None else expr.when(v <= hi, F.lit(label))
    return F.when(v.isNull(), F.lit(None).cast("string")).otherwise(expr.otherwise(F.lit(AQI_SEVERE[0])))


def aqi_color(v: Column) -> Column:
    expr = None
    for hi, _, color in AQI_BANDS:
        expr = F.when(v <= hi, F.lit(color)) if expr is None else expr.when(v <= hi, F.lit(color))
    return F.when(v.isNull(), F.lit(None).cast("string")).otherwise(expr.otherwise(F.lit(AQI_SEVERE[1])))


def psi_severity(psi: Column) -> Column:
    """both band edges belong to 'moderate'."""
    return (
        F.when(psi.isNull(), F.lit(None).cast("string"))
        .when(psi < PSI_MODERATE, F.lit("none"))
        .when(psi <= PSI_SIGNIFICANT, F.lit("moderate"))
        .otherwise(F.lit("significant"))
    )


def zero_to_eps(x: Column, eps: float) -> Column:
    """F8."""
    return F.when(x == 0, F.lit(eps)).otherwise(x)


def progress_ratio(count: Column, threshold: Column) -> Column:
    """min(count / max(thr, 1), 1)."""
    return F.least(count.cast("double") / F.greatest(threshold.cast("double"), F.lit(1.0)), F.lit(1.0))


def iso_ts(ts: Column) -> Column:
    """ISO-8601 text like Python's ``isoformat()`` (fraction omitted when it is zero)."""
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.date_format(ts, "SSSSSS")
    return F.when(ts.isNull(), F.lit(None).cast("string")).when(
        frac == "000000", base).otherwise(F.concat(base, F.lit("."), frac))


def short_ts(ts: Column) -> Column:
    """first 19 characters of the ISO text with 'T' replaced by a space."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def pct_text(x: Column, digits: int = 1) -> Column:
    """fraction as percent text, e.g. 0.123 -> '12.3%'."""
    return F.concat(F.round(x * 100.0, digits).cast("string"), F.lit("%"))


def to_float32(c: Column) -> Column:
    """model-edge cast."""
    return c.cast("float")


def is_uuid(c: Column) -> Column:
    """F16."""
    return c.rlike(UUID_PATTERN)


def quantile_grid(n_bins: int) -> list[float]:
    """i / n for i = 0..n (same float values as an evenly spaced grid)."""
    return [i / n_bins for i in range(n_bins + 1)]


# Time handling is independent of the session time zone: wall-clock (timestamp_ntz) values are read as
# UTC through exact NTZ arithmetic instead of casts that go through spark.sql.session.timeZone.
def _epoch_ntz() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a wall-clock timestamp."""
    return F.timestamp_diff("MICROSECOND", _epoch_ntz(), ts.cast("timestamp_ntz"))


def epoch_seconds(ts: Column) -> Column:
    """Seconds since the epoch as double."""
    return epoch_micros(ts) / 1_000_000.0


def event_time(ts: Column) -> Column:
    """Wall clock -> TIMESTAMP (instant read as UTC), for watermarks, which refuse timestamp_ntz."""
    return F.timestamp_micros(epoch_micros(ts))


def ntz_from_instant(c: Column) -> Column:
    """Inverse of ``event_time``."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), _epoch_ntz())


def ntz_from_seconds(c: Column) -> Column:
    return F.timestamp_add("SECOND", c.cast("long"), _epoch_ntz())


def as_ntz(value) -> Column:
    """Column (cast) or naive datetime (exact literal) -> timestamp_ntz."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if hasattr(value, "strftime"):
        return ntz_lit(value)
    return F.lit(value).cast("timestamp_ntz")


def ntz_lit(value) -> Column:
    """A timestamp_ntz literal from a naive datetime (no time-zone conversion on the way); None -> null."""
    if value is None:
        return F.lit(None).cast("timestamp_ntz")
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
