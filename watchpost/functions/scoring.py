"""Scalar rules: rounding, clamps, anomaly and level thresholds, slugs, multipliers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The levels in order, from calm to severe, and the risk at which each begins.
LEVELS = ("Normal", "Watch", "Warning", "Alert", "Emergency")
LEVEL_FROM = (0, 15, 35, 55, 75)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rounded(x: Column | str, digits: int) -> Column:
    """Half up in plain IEEE steps, so that every engine agrees."""
    scale = float(10**digits)
    return F.floor(col(x) * scale + 0.5) / scale


def clamp(x: Column | str) -> Column:
    """Held to 0..1; null stays null (least and greatest alone would skip it)."""
    return F.when(col(x).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(x))))


def anomaly_from_z(z: Column | str, low: float = 2.0, high: float = 6.0) -> Column:
    """0 up to `low`, 1 from `high`, linear between: only positive excursions count."""
    return F.when(col(z) <= low, 0.0).otherwise(F.least(F.lit(1.0), (col(z) - low) / (high - low)))


def level_for(risk: Column | str) -> Column:
    out = None
    for name, least in list(zip(LEVELS, LEVEL_FROM, strict=True))[:0:-1]:
        out = F.when(col(risk) >= least, name) if out is None else out.when(col(risk) >= least, name)
    return out.otherwise(LEVELS[0])


def level_order(level: Column | str) -> Column:
    """0 for Normal to 4 for Emergency; unknown levels count as Normal."""
    return F.coalesce(F.create_map(*[F.lit(x) for i, name in enumerate(LEVELS) for x in (name, i)])[col(level)], F.lit(0))


def drift_band(psi: Column | str) -> Column:
    return F.when(col(psi) >= 0.25, "high").when(col(psi) >= 0.1, "moderate").otherwise("stable")


def slug(name: Column | str) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.trim(col(name))), "[^a-z0-9]+", "_"), F.lit("_"))


def transmission_multiplier(school_closure: Column | str, masking: Column | str, travel_restriction: Column | str) -> Column:
    """Product of 1 - strongest effect times lever, levers held to 0..1."""
    return (1 - 0.20 * clamp(school_closure)) * (1 - 0.35 * clamp(masking)) * (1 - 0.15 * clamp(travel_restriction))


def integrity_failed(value: Column | str, signal_type: Column | str) -> Column:
    v, s = col(value), col(signal_type)
    return v.isNull() | F.isnan(v) | (v < 0) | (s.startswith("search_") & (v > 100)) | ((s == "weather_humidity") & (v > 100))


def signed_percent(value: Column | str) -> Column:
    """`+12.5% vs baseline` from a value with one decimal."""
    v = col(value)
    return F.concat(F.when(v >= 0, "+").otherwise(""), v.cast("decimal(18,1)").cast("string"), F.lit("% vs baseline"))
