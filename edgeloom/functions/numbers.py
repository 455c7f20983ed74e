"""Coercion, units of grids, classification of generators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBERS, INTEGERS, FLAGS = ("float", "number", "double", "decimal"), ("int", "integer", "long"), ("bool", "boolean")


def safe_double(c: Column) -> Column:
    """null for what is no number, NaN included."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def to_double(c: Column) -> Column:
    """A decimal comma counts as a point."""
    return safe_double(F.replace(F.trim(c), F.lit(","), F.lit(".")))


def to_long(c: Column) -> Column:
    """`3.0` is 3; a fraction is cut off."""
    return to_double(c).try_cast("long")


def to_bool(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin("true", "1", "yes"), True).when(low.isin("false", "0", "no"), False)


def coerces(c: Column, dtype: Column) -> Column:
    """Whether a value (not null) fits its declared type."""
    low = F.lower(dtype)
    return F.when(low.isin(*NUMBERS), to_double(c).isNotNull()).when(low.isin(*INTEGERS), to_long(c).isNotNull()).when(low.isin(*FLAGS), to_bool(c).isNotNull()).otherwise(True)


def is_numeric(dtype: Column) -> Column:
    return F.lower(dtype).isin(*NUMBERS, *INTEGERS)


def rounded_kv(kv: Column, digits: int = 0) -> Column:
    """Half to even, then cut to an integer."""
    return F.bround(kv, digits).cast("int")


def base_impedance(kv: Column, mva: Column | float) -> Column:
    return kv * kv / mva


def to_per_unit(r: Column, x: Column, b_siemens: Column, kv: Column, mva: float) -> tuple[Column, Column, Column]:
    z = base_impedance(kv, mva)
    return r / z, x / z, b_siemens * z


def from_per_unit(r: Column, x: Column, b: Column, kv: Column, mva: float) -> tuple[Column, Column, Column]:
    z = base_impedance(kv, mva)
    return r * z, x * z, b / z


def nf_to_us(c: Column, hertz: float = 50.0) -> Column:
    """Capacitance in nF to susceptance in µS."""
    return 2 * math.pi * hertz * c * 1e-3


def rating_mva(kv: Column, ka: Column) -> Column:
    return math.sqrt(3) * kv * ka


def transformer_impedance(vk_percent: Column, vkr_percent: Column, mva: Column, base_mva: float) -> tuple[Column, Column]:
    """r and x per unit of a transformer from its short-circuit voltages."""
    z, r = vk_percent / 100 * base_mva / mva, vkr_percent / 100 * base_mva / mva
    return r, F.sqrt(F.greatest(z * z - r * r, F.lit(0.0)))


def nearest(c: Column, levels: list[float]) -> Column:
    """The level with the least difference, of equally near ones the smallest."""
    return F.array_min(F.transform(F.array(*map(F.lit, sorted(levels))), lambda v: F.struct(F.abs(c - v).alias("d"), v.alias("v"))))["v"]


def generation_category(label: Column) -> Column:
    """Of a label with class, id and technology; null if none fits."""
    low = F.lower(label)
    has = lambda *words: low.rlike("|".join(words))
    return F.when(has("run.?of.?river", "ror"), "run_of_river").when(has("offshore"), "wind_offshore").when(has("onshore", "wind"), "wind_onshore").when(has("solar", "pv"), "solar_pv")


def iso_duration(seconds: Column) -> Column:
    """PT1H, PT15M, PT30S."""
    whole = lambda s: (seconds % s == 0)
    part = lambda s, unit: F.concat(F.lit("PT"), (seconds / s).cast("long").cast("string"), F.lit(unit))
    return F.when(whole(3600), part(3600, "H")).when(whole(60), part(60, "M")).otherwise(part(1, "S"))
