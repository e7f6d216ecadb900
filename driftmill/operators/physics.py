"""Acoustic profile of an image and its acquisition parameters (a map of strings): column expressions.

Grey levels are display values, so attenuation is a relative proxy.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import image

SOUND_SPEED, FREQUENCY = 1540.0, 5.0
#: Added to profiles before they divide or go through a logarithm.
EPS = 1e-4


def number(params: Column, *names: str) -> Column:
    """The first of the named parameters that is a finite number; null if none is."""

    def one(name: str) -> Column:
        x = F.get(F.transform(F.array(params), lambda p: F.try_element_at(p, F.lit(name))), F.lit(0)).try_cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) < F.lit(math.inf)), x)

    return F.coalesce(*map(one, names))


def clipped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def parameters(params: Column) -> dict[str, Column]:
    """What the parameters alone give: wavelength, axial resolution, timing bounds and their consistency."""
    speed = F.coalesce(number(params, "sound_speed_m_s", "speed_of_sound_m_s"), F.lit(SOUND_SPEED))
    given = number(params, "frequency_mhz", "frequency")
    frequency = F.coalesce(given, F.lit(FREQUENCY))
    depth, pulse, prf = number(params, "depth_mm", "depth"), number(params, "pulse_duration_us", "pulse_duration", "pd_us", "pd"), number(params, "prf_hz", "prf")
    wavelength = speed / (frequency * 1e6) * 1e3
    most = F.when(depth != 0, speed / (2 * depth * 1e-3))
    margin = F.when((most > 0) & (prf != 0), most / prf)
    off = lambda penalty, wrong: F.when(wrong, penalty).otherwise(0.0)
    penalties = off(0.30, ~frequency.between(1, 20)) + off(0.30, ~speed.between(1450, 1650)) + off(0.15, ~depth.between(1, 300)) + off(0.10, ~pulse.between(0.01, 20)) + off(0.15, prf <= 0) + off(0.20, margin < 1)
    return {
        "sound_speed_m_s": speed,
        "frequency_mhz": frequency,
        "depth_mm": depth,
        "wavelength_mm": wavelength,
        "axial_resolution_mm": F.when(pulse > 0, speed * pulse * 1e-3 / 2).otherwise(wavelength / 2),
        "theoretical_max_prf_hz": most,
        "prf_depth_margin": margin,
        "physical_consistency_score": clipped(1 - penalties),
        "metadata_complete": depth.isNotNull() & given.isNotNull(),
    }


def row_medians(px: Column, height: int, width: int) -> Column:
    return image.bound(px, lambda own: F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda i: image.quantile(F.slice(own, i * width + 1, F.lit(width)), 0.5)))


def slope(values: Column, length: Column) -> Column:
    """Least squares of values at even places from 0 to length."""

    def of(v: Column) -> Column:
        n = F.size(v)
        step, middle = F.nullif(length, F.lit(0.0)) / F.greatest(n - 1, F.lit(1)), (n - 1) / 2
        return F.when(n > 1, F.aggregate(F.transform(v, lambda y, i: (i - middle) * y), F.lit(0.0), lambda a, x: a + x) / (n * (n * n - 1) / 12) / step)

    return image.bound(values, of)


def acoustics(params: Column, slope: Column, near: Column, far: Column, row_mean: Column, row_std: Column) -> dict[str, Column]:
    """The acoustic quantities from the row medians' slope over a depth of 1, the means of their first and last quarters, and their mean and deviation."""
    own = parameters(params)
    s = slope / F.nullif(F.coalesce(own["depth_mm"], F.lit(1.0)), F.lit(0.0))
    scale = F.when(F.coalesce(own["depth_mm"], F.lit(0.0)) != 0, 10 / math.log(10)).otherwise(1.0)
    return own | {
        "axial_intensity_slope": s,
        "attenuation_proxy_db_cm_mhz": F.abs(s) * scale / F.greatest(own["frequency_mhz"], F.lit(1e-9)),
        "near_field_energy_ratio": clipped(near / (near + far + EPS)),
        "depth_uniformity": clipped(1 / (1 + row_std / (row_mean + EPS))),
    }


def record(px: Column, params: Column, height: int, width: int) -> Column:
    """The whole acoustic record of an image as one struct, by expressions alone."""
    quarter = max(1, height // 4)

    def features(rows: Column) -> Column:
        near, far = (image.mean(F.slice(rows, start, quarter)) for start in (1, height - quarter + 1))
        s = slope(F.transform(rows, lambda m: F.log(F.greatest(m, F.lit(EPS)))), F.lit(1.0))
        e = F.struct(s.alias("s"), near.alias("near"), far.alias("far"), image.mean(rows).alias("m"), F.sqrt(image.variance(rows)).alias("sd"))
        return image.bound(e, lambda x: F.struct(*(c.alias(k) for k, c in acoustics(params, x["s"], x["near"], x["far"], x["m"], x["sd"]).items())))

    return image.bound(row_medians(F.transform(px, clipped), height, width), features)


def perturbed(params: Column, name: str, factor: float) -> Column:
    """params with one number scaled; a missing one is an error."""
    if not (factor > 0 and math.isfinite(factor)):
        raise ValueError("the factor is finite and positive")
    old = number(params, name)
    new = F.when(old.isNotNull(), (old * factor).cast("string")).otherwise(F.raise_error(F.lit(f"no parameter {name}")))
    return F.map_concat(F.map_filter(params, lambda k, _: k != name), F.create_map(F.lit(name), new))


def counterfactual(params: Column, name: str, factor: float) -> dict[str, Column]:
    """What scaling one parameter does to the quantities that the parameters determine."""
    now, then = parameters(params), parameters(perturbed(params, name, factor))
    ratio = lambda c: then[c] / F.when(now[c] != 0, now[c])
    return {
        "baseline_value": number(params, name),
        "counterfactual_value": number(params, name) * factor,
        "wavelength_ratio": ratio("wavelength_mm"),
        "axial_resolution_ratio": ratio("axial_resolution_mm"),
        "prf_margin_ratio": ratio("prf_depth_margin"),
        "physical_consistency_delta": then["physical_consistency_score"] - now["physical_consistency_score"],
    }
