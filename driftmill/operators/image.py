"""Features of one image, held as an array of pixels in [0, 1], row after row: array expressions, so no row is exploded or shuffled.

An expression that a lambda uses for every pixel is bound first (``bound``), as the optimizer would otherwise evaluate it
once a pixel; every feature is linear in the pixels but for the sorts of quantiles and histograms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rescaled(px: Column) -> Column:
    """Each image to [0, 1] by its own minimum and maximum; a constant image to zeros."""
    ends = F.struct(px.alias("px"), F.array_min(px).alias("low"), F.array_max(px).alias("high"))
    return bound(ends, lambda e: F.transform(e["px"], lambda x: F.when(e["high"] > e["low"], (x - e["low"]) / (e["high"] - e["low"])).otherwise(F.lit(0.0))))


def scaled(px: Column, kind: str) -> Column:
    """Stored values to [0, 1] by their kind: uint8, uint16, or float, which must lie there already; anything else is an error."""
    most = {"uint8": 255.0, "uint16": 65535.0, "float": 1.0}[kind]
    ok = F.forall(px, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (x >= 0) & (x <= most)) & (F.size(px) > 0)
    return F.when(ok, F.transform(px, lambda x: x.cast("double") / most)).otherwise(F.raise_error(F.lit("pixels outside of their range")))


def mean(px: Column) -> Column:
    return F.aggregate(px, F.lit(0.0), lambda a, x: a + x) / F.size(px)


def variance(px: Column) -> Column:
    """Of the population."""
    return bound(F.struct(px.alias("px"), mean(px).alias("m")), lambda e: F.aggregate(e["px"], F.lit(0.0), lambda a, x: a + (x - e["m"]) * (x - e["m"])) / F.size(e["px"]))


def ranked_quantile(ranked: Column, p: float) -> Column:
    """Of sorted pixels, with linear interpolation between ranks."""
    at = (F.size(ranked) - 1) * F.lit(p)
    low = F.floor(at).cast("int")
    first = F.get(ranked, low)
    return first + (F.get(ranked, F.least(low + 1, F.size(ranked) - 1)) - first) * (at - low)


def quantile(px: Column, p: float) -> Column:
    return bound(F.array_sort(px), lambda ranked: ranked_quantile(ranked, p))


def entropy(px: Column, bins: int = 256) -> Column:
    """In bits, of the histogram over [0, 1] whose last bin is closed: log n less the mean of c log c over runs of sorted bins."""
    at = F.array_sort(F.transform(px, lambda x: F.least(F.floor(x * bins), F.lit(bins - 1)).cast("int")))
    zero = F.struct(F.lit(-1).alias("bin"), F.lit(0.0).alias("c"), F.lit(0.0).alias("total"))
    of = lambda a: F.when(a["c"] > 0, a["c"] * F.log2(a["c"])).otherwise(F.lit(0.0))

    def step(a: Column, b: Column) -> Column:
        same = a["bin"] == b
        return F.struct(b.alias("bin"), F.when(same, a["c"] + 1).otherwise(F.lit(1.0)).alias("c"), F.when(same, a["total"]).otherwise(a["total"] + of(a)).alias("total"))

    return F.log2(F.size(px).cast("double")) - F.aggregate(at, zero, step, lambda a: a["total"] + of(a)) / F.size(px)


def _pixel(px: Column, i: Column, j: Column, height: int, width: int) -> Column:
    """With the border reflected about its outer pixels."""
    inside = lambda k, n: (n - 1) - F.abs((n - 1) - F.abs(k))
    return F.get(px, (inside(i, height) * width + inside(j, width)).cast("int"))


def stencil(px: Column, weights: dict[tuple[int, int], float], height: int, width: int) -> Column:
    """Correlation of the image with a small kernel, given as weights by offset of row and column."""

    def of(own: Column) -> Column:
        def at(k: Column) -> Column:
            i, j = F.floor(k / width), k % width
            total = F.lit(0.0)
            for (di, dj), w in weights.items():
                total = total + F.lit(float(w)) * _pixel(own, i + di, j + dj, height, width)
            return total

        return F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), at)

    return bound(px, of)


SOBEL_X = {(-1, -1): -1, (0, -1): -2, (1, -1): -1, (-1, 1): 1, (0, 1): 2, (1, 1): 1}
SOBEL_Y = {(j, i): w for (i, j), w in SOBEL_X.items()}
LAPLACE = {(0, 0): -4, (-1, 0): 1, (1, 0): 1, (0, -1): 1, (0, 1): 1}
GAUSS = {(i - 2, j - 2): a * b / 256 for i, a in enumerate((1, 4, 6, 4, 1)) for j, b in enumerate((1, 4, 6, 4, 1))}


def magnitude(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: F.sqrt(a * a + b * b))


def sobel(px: Column, height: int, width: int) -> Column:
    return magnitude(stencil(px, SOBEL_X, height, width), stencil(px, SOBEL_Y, height, width))


def slopes(px: Column, height: int, width: int, down: bool) -> Column:
    """Central differences along rows or columns, one-sided at the border."""
    n, step = (height, width) if down else (width, 1)

    def of(own: Column) -> Column:
        def at(k: Column) -> Column:
            place = F.floor(k / width) if down else k % width
            before, after = F.greatest(place - 1, F.lit(0)), F.least(place + 1, F.lit(n - 1))
            value = lambda p: F.get(own, (k + (p - place) * step).cast("int"))
            return (value(after) - value(before)) / F.greatest(after - before, F.lit(1))

        return F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), at)

    return bound(px, of)


def central_magnitude(px: Column, height: int, width: int) -> Column:
    return magnitude(slopes(px, height, width, True), slopes(px, height, width, False))


def central_sharpness(px: Column, height: int, width: int) -> Column:
    """Variance of the Laplacian made of central differences twice."""
    twice = lambda down: slopes(slopes(px, height, width, down), height, width, down)
    return variance(F.zip_with(twice(True), twice(False), lambda a, b: a + b))


def interior_sharpness(px: Column, height: int, width: int) -> Column:
    """Variance of the five-point Laplacian over pixels with four neighbours."""
    inside = lambda k: (F.floor(k / width) > 0) & (F.floor(k / width) < height - 1) & (k % width > 0) & (k % width < width - 1)
    return variance(F.filter(stencil(px, LAPLACE, height, width), lambda x, k: inside(k)))


def share_above(values: Column, least: Column, strict: bool) -> Column:
    return F.size(F.filter(values, lambda v: v > least if strict else v >= least)) / F.size(values)


def _levels(e: Column) -> dict[str, Column]:
    """From sorted pixels r, their mean m and deviation sd."""
    r, m, sd = e["r"], e["m"], e["sd"]
    low, high, cv = F.get(r, F.lit(0)), F.element_at(r, -1), sd / (m + EPS)
    out = {"min_intensity": low, "max_intensity": high, "mean_intensity": m, "std_intensity": sd, "median_intensity": ranked_quantile(r, 0.5), "dynamic_range": high - low}
    out |= {f"p{p}": ranked_quantile(r, p / 100) for p in (1, 5, 25, 50, 75, 95, 99)}
    return out | {"coefficient_variation": cv, "contrast_std": sd, "rms_contrast": cv, "uniformity": 1 / (1 + cv)}


def _struct(columns: dict[str, Column]) -> Column:
    return F.struct(*(c.alias(k) for k, c in columns.items()))


def _sorted(own: Column) -> dict[str, Column]:
    return {"r": F.array_sort(own), "m": mean(own), "sd": F.sqrt(variance(own))}


def intensity(px: Column) -> Column:
    """What an image's levels alone give, as one struct."""
    return bound(bound(px, lambda own: _struct(_sorted(own))), lambda e: _struct(_levels(e)))


def record(px: Column, height: int, width: int) -> Column:
    """All of an image's own features but Canny edges (``edges.canny_density``) as one struct; what several need is made once."""

    def shared(own: Column) -> Column:
        noise = F.zip_with(own, stencil(own, GAUSS, height, width), lambda a, b: a - b)
        return _struct(_sorted(own) | {"g": sobel(own, height, width), "noise": F.sqrt(variance(noise)), "lap": variance(stencil(own, LAPLACE, height, width)), "entropy": entropy(own)})

    def features(e: Column) -> Column:
        g = e["g"]
        out = {"height": F.lit(height), "width": F.lit(width)} | _levels(e) | {"entropy": e["entropy"]}
        out |= {"gradient_mean": mean(g), "gradient_std": F.sqrt(variance(g)), "gradient_max": F.array_max(g)}
        return _struct(out | {"sharpness_laplacian": e["lap"], "speckle_proxy": e["noise"] / (e["m"] + EPS)})

    return bound(bound(px, shared), features)


def measured(df: DataFrame, px: str, height: int, width: int) -> DataFrame:
    """df with a column for each of an image's own features."""
    return df.withColumn("__r", record(F.col(px), height, width)).select(*df.columns, "__r.*")
