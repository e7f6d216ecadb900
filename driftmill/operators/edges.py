"""Edge detectors that iterate over an image: Canny with hysteresis, and hashes of its spectrum. Arrow functions over pixel arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf


def _neighbours(x: np.ndarray, mode: str) -> np.ndarray:
    return np.pad(x, 1, mode=mode)


def canny(image: np.ndarray, low: float, high: float) -> np.ndarray:
    """Edge pixels of an 8-bit image: Sobel gradients with a repeated border, L1 norm, suppression along the gradient's sector.

    A pixel above low that is no smaller than its two neighbours across the edge is a candidate (it must exceed the first
    one); candidates above high are edges, and so are those that touch an edge.
    """
    p = _neighbours(image.astype(np.int64), "edge")
    at = lambda i, j: p[1 + i : p.shape[0] - 1 + i, 1 + j : p.shape[1] - 1 + j]
    dx = at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)
    dy = at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)
    size = np.abs(dx) + np.abs(dy)
    m = np.pad(size, 1)
    of = lambda i, j: m[1 + i : m.shape[0] - 1 + i, 1 + j : m.shape[1] - 1 + j]
    # sectors by the tangents of 22.5 and 67.5 degrees
    flat = np.abs(dy) < np.abs(dx) * 0.4142135623730951
    steep = np.abs(dy) > np.abs(dx) * 2.414213562373095
    along_x = (size > of(0, -1)) & (size >= of(0, 1))
    along_y = (size > of(-1, 0)) & (size >= of(1, 0))
    falling = (dx < 0) != (dy < 0)
    diagonal = np.where(falling, (size > of(-1, 1)) & (size > of(1, -1)), (size > of(-1, -1)) & (size > of(1, 1)))
    candidate = (size > low) & np.where(flat, along_x, np.where(steep, along_y, diagonal))
    edge = candidate & (size > high)
    while True:
        e = _neighbours(edge, "constant")
        touched = candidate & np.logical_or.reduce([e[1 + i : e.shape[0] - 1 + i, 1 + j : e.shape[1] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1)])
        if (touched == edge).all():
            return edge
        edge = touched


def adaptive_thresholds(image: np.ndarray) -> tuple[float, float]:
    """0.66 and 1.33 times the median, the upper one up to 255, and one above the lower if it isn't above it otherwise."""
    middle = float(np.median(image))
    low, high = 0.66 * middle, min(255.0, 1.33 * middle)
    return low, high if high > low else min(255.0, low + 1)


def each_image(px: Column, width: int, kind: str, one) -> Column:
    """one of every image as a matrix; null for null. px is a column of the table, whose size must be a multiple of width.

    The size goes along as an argument of its own: an expression with lambdas that is used once would be moved into the
    function's argument, where Spark doesn't evaluate it.
    """

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for values, sizes in batches:
            if any(n is not None and n % width for n in sizes.to_pylist()):
                raise ValueError(f"an image isn't {width} pixels wide")
            yield pa.array([None if x is None else one(np.asarray(x, float).reshape(-1, width)) for x in values.to_pylist()])

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return arrow_udf(run, kind)(px, F.size(px))


def _bytes(image: np.ndarray) -> np.ndarray:
    return np.clip(image * 255, 0, 255).astype(np.uint8)


#: What ``features`` gives, in order.
FEATURES = ("mean_intensity", "std_intensity", "dynamic_range", "entropy", "sharpness_laplacian", "noise", "edge_density", "gradient_mean", "gradient_std", "gradient_max", "slope", "near", "far", "row_mean", "row_std")


def features(image: np.ndarray, canny_too: bool = True) -> dict[str, float]:
    """The numbers of an image that a signature is made of; slope is that of the logarithms of row medians over a depth of 1."""
    p = np.pad(image, 2, mode="reflect")
    h, w = image.shape
    at = lambda i, j: p[2 + i : 2 + i + h, 2 + j : 2 + j + w]
    g = np.hypot(at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1), at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1))
    lap = at(-1, 0) + at(1, 0) + at(0, -1) + at(0, 1) - 4 * image
    taps = (1, 4, 6, 4, 1)
    down = sum(c * p[k : k + h] for k, c in enumerate(taps)) / 16
    smooth = sum(c * down[:, k : k + w] for k, c in enumerate(taps)) / 16
    counts = np.bincount(np.minimum((image * 256).astype(np.int64), 255).ravel())
    share = counts[counts > 0] / image.size
    rows = np.median(np.clip(image, 0, 1), axis=1)
    depth = np.arange(h) - (h - 1) / 2
    slope = float((depth * np.log(np.maximum(rows, 1e-4))).sum() / (depth**2).sum() * (h - 1)) if h > 1 else float("nan")
    quarter = max(1, h // 4)
    edge = float(canny(_bytes(image), 50, 150).mean()) if canny_too else float("nan")
    own = (image.mean(), image.std(), image.max() - image.min(), -(share * np.log2(share)).sum(), lap.var(), (image - smooth).std(), edge, g.mean(), g.std(), g.max(), slope, rows[:quarter].mean(), rows[-quarter:].mean(), rows.mean(), rows.std())
    return dict(zip(FEATURES, map(float, own)))


def measured(px: Column, width: int, canny_too: bool = True) -> Column:
    """``features`` of every image as a struct: stencils and hysteresis over whole matrices, which expressions would go through pixel by pixel."""
    return each_image(px, width, f"struct<{','.join(f'{f}:double' for f in FEATURES)}>", lambda x: features(x, canny_too))


def canny_density(px: Column, width: int, low: float | None = 50.0, high: float | None = 150.0) -> Column:
    """Share of edge pixels of an image in [0, 1]; thresholds from its median where low is None."""

    def one(image: np.ndarray) -> float:
        own = _bytes(image)
        return float(canny(own, *(adaptive_thresholds(own) if low is None else (low, high))).mean())

    return each_image(px, width, "double", one)


def spectrum(n: int) -> np.ndarray:
    """The matrix of the discrete cosine transform of n values."""
    k, x = np.arange(n)[:, None], np.arange(n)[None]
    out = np.sqrt(2 / n) * np.cos(np.pi * (2 * x + 1) * k / (2 * n))
    out[0] /= np.sqrt(2)
    return out


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """By area: a new pixel is the mean of what it covers."""

    def shares(old: int, new: int) -> np.ndarray:
        ends = np.linspace(0, old, new + 1)
        over = np.minimum(ends[1:, None], np.arange(1, old + 1)[None]) - np.maximum(ends[:-1, None], np.arange(old)[None])
        return np.clip(over, 0, None) * new / old

    return shares(image.shape[0], height) @ image @ shares(image.shape[1], width).T


def perceptual_hash(px: Column, width: int) -> Column:
    """64 bits of an image: which of the 8 by 8 lowest frequencies of it at 32 by 32 exceed the median of all but the first."""

    def one(image: np.ndarray) -> int:
        d = spectrum(32)
        low = (d @ resized(image * 255, 32, 32) @ d.T)[:8, :8].ravel()
        return int(np.packbits(low > np.median(low[1:])).view(">i8")[0])

    return each_image(px, width, "bigint", one)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
