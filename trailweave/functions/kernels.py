"""Movement kernels: Gaussian, chi, correlated sets, sector masks, rotation; and the default mappings."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.schemas import ANIMAL_TYPES, LANDCOVER


@dataclass(frozen=True)
class KernelParams:
    """Parameters of one class; ``diffusity`` 1 is a standard deviation of half the step size."""

    is_brownian: bool = True
    S: int = 3
    D: int = 1
    diffusity: float = 1.0
    bias_x: int = 0
    bias_y: int = 0
    forbidden: bool = False


def offsets(S: int) -> np.ndarray:
    """``(dy, dx)`` of a kernel's cells in row order."""
    r = np.arange(-S, S + 1)
    return np.stack(np.meshgrid(r, r, indexing="ij"), -1).reshape(-1, 2)


def gaussian(S: int, sigma: float | None = None, bias_x: int = 0, bias_y: int = 0, floor: float = 0.0) -> np.ndarray:
    """A normalised Gaussian of width ``2S + 1``; ``sigma`` is ``S / 2`` if not given, ``floor`` at least."""
    sigma = max(floor, S / 2 if sigma is None else sigma)
    if sigma <= 0:
        raise ValueError("sigma must be positive")
    r = np.arange(-S, S + 1)
    w = np.exp(-((r[:, None] - bias_y) ** 2 + (r[None, :] - bias_x) ** 2) / (2 * sigma**2))
    return w / w.sum()


def from_array(values, S: int) -> np.ndarray:
    """A kernel of the user's, normalised; its shape must be ``(2S + 1, 2S + 1)``."""
    w = np.asarray(values, float)
    if w.shape != (2 * S + 1, 2 * S + 1) or (w < 0).any() or w.sum() <= 0:
        raise ValueError(f"a kernel must be {2 * S + 1} cells square, not negative, with a positive sum")
    return w / w.sum()


def chi(S: int, k: int = 2, subsamples: int = 4) -> np.ndarray:
    """Weights by the chi density of the distance at scale ``S / 2``, none beyond ``S``."""
    return correlated(1, S, kappa=0.0, k=k, subsamples=subsamples)[0]


@lru_cache(maxsize=256)
def _correlated(D: int, S: int, kappa: float, k: int, subsamples: int) -> np.ndarray:
    sub = (np.arange(subsamples) + 0.5) / subsamples - 0.5
    r = (np.arange(-S, S + 1)[:, None] + sub).ravel()
    y, x = np.meshgrid(r, r, indexing="ij")
    dist, angle = np.hypot(x, y), np.arctan2(y, x)
    z = dist / max(S / 2, 1e-9)
    radial = np.where(dist <= S, z ** (k - 1) * np.exp(-z * z / 2), 0.0)
    out = []
    for d in range(D):
        w = radial * np.exp(kappa * (np.cos(angle - 2 * math.pi * d / D) - 1))
        w = w.reshape(2 * S + 1, subsamples, 2 * S + 1, subsamples).sum((1, 3))
        out.append(w / w.sum())
    return np.array(out)


def correlated(D: int, S: int, kappa: float = 2.0, k: int = 2, subsamples: int = 4) -> np.ndarray:
    """``D`` kernels, the d-th leaning to direction ``d * 360 / D``."""
    if D < 1 or S < 1:
        raise ValueError("D and S must be positive")
    return _correlated(D, S, kappa, k, subsamples)


def rotate(kernel: np.ndarray, degrees: float) -> np.ndarray:
    """The kernel turned about its centre, bilinear, normalised."""
    S = kernel.shape[0] // 2
    a = math.radians(degrees)
    dy, dx = offsets(S).T
    x, y = math.cos(a) * dx + math.sin(a) * dy + S, -math.sin(a) * dx + math.cos(a) * dy + S
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    out = np.zeros(len(x))
    for j in (0, 1):
        for i in (0, 1):
            w = np.abs(1 - i - (x - x0)) * np.abs(1 - j - (y - y0))
            inside = (x0 + i >= 0) & (x0 + i <= 2 * S) & (y0 + j >= 0) & (y0 + j <= 2 * S)
            out[inside] += w[inside] * kernel[y0[inside] + j, x0[inside] + i]
    out = np.maximum(out, 0).reshape(kernel.shape)
    return out / out.sum() if out.sum() > 0 else kernel


def correlated_from(base: np.ndarray, D: int) -> np.ndarray:
    """``D`` turned copies of a base kernel, which must be square and of odd width."""
    base = np.asarray(base, float)
    if base.ndim != 2 or base.shape[0] != base.shape[1] or base.shape[0] % 2 == 0:
        raise ValueError("a base kernel must be square and of odd width")
    return np.array([rotate(base, 360.0 * d / D) for d in range(D)])


def upsample(kernel: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear resize."""
    y = np.linspace(0, kernel.shape[0] - 1, height)
    x = np.linspace(0, kernel.shape[1] - 1, width)
    rows = np.array([np.interp(x, np.arange(kernel.shape[1]), r) for r in kernel])
    return np.array([np.interp(y, np.arange(kernel.shape[0]), c) for c in rows.T]).T


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Elementwise product."""
    if a.shape != b.shape:
        raise ValueError("kernels of different shapes")
    return a * b


def scaled(kernel: np.ndarray, factor: float) -> np.ndarray:
    """The kernel divided by a factor."""
    if factor == 0:
        raise ValueError("the factor is 0")
    return kernel / factor


def combine_into(a: np.ndarray, b: np.ndarray) -> None:
    """Elementwise product, kept in ``a``."""
    a[...] = combine(a, b)


def rotate_about(kernel: np.ndarray, degrees: float, cy: float, cx: float) -> np.ndarray:
    """The kernel turned about a cell, bilinear, not normalised; what is turned out of it is lost."""
    h, w = kernel.shape
    a = math.radians(degrees)
    y, x = (g.ravel().astype(float) for g in np.meshgrid(np.arange(h), np.arange(w), indexing="ij"))
    sx, sy = math.cos(a) * (x - cx) + math.sin(a) * (y - cy) + cx, -math.sin(a) * (x - cx) + math.cos(a) * (y - cy) + cy
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    out = np.zeros(h * w)
    for j in (0, 1):
        for i in (0, 1):
            part = np.abs(1 - i - (sx - x0)) * np.abs(1 - j - (sy - y0))
            inside = (x0 + i >= 0) & (x0 + i < w) & (y0 + j >= 0) & (y0 + j < h)
            out[inside] += part[inside] * kernel[y0[inside] + j, x0[inside] + i]
    return out.reshape(h, w)


def tensor(D: int, height: int, width: int, value: float = 0.0) -> np.ndarray:
    """``D`` matrices of one value."""
    if min(D, height, width) < 1:
        raise ValueError("sizes must be positive")
    return np.full((D, height, width), value)


def in_bounds(kernel: np.ndarray, *at: int) -> bool:
    """Whether a place ``(y, x)`` or ``(d, y, x)`` is in a matrix or tensor."""
    return len(at) == kernel.ndim and all(0 <= i < n for i, n in zip(at, kernel.shape, strict=True))


def with_matrix(base: np.ndarray, d: int, matrix: np.ndarray) -> np.ndarray:
    """A tensor with one of its matrices replaced."""
    if not 0 <= d < len(base) or matrix.shape != base.shape[1:]:
        raise ValueError("no such matrix, or one of another shape")
    out = base.copy()
    out[d] = matrix
    return out


def _cut(polygon: list[tuple[float, float]], nx: float, ny: float) -> list[tuple[float, float]]:
    out = []
    for (x0, y0), (x1, y1) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        a, b = nx * x0 + ny * y0, nx * x1 + ny * y1
        if a >= 0:
            out.append((x0, y0))
        if (a > 0 > b) or (a < 0 < b):
            s = a / (a - b)
            out.append((x0 + s * (x1 - x0), y0 + s * (y1 - y0)))
    return out


@lru_cache(maxsize=256)
def sector_masks(D: int, S: int) -> np.ndarray:
    """``(D, 2S + 1, 2S + 1)``: the part of each cell's area inside the wedge of 180/D degrees about each direction."""
    out = np.zeros((D, 2 * S + 1, 2 * S + 1))
    if D == 1:
        return out + 1
    for d in range(D):
        lo, hi = 2 * math.pi * (d - 0.5) / D, 2 * math.pi * (d + 0.5) / D
        for dy, dx in offsets(S):
            square = [(dx - 0.5, dy - 0.5), (dx + 0.5, dy - 0.5), (dx + 0.5, dy + 0.5), (dx - 0.5, dy + 0.5)]
            part = _cut(square, -math.sin(lo), math.cos(lo))
            if D > 2 and part:
                part = _cut(part, math.sin(hi), -math.cos(hi))
            area = sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(part, part[1:] + part[:1], strict=True)) / 2
            out[d, dy + S, dx + S] = abs(area)
    return out / out.sum(0)


@lru_cache(maxsize=1024)
def kernels_of(p: KernelParams, kappa: float = 2.0) -> np.ndarray:
    """The kernels of a class, one for each direction."""
    if p.is_brownian:
        return gaussian(p.S, p.diffusity * p.S / 2, p.bias_x, p.bias_y)[None]
    base = correlated(p.D, p.S, kappa)
    if p.bias_x or p.bias_y:
        moved = np.zeros_like(base)
        for dy, dx in offsets(p.S):
            y, x = dy - p.bias_y, dx - p.bias_x
            if abs(y) <= p.S and abs(x) <= p.S:
                moved[:, dy + p.S, dx + p.S] = base[:, y + p.S, x + p.S]
        base = moved / moved.sum((1, 2), keepdims=True)
    return base


def default_mapping(preset: str = "mixed", animal: str = "MEDIUM", S: int = 7) -> dict[int, KernelParams]:
    """Parameters of every landcover class.

    ``brownian``: one direction everywhere; ``correlated``: eight; ``mixed``:
    eight in open classes, one elsewhere.  Airborne animals cross all,
    amphibians no snow, others no water.
    """
    if preset not in ("mixed", "brownian", "correlated") or animal not in ANIMAL_TYPES or S < 1:
        raise ValueError("unknown preset or animal type, or a step that isn't positive")
    closed = {"AIRBORNE": set(), "AMPHIBIAN": {70}}.get(animal, {80})
    out = {}
    for cls in LANDCOVER:
        straight = preset == "correlated" or preset == "mixed" and cls in (30, 40, 60, 100)
        out[cls] = KernelParams(not straight, S, 8 if straight else 1, forbidden=cls in closed)
    return out


def with_class(mapping: dict[int, KernelParams], cls: int, **params) -> dict[int, KernelParams]:
    """The mapping with one class changed; a Brownian class has one direction."""
    if cls not in LANDCOVER:
        raise ValueError(f"{cls} is no landcover class")
    new = replace(mapping[cls], **params)
    return mapping | {cls: replace(new, D=1) if new.is_brownian else new}


def forbid(mapping: dict[int, KernelParams], cls: int) -> dict[int, KernelParams]:
    return with_class(mapping, cls, forbidden=True)


def mapping_frame(spark: SparkSession, mapping: dict[int, KernelParams]) -> DataFrame:
    """The mapping as a table of one row a class."""
    rows = [(c, p.forbidden, p.is_brownian, p.S, p.D, float(p.diffusity), p.bias_x, p.bias_y) for c, p in sorted(mapping.items())]
    return spark.createDataFrame(rows, "cls int, forbidden boolean, is_brownian boolean, S int, D int, diffusity float, bias_x int, bias_y int")


def gaussian_frame(spark: SparkSession, S: int, sigma: float | None = None) -> DataFrame:
    """``(dy, dx, w)`` of a normalised Gaussian, in columns."""
    s = S / 2 if sigma is None else sigma
    side = spark.range(-S, S + 1).withColumnRenamed("id", "dy").crossJoin(spark.range(-S, S + 1).withColumnRenamed("id", "dx"))  # (2S + 1)^2 rows
    raw = side.withColumn("g", F.exp(-(F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")) / F.lit(2.0 * s * s)))
    return normalised(raw.withColumn("kernel_id", F.lit(0)), ["kernel_id"], "g").select(F.col("dy").cast("int"), F.col("dx").cast("int"), F.col("g").alias("w"))


def normalised(kernels: DataFrame, keys: list[str], weight: str = "w") -> DataFrame:
    """Weights divided by their sum for each key."""
    total = kernels.groupBy(*keys).agg(F.sum(weight).alias("__total"))
    return kernels.join(total, keys).withColumn(weight, F.col(weight) / F.expr("nullif(__total, 0)")).drop("__total")


def kernel_frame(spark: SparkSession, kernels: np.ndarray) -> DataFrame:
    """``(d, dy, dx, w)`` of a set of kernels."""
    S = kernels.shape[1] // 2
    rows = [(d, int(dy), int(dx), float(kernels[d, dy + S, dx + S])) for d in range(len(kernels)) for dy, dx in offsets(S)]
    return spark.createDataFrame(rows, "d int, dy int, dx int, w double")
