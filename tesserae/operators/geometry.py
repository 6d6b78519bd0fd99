"""Camera geometry: pixels to points and back, alignment, directions; and images and masks as arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the geometry.
MAX_DEPTH, HIDDEN = 10.0, (0.05, 0.08)


def backproject(depth: np.ndarray, k: np.ndarray, c2w: np.ndarray, mask: np.ndarray | None = None, most: float = MAX_DEPTH):
    """World points and pixels (v, u) of the depths within (0, most)."""
    ok = (depth > 0) & (depth < most)
    v, u = np.nonzero(ok if mask is None else ok & mask)
    z = depth[v, u].astype(np.float64)
    cam = np.stack([(u - k[0, 2]) * z / k[0, 0], (v - k[1, 2]) * z / k[1, 1], z], axis=1)
    return cam @ c2w[:3, :3].T + c2w[:3, 3], (v, u)


def backproject_columns(u: Column, v: Column, z: Column, k: tuple, c2w: tuple) -> list[Column]:
    """World x, y, z of a pixel row; k: (fx, fy, cx, cy), c2w: 12 numbers, rows of the camera-to-world matrix."""
    fx, fy, cx, cy = k
    cam = ((u - F.lit(cx)) * z / F.lit(fx), (v - F.lit(cy)) * z / F.lit(fy), z)
    return [sum((cam[j] * F.lit(c2w[4 * i + j]) for j in range(3)), F.lit(c2w[4 * i + 3])) for i in range(3)]


def project(points: np.ndarray, depth: np.ndarray, k: np.ndarray, c2w: np.ndarray):
    """u, v and whether each point is in the image and not behind the depth there; unseen points have pixel (0, 0)."""
    back = np.linalg.inv(c2w)
    x, y, z = (points @ back[:3, :3].T + back[:3, 3]).T
    safe = np.maximum(z, 1e-6)
    u, v = np.rint(k[0, 0] * x / safe + k[0, 2]), np.rint(k[1, 1] * y / safe + k[1, 2])
    seen = (z > 0.05) & (u >= 0) & (u < depth.shape[1]) & (v >= 0) & (v < depth.shape[0])
    u, v = (np.where(seen, a, 0).astype(int) for a in (u, v))
    there = depth[v, u]
    return u, v, seen & (z <= there + np.maximum(HIDDEN[0], HIDDEN[1] * there))


def erode(mask: np.ndarray, times: int = 2) -> np.ndarray:
    """Erosion by the cross of four neighbours; outside counts as unset."""
    for _ in range(times):
        p = np.pad(mask, 1)
        mask = p[1:-1, 1:-1] & p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]
    return mask


def robust(points: np.ndarray, scale: float = 3.0, least: int = 10) -> np.ndarray:
    """Whether each point is within ``scale`` robust deviations of the median on every axis."""
    if len(points) < least:
        return np.ones(len(points), dtype=bool)
    away = np.abs(points - np.median(points, axis=0))
    return (away <= scale * (1.4826 * np.median(away, axis=0) + 1e-3)).all(axis=1)


def mask_to_box(depth, k, c2w, mask, conf=None, times=2, least=50, scale=3.0):
    """(corners, points, confidence) of a mask's depth, or None for fewer than ``least`` points."""
    small = erode(mask, times)
    points, (v, u) = backproject(depth, k, c2w, small if small.sum() >= least else mask)
    if not len(points):
        return None
    sure = float(np.median(conf[v, u])) if conf is not None else np.nan
    points = points[robust(points, scale)]
    return None if len(points) < least else (np.stack([points.min(axis=0), points.max(axis=0)]), points, sure)


def shrink(mask: np.ndarray, size: tuple[int, int], cover: float = 0.25) -> np.ndarray:
    """Area-weighted (triangle filter) resize of a mask, in two passes of bytes, set where the cover is over a share."""

    def along(a: np.ndarray, n: int) -> np.ndarray:
        scale = a.shape[0] / n
        reach = max(scale, 1.0)
        centre = (np.arange(n) + 0.5) * scale
        w = np.maximum(0, 1 - np.abs((np.arange(a.shape[0])[None, :] + 0.5 - centre[:, None]) / reach))
        return np.floor(w / w.sum(axis=1, keepdims=True) @ a + 0.5)

    bytes_ = along(along(mask.T * 255.0, size[1]).T, size[0])
    return bytes_ > round(cover * 255)


def upsample(image: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Bilinear resize of floats to a larger size, pixel centres aligned, borders held."""

    def along(a: np.ndarray, n: int) -> np.ndarray:
        at = np.clip((np.arange(n) + 0.5) * a.shape[0] / n - 0.5, 0, a.shape[0] - 1)
        low = np.floor(at).astype(int)
        high = np.minimum(low + 1, a.shape[0] - 1)
        share = (at - low).reshape(-1, *[1] * (a.ndim - 1))
        return a[low] * (1 - share) + a[high] * share

    return along(along(image.astype(np.float64), size[0]).swapaxes(0, 1), size[1]).swapaxes(0, 1)


def smooth_depth(depth: np.ndarray, least: float = 0.05) -> np.ndarray:
    """Whether the depths of a pixel and its eight neighbours differ by less than a share: no depth edge."""
    p = np.pad(depth, 1, mode="edge")
    near = np.stack([p[i : i + depth.shape[0], j : j + depth.shape[1]] for i in range(3) for j in range(3)])
    return (near.max(axis=0) - near.min(axis=0)) / np.maximum(depth, 1e-6) < least


def umeyama(src: np.ndarray, dst: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Scale, rotation and translation that map src onto dst with the least squared error."""
    a, b = src - src.mean(axis=0), dst - dst.mean(axis=0)
    u, s, vt = np.linalg.svd(b.T @ a / len(src))
    sign = np.array([1.0, 1.0, np.sign(np.linalg.det(u @ vt))])
    r = (u * sign) @ vt
    scale = float((s * sign).sum() / (a**2).sum() * len(src))
    return scale, r, dst.mean(axis=0) - scale * r @ src.mean(axis=0)


def umeyama_from_sums(pairs: DataFrame) -> tuple[float, np.ndarray, np.ndarray, float]:
    """The same over a table (sx, sy, sz, dx, dy, dz), from its sums and products alone, and the RMS error."""
    s, d = ("sx", "sy", "sz"), ("dx", "dy", "dz")
    exprs = [F.avg(c).alias(c) for c in (*s, *d)]
    exprs += [F.covar_pop(F.col(x), F.col(y)).alias(f"{y}_{x}") for y in d for x in s]
    exprs += [F.var_pop(c).alias(f"v_{c}") for c in (*s, *d)]
    row = pairs.agg(*exprs).collect()[0]  # one row
    cov = np.array([[row[f"{y}_{x}"] for x in s] for y in d])
    u, w, vt = np.linalg.svd(cov)
    sign = np.array([1.0, 1.0, np.sign(np.linalg.det(u @ vt))])
    r = (u * sign) @ vt
    spread = sum(row[f"v_{x}"] for x in s)
    scale = float((w * sign).sum() / spread)
    t = np.array([row[y] for y in d]) - scale * r @ np.array([row[x] for x in s])
    error = sum(row[f"v_{y}"] for y in d) - scale**2 * spread
    return scale, r, t, float(np.sqrt(max(0.0, error)))


def widest_gap_arc(rays: DataFrame, by: str, azimuth: str) -> DataFrame:
    """by, arc: degrees that directions span: the circle less its widest gap; 0 for fewer than two."""
    w = Window.partitionBy(by).orderBy(azimuth)
    first = F.first(azimuth).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    gaps = rays.withColumn("_gap", F.coalesce(F.lead(azimuth).over(w), first + 360) - F.col(azimuth))
    return gaps.groupBy(by).agg(F.when(F.count("*") >= 2, 360 - F.max("_gap")).otherwise(0.0).alias("arc"))


def wall_direction(normals: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """by, angle, strength: the direction of walls at right angles: circular mean of four times the azimuth."""
    four = 4 * F.atan2(F.col(y), F.col(x))
    sums = normals.groupBy(by).agg(F.sum(F.cos(four)).alias("c"), F.sum(F.sin(four)).alias("s"), F.count("*").alias("n"))
    strength = F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")) / F.col("n")
    return sums.select(by, (F.atan2("s", "c") / 4).alias("angle"), strength.alias("strength"))


# Compressed run lengths: column-major runs, background first; from the third on as differences to the run two before;
# groups of five bits from the lowest, bit 5 for more to come, bit 4 of the last as the sign, each offset by 48.


def encode_runs(mask: np.ndarray) -> str:
    """The compressed string of a (height, width) mask."""
    flat = np.concatenate([[False], mask.T.ravel(), [not mask.T.ravel()[-1] if mask.size else True]])
    edges = np.flatnonzero(flat[1:] != flat[:-1])
    runs = np.diff(np.concatenate([[0], edges])).tolist()
    out = []
    for i, n in enumerate(runs):
        x = int(n - runs[i - 2]) if i > 2 else int(n)
        while True:
            low, x = x & 31, x >> 5
            last = (x == 0 and not low & 16) or (x == -1 and low & 16)
            out.append(chr(48 + (low if last else low | 32)))
            if last:
                break
    return "".join(out)


def decode_runs(text: str) -> list[tuple[int, int]]:
    """Half-open intervals (s, e) of set pixels of a compressed string."""
    runs: list[int] = []
    at = 0
    while at < len(text):
        x = shift = 0
        while True:
            c = ord(text[at]) - 48
            at += 1
            x |= (c & 31) << shift
            shift += 5
            if not c & 32:
                break
        if c & 16:
            x -= 1 << shift
        runs.append(x + runs[-2] if len(runs) > 2 else x)
    ends = np.cumsum(runs).tolist()
    return [(ends[i - 1], ends[i]) for i in range(1, len(runs), 2)]
