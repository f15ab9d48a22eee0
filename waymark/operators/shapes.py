"""Shapes that need loops over points: hulls, clips, bands, grouping, simplifying, projecting. In numpy, for ``applyInPandas``.

Rings are arrays of (x, y) without the closing point. Each function works on one ring or one area's points; the
DataFrame forms deal one key to a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.stage import spread

Ring = np.ndarray
RINGS = "struct<x:double,y:double>"


def signed_area(ring: Ring) -> float:
    """Positive if the ring runs anticlockwise."""
    if len(ring) < 3:
        return 0.0
    a, b = ring, np.roll(ring, -1, axis=0)
    return float(np.sum(a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1]) / 2)


def area(ring: Ring) -> float:
    return abs(signed_area(ring))


def hull(points: Ring) -> Ring:
    """The convex hull, anticlockwise from the least point (K7): points sorted once, each half kept turning left."""
    pts = np.unique(np.asarray(points, float), axis=0)
    if len(pts) < 3:
        return pts

    def half(order: Ring) -> list:
        kept: list = []
        for p in order:
            while len(kept) > 1:
                u, v = kept[-1] - kept[-2], p - kept[-2]
                if u[0] * v[1] - u[1] * v[0] > 0:
                    break
                kept.pop()
            kept.append(p)
        return kept[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def clip(ring: Ring, a: float, b: float, c: float) -> Ring:
    """The part of a ring where ``a x + b y >= c`` (K8)."""
    if not len(ring):
        return ring
    d = ring @ np.array([a, b]) - c
    out = []
    for i in range(len(ring)):
        j = (i + 1) % len(ring)
        if d[i] >= 0:
            out.append(ring[i])
        if (d[i] >= 0) != (d[j] >= 0):
            out.append(ring[i] + (ring[j] - ring[i]) * (d[i] / (d[i] - d[j])))
    return np.array(out).reshape(-1, 2)


def bands(ring: Ring, parts: int, axis: tuple[float, float], rounds: int = 60) -> list[Ring]:
    """A ring in ``parts`` of equal area across an axis (K9), each cut found by halving the interval it lies in."""
    ux, uy = np.array(axis) / math.hypot(*axis)
    at = ring @ np.array([ux, uy])
    whole, cuts = area(ring), [float(at.min())]
    for k in range(1, parts):
        lo, hi = cuts[-1], float(at.max())
        for _ in range(rounds):
            mid = (lo + hi) / 2
            if area(clip(ring, -ux, -uy, -mid)) < whole * k / parts:
                lo = mid
            else:
                hi = mid
        cuts.append((lo + hi) / 2)
    return cut_along(ring, axis, cuts[1:])


def cut_along(ring: Ring, axis: tuple[float, float], cuts: Sequence[float]) -> list[Ring]:
    """The parts of a ring between cuts across an axis."""
    ux, uy = np.array(axis) / math.hypot(*axis)
    out = []
    for lo, hi in zip([-np.inf, *cuts], [*cuts, np.inf], strict=True):
        part = ring
        if np.isfinite(lo):
            part = clip(part, ux, uy, lo)
        if np.isfinite(hi):
            part = clip(part, -ux, -uy, -hi)
        out.append(part)
    return out


def aspect(ring: Ring, axis: tuple[float, float]) -> float:
    """Length to width in an axis's frame; 1 is square."""
    u = np.array(axis) / math.hypot(*axis)
    if not len(ring):
        return math.inf
    spans = [np.ptp(ring @ v) for v in (u, np.array([-u[1], u[0]]))]
    return max(spans) / min(spans) if min(spans) > 0 else math.inf


def axis_of(points: Ring) -> tuple[float, float]:
    """The direction of most spread."""
    (sxx, sxy), (_, syy) = np.cov(points.T, bias=True)
    t = 0.5 * math.atan2(2 * sxy, sxx - syy)
    return math.cos(t), math.sin(t)


def valley_cuts(points: Ring, axis: tuple[float, float], parts: int, bins: int = 64, smooth: int = 5, reach: int = 3) -> list[float]:
    """Cuts where points are sparse, near their quantiles along an axis."""
    at = points @ (np.array(axis) / math.hypot(*axis))
    n, edge = np.histogram(at, bins)
    mean = np.array([n[max(0, i - smooth) : i + smooth + 1].mean() for i in range(bins)])
    run = np.cumsum(n)
    out = []
    for k in range(1, parts):
        i = int(np.searchsorted(run, run[-1] * k / parts))
        near = range(max(0, i - reach), min(bins, i + reach + 1))
        j = min(near, key=lambda b: (mean[b], abs(b - i), b))
        out.append(float(edge[j] + edge[j + 1]) / 2)
    return sorted(out)


def density_split(ring: Ring, points: Ring, parts: int) -> list[Ring]:
    """A ring cut at valleys of its points along the axis, or across it, whichever leaves the better worst shape."""
    u = axis_of(points)
    tried = []
    for axis in (u, (-u[1], u[0])):
        pieces = cut_along(ring, axis, valley_cuts(points, axis, parts))
        tried.append((max(aspect(p, axis) for p in pieces), pieces))
    return min(tried, key=lambda t: t[0])[1]


def balanced(sizes: Sequence[float], parts: int, rounds: int = 200) -> list[int]:
    """A group for each size so that sums are even (K11): largest first to the least sum, then swaps and moves that lower the spread."""
    sums, group = [0.0] * parts, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        g = min(range(parts), key=lambda g: (sums[g], g))
        group[i] = g
        sums[g] += sizes[i]
    for _ in range(rounds):
        hi, lo = max(range(parts), key=lambda g: sums[g]), min(range(parts), key=lambda g: sums[g])
        gap = sums[hi] - sums[lo]
        moves = [(abs(gap - 2 * sizes[i]), i, None) for i in range(len(sizes)) if group[i] == hi]
        moves += [(abs(gap - 2 * (sizes[i] - sizes[j])), i, j) for i in range(len(sizes)) if group[i] == hi for j in range(len(sizes)) if group[j] == lo and sizes[i] > sizes[j]]
        if not moves or (best := min(moves, key=lambda m: m[0]))[0] >= gap - 1e-12:
            break
        _, i, j = best
        group[i] = lo
        if j is not None:
            group[j] = hi
        change = sizes[i] - (sizes[j] if j is not None else 0)
        sums[hi] -= change
        sums[lo] += change
    return group


def lasting(ring: Ring, least: float = 0.0) -> np.ndarray:
    """For each point, the tolerance from which on :func:`simplified` drops it; 0 for those that ``least`` drops."""
    if len(ring) < 4:
        return np.full(len(ring), np.inf)
    far = int(np.argmax(np.hypot(*(ring - ring[0]).T)))
    closed = np.vstack([ring, ring[:1]])
    until = np.zeros(len(closed))
    until[[0, far, -1]] = np.inf
    todo = [(0, far, np.inf), (far, len(closed) - 1, np.inf)]
    while todo:
        a, b, above = todo.pop()
        if b - a < 2:
            continue
        d = to_segment(closed[a + 1 : b], closed[a], closed[b])
        top = min(above, float(d.max()))
        if top > least:
            m = a + 1 + int(d.argmax())
            until[m] = top
            todo += [(a, m, top), (m, b, top)]
    return until[:-1]


def simplified(ring: Ring, tolerance: float) -> Ring:
    """A ring of the points that lie farther than ``tolerance`` from the line between kept ones."""
    return ring[lasting(ring, tolerance) > tolerance]


def to_segment(points: Ring, a: Ring, b: Ring) -> np.ndarray:
    along = b - a
    n = float(along @ along)
    t = np.clip(((points - a) @ along) / n, 0, 1) if n else np.zeros(len(points))
    return np.hypot(*(points - a - t[:, None] * along).T)


def hausdorff(a: Ring, b: Ring) -> float:
    """The larger of the farthest distances from one ring's points to the other's sides; infinite if a ring is empty (T17: fails closed)."""
    if not len(a) or not len(b):
        return math.inf

    return max(_far(a, b), _far(b, a))


def _far(p: Ring, q: Ring) -> float:
    """The farthest distance from a point of ``p`` to the nearest side of ``q``: many points and sides at once."""
    along = np.roll(q, -1, axis=0) - q
    n = (along**2).sum(axis=1)
    out, step = 0.0, max(1, 100_000 // len(q))
    for i in range(0, len(p), step):
        x, y = p[i : i + step, :1] - q[:, 0], p[i : i + step, 1:] - q[:, 1]
        t = np.clip((x * along[:, 0] + y * along[:, 1]) / np.where(n > 0, n, 1), 0, 1)
        out = max(out, float(((x - t * along[:, 0]) ** 2 + (y - t * along[:, 1]) ** 2).min(axis=1).max()))
    return math.sqrt(out)


def within_budget(ring: Ring, size_of: Callable[[Ring], int], budget: int, farthest: float = 5.0, most: float = 50.0, rounds: int = 12) -> Ring:
    """The ring simplified as little as fits the budget, never farther than ``farthest`` from the original (K16); if both can't
    be had, the smallest that stays near enough."""
    if (least := size_of(ring)) <= budget:
        return ring
    lo, hi, best, until = 0.0, most, ring, lasting(ring)
    for _ in range(rounds):
        mid = (lo + hi) / 2
        tried = ring[until > mid]
        if len(tried) < 3 or _far(ring, tried) > farthest:  # the way back is none: its points are the ring's
            hi = mid
        elif (size := size_of(tried)) <= budget:
            best, least, hi = tried, size, mid
        else:
            best, least, lo = (tried, size, mid) if size < least else (best, least, mid)
    return best


def largest(rings: Sequence[Ring]) -> Ring:
    return max(rings, key=area)


#: GRS80 and the transverse Mercator grid of EPSG:2193.
_A, _FLAT, _LON0, _LAT0, _K0, _E0, _N0 = 6_378_137.0, 1 / 298.257222101, 173.0, 0.0, 0.9996, 1_600_000.0, 10_000_000.0


def to_grid(lonlat: Ring) -> Ring:
    """Metres east and north on the grid (K19), by the Krüger series to the fourth order."""
    n = _FLAT / (2 - _FLAT)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    )
    lam, phi = np.radians(lonlat[:, 0] - _LON0), np.radians(lonlat[:, 1])
    e = 2 * math.sqrt(n) / (1 + n)
    t = np.sinh(np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi)))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
    x = eta + sum(a * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, a in enumerate(series, 1))
    y = xi + sum(a * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, a in enumerate(series, 1))
    return np.stack([_E0 + _K0 * radius * x, _N0 + _K0 * radius * y], axis=1)


def hulls(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """The hull of each key's points: ``key``, ``place``, ``x``, ``y``.

    A point that is no hull point of its own part is none of the whole, so parts are thinned in a first round and no task
    gets all points of a large key.
    """
    def thin(group: pd.DataFrame) -> pd.DataFrame:
        ring = hull(group[["x", "y"]].to_numpy())
        return pd.DataFrame({"key": group["key"].iloc[0], "place": np.arange(len(ring)), "x": ring[:, 0], "y": ring[:, 1]})

    p = points.select(F.col(key).cast("string").alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    schema = "key string, place long, x double, y double"
    parts = p.withColumn("part", F.pmod(F.xxhash64("x", "y"), F.lit(64))).groupBy("key", "part").applyInPandas(thin, schema)
    return parts.groupBy("key").applyInPandas(thin, schema)


def banded(points: DataFrame, key: str, x: str, y: str, parts: int) -> DataFrame:
    """Each key's hull in ``parts`` of equal area across the axis of most spread (K9): ``key``, ``band``, ``ring``. The axis is an
    aggregate (D20) and the hull is thinned first, so no task gets all points of a key."""
    p = points.select(F.col(key).cast("string").alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    spread = p.groupBy("key").agg(F.var_pop("x").alias("sxx"), F.covar_pop("x", "y").alias("sxy"), F.var_pop("y").alias("syy"))
    angle = 0.5 * F.atan2(2 * F.col("sxy"), F.col("sxx") - F.col("syy"))
    ringed = hulls(p, "key", "x", "y").join(spread.select("key", angle.alias("angle")), "key")

    def cut(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("place")
        ring, t = g[["x", "y"]].to_numpy(), float(g["angle"].iloc[0])
        pieces = bands(ring, parts, (math.cos(t), math.sin(t))) if len(ring) > 2 else []
        return pd.DataFrame({"key": [g["key"].iloc[0]] * len(pieces), "band": np.arange(len(pieces), dtype=np.int64), "ring": [[{"x": float(a), "y": float(b)} for a, b in r] for r in pieces]})

    return ringed.groupBy("key").applyInPandas(cut, f"key string, band long, ring array<{RINGS}>")


def reduced(areas: DataFrame, size_of: Callable[[Ring], int], budget: int, farthest: float = 5.0, most: float = 50.0) -> DataFrame:
    """Areas (``name``, ``ring``, in metres) whose rings are simplified to ``budget`` bytes (K16), with ``bytes`` and the ``distance`` from the
    original."""

    def work(batches):
        for batch in batches:
            rows = []
            for name, held in zip(batch["name"], batch["ring"], strict=True):
                ring = np.array([(p["x"], p["y"]) for p in held], float).reshape(-1, 2)
                new = within_budget(ring, size_of, budget, farthest, most)
                rows.append((name, [{"x": float(a), "y": float(b)} for a, b in new], size_of(new), 0.0 if len(new) == len(ring) else hausdorff(ring, new)))
            yield pd.DataFrame(rows, columns=["name", "ring", "bytes", "distance"])

    return spread(areas.select("name", "ring")).mapInPandas(work, f"name string, ring array<{RINGS}>, bytes long, distance double")
