"""Polygons joined, cut, clipped and widened (K12-K15), in numpy, and these for tables of areas.

Everything goes through one overlay: all sides are cut where they meet, each piece is asked what lies on its left, and the
pieces with the wanted ground on their left only are chained to rings. Rings of the result run anticlockwise round ground
and clockwise round holes.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators import spatial
from waymark.operators.shapes import Ring, signed_area
from waymark.stage import spread

Test = Callable[[np.ndarray], np.ndarray]
#: Coordinates nearer than this share of the extent are one.
SNAP = 1e-11
#: Areas that one overlay joins; more are joined in rounds.
AT_ONCE = 16
_CELLS = 250_000


def holds(ring: Ring, points: np.ndarray) -> np.ndarray:
    """Whether a ring holds each point, by crossings."""
    a, b = ring, np.roll(ring, -1, axis=0)
    x, y = points[:, :1], points[:, 1:]
    out = np.zeros(len(points), bool)
    step = max(1, _CELLS // max(1, len(points)))
    for i in range(0, len(ring), step):
        (x1, y1), (x2, y2) = a[i : i + step].T, b[i : i + step].T
        crosses = (y1 > y) != (y2 > y)
        out ^= (crosses & (x < x1 + (y - y1) * (x2 - x1) / np.where(y2 != y1, y2 - y1, 1))).sum(axis=1) % 2 == 1
    return out


def within(rings: Sequence[Ring]) -> Test:
    """In any of the rings."""
    return lambda points: np.any([holds(r, points) for r in rings], axis=0) if len(rings) else np.zeros(len(points), bool)


def _sides(rings: Sequence[Ring]) -> np.ndarray:
    found = [np.hstack([r, np.roll(r, -1, axis=0)]) for r in rings if len(r) > 2]
    return np.vstack(found) if found else np.zeros((0, 4))


def _merged(values: np.ndarray, unit: float, given: np.ndarray | None = None) -> np.ndarray:
    """Values, those nearer than ``unit`` to the next one made equal: to a ``given`` one, if there is one among them."""
    order = np.argsort(values, kind="stable")
    group = np.cumsum(np.concatenate([[False], np.diff(values[order]) > unit]))
    lead = order if given is None else order[np.lexsort((~given[order], group))]
    out = np.empty_like(values)
    out[order] = values[lead[np.searchsorted(group, np.arange(group[-1] + 1))]][group]
    return out


def _settled(lines: Sequence[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, float]:
    """Rings or lines from their lowest corner on, near coordinates made one; the corner; and what counts as near. What is told
    of their ground is then told of the very sides that are cut, however near two of them lie."""
    flat = np.vstack(lines)
    low = flat.min(axis=0)
    flat = flat - low
    unit = max(float(flat.max()), 1e-300) * SNAP
    flat = np.stack([_merged(flat[:, k], unit) for k in (0, 1)], axis=1)
    return np.split(flat, np.cumsum([len(x) for x in lines])[:-1]), low, unit


def _noded(sides: np.ndarray, unit: float) -> tuple[np.ndarray, np.ndarray]:
    """Places, and the pieces between them (pairs of places, each once), that settled sides fall into where they cross or touch."""
    sides = sides[(sides[:, :2] != sides[:, 2:]).any(axis=1)]
    if not len(sides):
        return np.zeros((0, 2)), np.zeros((0, 2), np.int64)
    p, q = sides[:, :2], sides[:, 2:]
    along, ends = q - p, np.unique(sides.reshape(-1, 2), axis=0)
    length = np.hypot(*along.T)
    slack = unit / np.maximum(length, unit)
    n = len(sides)
    side, at, place, given = [np.arange(n), np.arange(n)], [np.zeros(n), np.ones(n)], [p, q], [np.ones(2 * n, bool)]
    step = max(1, _CELLS // len(ends))
    for i in range(0, n, step):
        u, o, size = along[i : i + step, None], p[i : i + step, None], length[i : i + step, None]
        w = p - o
        cross = u[..., 0] * along[:, 1] - u[..., 1] * along[:, 0]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            t = (w[..., 0] * along[:, 1] - w[..., 1] * along[:, 0]) / cross
            s = (w[..., 0] * u[..., 1] - w[..., 1] * u[..., 0]) / cross
            met = (t > -slack[i : i + step, None]) & (t < 1 + slack[i : i + step, None]) & (s > -slack) & (s < 1 + slack)
        k, _ = np.nonzero(met)
        t = np.clip(t[met], 0, 1)
        side.append(i + k)
        at.append(t)
        place.append(p[i + k] + t[:, None] * along[i + k])
        given.append(np.zeros(len(k), bool))
        # Ends of other sides that lie on this one, which parallel sides share.
        w = ends - o
        f = (w * u).sum(axis=-1) / size**2
        on = (np.abs(w[..., 0] * u[..., 1] - w[..., 1] * u[..., 0]) < unit * size) & (f > 0) & (f < 1)
        k, j = np.nonzero(on)
        side.append(i + k)
        at.append(f[on])
        place.append(ends[j])
        given.append(np.ones(len(k), bool))
    side, known, spot = np.concatenate(side), np.concatenate(given), np.vstack(place)
    spot = np.stack([_merged(spot[:, k], unit, known) for k in (0, 1)], axis=1)
    order = np.lexsort((np.concatenate(at), side))
    places, number = np.unique(spot[order], axis=0, return_inverse=True)
    number, side = number.reshape(-1), side[order]
    pairs = np.stack([number[:-1], number[1:]], axis=1)[(side[:-1] == side[1:]) & (number[:-1] != number[1:])]
    return places, np.unique(np.sort(pairs, axis=1), axis=0)


def _left(places: np.ndarray, half: np.ndarray, unit: float) -> np.ndarray:
    """A point just left of the middle of each directed piece, nearer than any other side may be."""
    a, b = places[half[:, 0]], places[half[:, 1]]
    u = b - a
    normal = np.stack([-u[:, 1], u[:, 0]], axis=1)
    size = np.hypot(*u.T)[:, None]
    return (a + b) / 2 + normal / size * np.minimum(size * 1e-3, unit / 4)


def _chained(places: np.ndarray, half: np.ndarray) -> list[Ring]:
    """Directed pieces to closed rings; where several go on from a place, the one farthest to the left of the way back, turned clockwise."""
    out: dict[int, list[int]] = defaultdict(list)
    for i, (a, _) in enumerate(half.tolist()):
        out[a].append(i)
    u = places[half[:, 1]] - places[half[:, 0]]
    angle = np.arctan2(u[:, 1], u[:, 0])
    used = np.zeros(len(half), bool)
    rings = []
    for first in range(len(half)):
        if used[first]:
            continue
        ring, now = [], first
        while not used[now]:
            used[now] = True
            ring.append(int(half[now, 0]))
            back = angle[now] + math.pi
            open_ = [j for j in out[int(half[now, 1])] if not used[j]]
            if not open_:
                break
            now = min(open_, key=lambda j: (back - angle[j]) % (2 * math.pi) or 2 * math.pi)
        if len(ring) > 2:
            rings.append(places[ring])
    return rings


def _straight(ring: Ring) -> Ring:
    """Without the places in the middle of a straight side."""
    before, after = np.roll(ring, 1, axis=0), np.roll(ring, -1, axis=0)
    u, v = ring - before, after - ring
    bend = np.abs(u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
    kept = ring[bend > 1e-7 * np.maximum(np.hypot(*u.T) * np.hypot(*v.T), 1e-300)]
    return kept if len(kept) > 2 else ring


def overlay(areas: Sequence[Sequence[Ring]], wanted: Callable[[list[np.ndarray]], np.ndarray]) -> list[Ring]:
    """The border of the ground that ``wanted`` tells from which areas hold a point, each of rings round ground and holes; largest
    rings first."""
    areas = [[r for r in rings if len(r) > 2] for rings in areas]
    flat = [r for rings in areas for r in rings]
    if not flat:
        return []
    flat, low, unit = _settled(flat)
    places, pairs = _noded(_sides(flat), unit)
    if not len(pairs):
        return []
    half = np.vstack([pairs, pairs[:, ::-1]])
    points, rest = _left(places, half, unit), iter(flat)
    held = [np.logical_xor.reduce([np.zeros(len(points), bool), *[holds(next(rest), points) for _ in rings]]) for rings in areas]
    inside = wanted(held)
    n = len(pairs)
    border = inside & ~np.concatenate([inside[n:], inside[:n]])
    found = [_straight(r) for r in _chained(places, half[border])]
    return sorted((r + low for r in found if abs(signed_area(r)) > 0), key=lambda r: -abs(signed_area(r)))


def united(areas: Sequence[Sequence[Ring]]) -> list[Ring]:
    """The union of areas, each of rings round ground and holes. Neighbours are joined first, so that what they have in common is gone
    before they meet the others."""
    areas = sorted((a for a in areas if len(a)), key=lambda a: min(float(r[:, 0].min()) for r in a))
    either = lambda held: np.any(held, axis=0)
    while len(areas) > AT_ONCE:
        areas = [overlay(areas[i : i + AT_ONCE], either) for i in range(0, len(areas), AT_ONCE)]
    return overlay(areas, either)


def joined(rings: Sequence[Ring]) -> list[Ring]:
    """The union."""
    return united([[r] for r in rings if len(r) > 2])


def common(a: Sequence[Ring], b: Sequence[Ring]) -> list[Ring]:
    """The ground that both have."""
    if not len(a) or not len(b):
        return []
    return overlay([*([r] for r in a), *([r] for r in b)], lambda held: np.any(held[: len(a)], axis=0) & np.any(held[len(a) :], axis=0))


def corridor(line: np.ndarray, width: float, corners: int = 16) -> list[Ring]:
    """The ground within ``width`` of a line (K13): a box along each stretch, a ``corners``-gon round each place."""
    turn = np.arange(corners) * (2 * math.pi / corners)
    round_ = width * np.stack([np.cos(turn), np.sin(turn)], axis=1)
    parts = [p + round_ for p in line]
    for a, b in zip(line, line[1:], strict=False):
        u = b - a
        if size := math.hypot(*u):
            n = np.array([-u[1], u[0]]) * (width / size)
            parts.append(np.array([a - n, b - n, b + n, a + n]))
    return joined(parts)


def divided(ring: Ring, lines: Sequence[np.ndarray], least: float = 0.0) -> list[Ring]:
    """The parts into which lines cut a ring (K15), those of an area over ``least``, largest first. A line that ends inside cuts nothing
    off; one that ends within the snapping distance of the border reaches it."""
    (ring, *cuts), low, unit = _settled([ring, *(x for x in lines if len(x) > 1)])
    places, pairs = _noded(np.vstack([_sides([ring]), *[np.hstack([x[:-1], x[1:]]) for x in cuts]]), unit)
    while len(pairs):  # loose ends
        degree = np.bincount(pairs.reshape(-1), minlength=len(places))
        tied = (degree[pairs] > 1).all(axis=1)
        if tied.all():
            break
        pairs = pairs[tied]
    half = np.vstack([pairs, pairs[:, ::-1]])
    half = half[holds(ring, _left(places, half, unit))]
    found = [_straight(r) for r in _chained(places, half)]
    return sorted((r + low for r in found if signed_area(r) > least), key=lambda r: -signed_area(r))


_AREA = "name string, place int, ring array<struct<x:double,y:double>>"


def _rings(column: pd.Series) -> list[Ring]:
    return [np.array([(p["x"], p["y"]) for p in ring], float).reshape(-1, 2) for ring in column]


def _rows(name: object, rings: Sequence[Ring]) -> pd.DataFrame:
    return pd.DataFrame({"name": [name] * len(rings), "place": np.arange(len(rings), dtype=np.int32), "ring": [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]})


def dissolved(areas: DataFrame, group: str, size: int = 256) -> DataFrame:
    """The joined border of each group's areas (K12): ``name``, ``place`` (0: the largest ring), ``ring``. Holes are rings that run clockwise.

    A group is first joined in strips of about ``size`` areas, in tasks of their own; the last round gets what these leave.
    """
    a = areas.where("size(ring) >= 3").select(F.col(group).cast("string").alias("name"), "ring", F.expr("array_min(transform(ring, p -> p.x))").alias("west"))
    spans = a.groupBy(F.col("name").alias("_name")).agg(F.min("west").alias("low"), F.max("west").alias("high"), F.ceil(F.count(F.lit(1)) / size).alias("strips"))
    strip = F.when(F.col("high") > F.col("low"), F.floor((F.col("west") - F.col("low")) / (F.col("high") - F.col("low")) * F.col("strips"))).otherwise(0)
    dealt = a.join(spans, F.col("name").eqNullSafe(F.col("_name"))).select("name", strip.cast("long").alias("strip"), "ring")

    def first(g: pd.DataFrame) -> pd.DataFrame:
        return _rows(g["name"].iloc[0], joined(_rings(g["ring"]))).assign(strip=g["strip"].iloc[0])

    def last(g: pd.DataFrame) -> pd.DataFrame:
        return _rows(g["name"].iloc[0], united([_rings(x) for _, x in g.groupby("strip")["ring"]]))

    return dealt.groupBy("name", "strip").applyInPandas(first, f"{_AREA}, strip long").groupBy("name").applyInPandas(last, _AREA)


def clipped(areas: DataFrame, masks: DataFrame, size: float = 0.05) -> DataFrame:
    """Each area where it lies on any mask (K13, K14): land, or a road's corridor. An area meets the masks whose bounds touch its own."""
    bounded = lambda d, *c: d.where("size(ring) >= 3").select(*c, "ring", *[F.expr(f"{f}(transform(ring, p -> p.{v}))").alias(n) for n, f, v in (("west", "array_min", "x"), ("east", "array_max", "x"), ("south", "array_min", "y"), ("north", "array_max", "y"))])
    near = spatial.by_cells(bounded(areas, "name"), bounded(masks), [], size)

    def work(batches):
        for batch in batches:
            out = [_rows(name, common(_rings(own), _rings(land))) for name, own, land in zip(batch["name"], batch["own"], batch["land"], strict=True)]
            yield pd.concat(out) if out else _rows("", [])

    return spread(near.groupBy("name").agg(F.collect_set("ring").alias("own"), F.collect_set("r_ring").alias("land"))).mapInPandas(work, _AREA)


def sections(areas: DataFrame, lines: DataFrame, least: float = 0.0) -> DataFrame:
    """The parts of each area that its lines cut (K15). ``lines`` have ``name`` (the area's) and ``line``; areas without lines stay whole."""
    grouped = lines.groupBy("name").agg(F.collect_list("line").alias("lines"))

    def work(batches):
        for batch in batches:
            out = [_rows(name, divided(_rings([ring])[0], _rings(cuts if cuts is not None else []), least)) for name, ring, cuts in zip(batch["name"], batch["ring"], batch["lines"], strict=True)]
            yield pd.concat(out) if out else _rows("", [])

    return areas.where("size(ring) >= 3").select("name", "ring").join(grouped, "name", "left").mapInPandas(work, _AREA)
