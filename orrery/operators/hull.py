"""Convex hulls per key (A10): floor area, floor perimeter, volume."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points of one key that a task reduces to a hull at once.
CHUNK = 20_000


def corners_2d(points: np.ndarray) -> np.ndarray:
    """Indices of the convex hull's corners in counter-clockwise order (monotone chain); of equal points the first."""
    pts, first = np.unique(points, axis=0, return_index=True)
    if len(pts) <= 2:
        return first
    xs, ys = pts.T.tolist()
    corners: list[int] = []
    for run in (range(len(pts)), reversed(range(len(pts)))):
        chain: list[int] = []
        for p in run:
            while len(chain) > 1:
                i, j = chain[-2], chain[-1]
                if (xs[j] - xs[i]) * (ys[p] - ys[i]) - (ys[j] - ys[i]) * (xs[p] - xs[i]) > 0:
                    break
                chain.pop()
            chain.append(p)
        corners += chain[:-1]
    return first[corners]


def hull_2d(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull in counter-clockwise order."""
    return points[corners_2d(points)]


def area_perimeter(corners: np.ndarray) -> tuple[float, float]:
    if len(corners) < 2:
        return 0.0, 0.0
    after = np.roll(corners, -1, axis=0)
    area = abs((corners[:, 0] * after[:, 1] - after[:, 0] * corners[:, 1]).sum()) / 2
    steps = np.sqrt(((after - corners) ** 2).sum(axis=1))
    return float(area), float(steps.sum())


class _Facets:
    """Facets of a growing hull: corners, the edges they share, and the points that each is the one to see."""

    def __init__(self, points: np.ndarray, eps: float):
        self.points, self.eps = points, eps
        self.corners: dict[int, tuple[int, int, int]] = {}
        self.plane: dict[int, tuple[np.ndarray, float]] = {}
        self.outside: dict[int, np.ndarray] = {}
        self.farthest: dict[int, int] = {}
        self.across: dict[tuple[int, int], int] = {}
        self.number = 0

    def add(self, triples: list[tuple[int, int, int]], waiting: np.ndarray) -> list[int]:
        """New facets; each of the ``waiting`` points goes to the one it is farthest outside of, or, inside of all, is done."""
        at = np.array(triples)
        p = self.points
        normal = np.cross(p[at[:, 1]] - p[at[:, 0]], p[at[:, 2]] - p[at[:, 0]])
        offset = (normal * p[at[:, 0]]).sum(axis=1)
        new = list(range(self.number, self.number + len(triples)))
        self.number += len(triples)
        for facet, triple, n, o in zip(new, triples, normal, offset.tolist(), strict=True):
            self.corners[facet], self.plane[facet] = triple, (n, o)
            for x in range(3):
                self.across[triple[x], triple[(x + 1) % 3]] = facet
        if not len(waiting):
            return []
        height = p[waiting] @ normal.T - offset
        best = height.argmax(axis=1)
        top = height[np.arange(len(waiting)), best]
        seen = top > self.eps
        waiting, best, top = waiting[seen], best[seen], top[seen]
        order = np.argsort(best, kind="stable")
        waiting, best, top = waiting[order], best[order], top[order]
        bounds = np.searchsorted(best, np.arange(len(triples) + 1)).tolist()
        busy = [k for k in range(len(triples)) if bounds[k] < bounds[k + 1]]
        for k in busy:
            own = slice(bounds[k], bounds[k + 1])
            self.outside[new[k]] = waiting[own]
            self.farthest[new[k]] = int(waiting[own][top[own].argmax()])
        return [new[k] for k in busy]

    def sees(self, point: int, facet: int) -> bool:
        normal, offset = self.plane[facet]
        return float(self.points[point] @ normal) - offset > self.eps

    def grow(self, facet: int) -> list[int]:
        """Take in the farthest point of a facet: what it sees goes, and its horizon gets new facets."""
        point = self.farthest[facet]
        seen, front, horizon = {facet}, [facet], []
        while front:
            a, b, c = self.corners[front.pop()]
            for edge in ((a, b), (b, c), (c, a)):
                other = self.across[edge[::-1]]
                if other in seen:
                    continue
                if self.sees(point, other):
                    seen.add(other)
                    front.append(other)
                else:
                    horizon.append(edge)
        waiting = [self.outside.pop(f) for f in seen if f in self.outside]
        for f in seen:
            self.farthest.pop(f, None)
            del self.corners[f], self.plane[f]
        rest = np.concatenate(waiting)
        return self.add([(i, j, point) for i, j in horizon], rest[rest != point])


def hull_3d(points: np.ndarray) -> tuple[np.ndarray, float]:
    """Indices of the corners, and the volume, of a convex hull (quickhull). Flat sets have volume 0
    and all their points as corners.

    Each facet keeps the points that lie outside of it; its farthest one is taken in next, and only points of
    the facets that go are looked at again, by the new ones.
    """
    pts, n = points, len(points)
    everyone = np.arange(n)
    if n < 4:
        return everyone, 0.0
    eps = 1e-10 * max(1.0, float(np.abs(pts - pts.mean(axis=0)).max())) ** 3
    a = int(np.lexsort(pts.T[::-1])[0])
    b = int(((pts - pts[a]) ** 2).sum(axis=1).argmax())
    c = int((np.cross(pts - pts[a], pts[b] - pts[a]) ** 2).sum(axis=1).argmax())
    normal = np.cross(pts[b] - pts[a], pts[c] - pts[a])
    height = (pts - pts[a]) @ normal
    d = int(np.abs(height).argmax())
    if abs(height[d]) <= eps:
        return everyone, 0.0
    if height[d] > 0:
        b, c = c, b  # so that d lies inside of (a, b, c)
    centre = pts[[a, b, c, d]].mean(axis=0)
    facets = _Facets(pts - centre, eps)
    front = facets.add([(a, b, c), (a, d, b), (b, d, c), (c, d, a)], everyone)
    while front:
        facet = front.pop()
        if facet in facets.outside:
            front += facets.grow(facet)
    at = np.array(list(facets.corners.values()))
    x, y, z = (facets.points[at[:, k]] for k in range(3))
    return np.unique(at), abs(float((x * np.cross(y, z)).sum())) / 6


def hulls(points: DataFrame, key: str, axes: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """key, floor_area, floor_perimeter (of the hull of the first two axes) and volume (of the hull).

    A hull is the hull of partial hulls, so tasks first reduce their own points to corners and only
    corners are shuffled: a hot key is one small group. Points with a null do not count; fewer
    than three points, or flat ones, have extents of 0.
    """
    kind = points.schema[key].dataType.simpleString()
    names = list(axes)

    def reduce_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, group in batch.groupby(key, dropna=False, sort=False):
                for at in range(0, len(group), CHUNK):
                    part = group.iloc[at : at + CHUNK].drop_duplicates()
                    xyz = part[names].to_numpy(float)
                    corners, _ = hull_3d(xyz)
                    yield part.iloc[np.union1d(corners, corners_2d(xyz[:, :2])).astype(int)]

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        xyz = np.unique(group[names].to_numpy(float), axis=0)
        area, perimeter = area_perimeter(hull_2d(xyz[:, :2]))
        return pd.DataFrame({key: [group[key].iloc[0]], "floor_area": [area], "floor_perimeter": [perimeter], "volume": [hull_3d(xyz)[1]]})

    rows = points.select(F.col(key), *[F.col(a).cast("double").alias(a) for a in names]).na.drop(subset=names)
    partial = rows.mapInPandas(reduce_, rows.schema)
    return partial.groupBy(key).applyInPandas(finish, f"`{key}` {kind}, floor_area double, floor_perimeter double, volume double")
