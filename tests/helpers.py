"""Small graphs and an exhaustive walker, independent of the engine."""

from __future__ import annotations

import itertools
import math
import struct

from tidepath.sources.model import EDGES, NODES, PROFILES, TURNS, Metadata, Model

INF = float("inf")


def f32(x: float) -> float:
    return struct.unpack("f", struct.pack("f", x))[0] if math.isfinite(x) else x


def model(spark, edges, n=None, profiles=None, turns=(), meta=None, xy=None):
    """edges: (origin, dest, weight) or (origin, dest, weight, profile)."""
    n = n or 1 + max(max(e[0], e[1]) for e in edges)
    rows = [(i, f"E{i}", e[0], e[1], float(e[2]), e[3] if len(e) > 3 else 1) for i, e in enumerate(edges)]
    nodes = [(i, f"N{i}", *(map(float, xy[i]) if xy else (float(i), float(i)))) for i in range(n)]
    profiles = profiles if profiles is not None else [(1, 127, [1.0])]
    return Model(spark.createDataFrame(nodes, NODES), spark.createDataFrame(rows, EDGES), spark.createDataFrame(profiles, PROFILES), spark.createDataFrame([(a, b, float(p)) for a, b, p in turns], TURNS), meta or Metadata())


class Walker:
    """Costs of paths by the rules, and all simple edge paths between two nodes."""

    def __init__(self, edges, overlay=(), turns=(), buckets=None, bucket_seconds=3600):
        self.edges, self.overlay, self.turns = edges, {o[0]: o[1:] for o in overlay}, {(a, b): p for a, b, p in turns}
        self.buckets, self.bucket_seconds = buckets or {1: [1.0]}, bucket_seconds

    def multiplier(self, profile, t):
        b = self.buckets.get(profile)
        if b is None:
            return 1.0
        share = (t % 86400) / self.bucket_seconds
        low = math.floor(share)
        x, y = b[low % len(b)], b[(low + 1) % len(b)]
        return f32(x + f32(y - x) * (share - low))

    def drive(self, path, t):
        g, prev = 0.0, None
        for e in path:
            o, d, w, *p = self.edges[e]
            pen = 1.0
            if e in self.overlay:
                s, a, z = self.overlay[e]
                if a <= t < z:
                    pen = INF if s == 0 else f32(1 / f32(s))
            travel = INF if pen == INF else f32(f32(w) * self.multiplier(p[0] if p else 1, t) * pen)
            cost = f32(travel + (self.turns.get((prev, e), 0.0) if prev is not None else 0.0))
            if cost == INF:
                return INF, None
            g, t, prev = f32(g + cost), t + max(0, math.ceil(cost)), e
        return g, t

    def paths(self, source, target, most=8):
        out = {}
        for i, e in enumerate(self.edges):
            out.setdefault(e[0], []).append(i)

        def go(node, path, seen):
            if node == target and path:
                yield tuple(path)
                return
            if len(path) == most:
                return
            for e in out.get(node, ()):
                d = self.edges[e][1]
                if d not in seen:
                    yield from go(d, [*path, e], seen | {d})

        yield from go(source, [], {source})

    def best(self, source, target, t):
        if source == target:
            return 0.0, t, ()
        found = [(*self.drive(p, t), p) for p in self.paths(source, target)]
        found = [x for x in found if x[0] < INF]
        return min(found) if found else (INF, t, ())


def percentile(values, q):
    """values: (value, probability)."""
    total, cum = sum(p for _, p in values), 0.0
    for v, p in sorted(values):
        cum += p
        if cum + 1e-6 >= q * total:
            return v


def grid(w, h, weight=1.0):
    edges = []
    for y, x in itertools.product(range(h), range(w)):
        for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)):
            if 0 <= x + dx < w and 0 <= y + dy < h:
                edges.append((y * w + x, (y + dy) * w + x + dx, weight))
    return edges
