"""Random shapes and plain-Python answers to compare with."""

import math
import random


def pt(x, y):
    return {"x": float(x), "y": float(y)}


def ring(points):
    points = [pt(*p) for p in points]
    return points + points[:1]


def star(rng, cx, cy, r, n, grid=None):
    """A star-shaped, usually concave ring around a centre."""
    out = []
    for i in range(n):
        a, d = 2 * math.pi * i / n, r * rng.uniform(0.35, 1.0)
        x, y = cx + d * math.cos(a), cy + d * math.sin(a)
        out.append((round(x / grid) * grid, round(y / grid) * grid) if grid else (x, y))
    return out


def polygon(rng, span, grid=None):
    """Multi-polygon of one or two parts, some with a hole."""
    parts = []
    for k in range(rng.choice([1, 1, 2])):
        cx, cy, r = rng.uniform(0, span) + k * 3 * span, rng.uniform(0, span), rng.uniform(span / 10, span / 2)
        rings = [ring(star(rng, cx, cy, r, rng.randint(4, 12), grid))]
        if rng.random() < 0.5 and not grid:
            rings.append(ring(star(rng, cx, cy, r * 0.3, 6)))
        parts.append(rings)
    return parts


def edges(multi):
    return [(a["x"], a["y"], b["x"], b["y"]) for rings in multi for rg in rings
            for a, b in zip(rg, rg[1:])]


def segment_distance(px, py, e):
    x1, y1, x2, y2 = e
    dx, dy = x2 - x1, y2 - y1
    n = dx * dx + dy * dy
    t = 0.0 if n == 0 else max(0.0, min(1.0, ((px - x1) * dx + (py - y1) * dy) / n))
    return math.hypot(px - (x1 + t * dx), py - (y1 + t * dy))


def inside(px, py, multi):
    """Strictly inside by an upward ray; the boundary is outside."""
    es = edges(multi)
    if any(segment_distance(px, py, e) == 0 for e in es):
        return False
    hits = 0
    for x1, y1, x2, y2 in es:
        if (x1 > px) != (x2 > px) and y1 + (px - x1) / (x2 - x1) * (y2 - y1) > py:
            hits += 1
    return hits % 2 == 1


def rng(seed):
    return random.Random(seed)
