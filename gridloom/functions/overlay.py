"""Exact overlay of polygons over flat coordinate arrays: intersection, difference, union, repair, buffers, and lines cut by polygons.

The edges of all rings are snapped to a grid of 2^28 steps across their bounding box and split where they meet, until
nothing crosses any more. On that grid all tests are exact in 64-bit integers. Each edge then knows the winding numbers to its left and
right; edges between inside and outside are the result's, and are walked to rings with the inside on their
left. Points get back the coordinates they came with; only crossings are computed.

A polygon is a list of rings, a ring an (n, 2) array without the repeated last point.
"""

from __future__ import annotations

import numpy as np

STEPS = 1 << 28
#: Steps of the grid by which a real crossing may differ from the grid's own.
NEAR = 64
#: Steps of the grid: a ring that is no wider than this all along is what rounding left between edges that are one.
THIN = 4
#: Pairs of edges that are compared at once.
BLOCK = 1 << 21


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... n[i] of them, for each i."""
    return np.arange(int(n.sum())) + np.repeat(first - np.cumsum(n) + n, n)


def signed_area(ring: np.ndarray) -> float:
    x, y = (ring - ring[0]).T
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2


def oriented(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The rings of all parts, each part's first counter-clockwise and its others clockwise."""
    return [r if (signed_area(r) > 0) == (i == 0) else r[::-1] for part in parts for i, r in enumerate(part)]


def _pairs(p: np.ndarray, q: np.ndarray):
    """Blocks of index pairs i, j of edges whose boxes meet, each pair once."""
    low, high = np.minimum(p, q), np.maximum(p, q)
    by = np.argsort(low[:, 0], kind="stable")
    left, right = low[by, 0], high[by, 0]
    ahead = np.searchsorted(left, right, side="right") - np.arange(len(by)) - 1
    ends = np.cumsum(ahead)
    start = 0
    while start < len(by):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BLOCK)))
        n = ahead[start:stop]
        i = by[np.repeat(np.arange(start, stop), n)]
        j = by[spread(np.arange(start, stop) + 1, n)]
        meets = (low[i, 1] <= high[j, 1]) & (low[j, 1] <= high[i, 1])
        yield i[meets], j[meets]
        start = stop


def _cross(ax, ay, bx, by):
    return ax * by - ay * bx


class _Grid:
    """Real coordinates and their places on the grid; the real ones of a place are those that first came there."""

    def __init__(self, rings: list[np.ndarray]):
        xy = np.concatenate(rings)
        self.origin = xy.min(axis=0)
        self.step = max(float((xy.max(axis=0) - self.origin).max()), 1e-300) / STEPS
        self.real: dict[tuple[int, int], tuple[float, float]] = {}

    def places(self, xy: np.ndarray) -> np.ndarray:
        at = np.rint((xy - self.origin) / self.step).astype(np.int64)
        for place, own in zip(map(tuple, at.tolist()), map(tuple, xy.tolist())):
            self.real.setdefault(place, own)
        return at

    def reals(self, places: np.ndarray) -> np.ndarray:
        return np.array([self.real[tuple(p)] for p in places.tolist()])


def _split(p: np.ndarray, q: np.ndarray, grid: _Grid) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Edges split where they meet others, and which edge each was; None if none does."""
    edge, cut = [], []
    for i, j in _pairs(p, q):
        d, e, w = q[i] - p[i], q[j] - p[j], p[j] - p[i]
        across = _cross(d[:, 0], d[:, 1], e[:, 0], e[:, 1])
        # Ends of one on the other, which covers touching and overlapping edges.
        for a, b, ends in ((i, j, (p, q)), (j, i, (p, q))):
            for end in ends:
                v, f = end[b] - p[a], q[a] - p[a]
                on = _cross(f[:, 0], f[:, 1], v[:, 0], v[:, 1]) == 0
                dot, span = (f * v).sum(axis=1), (f * f).sum(axis=1)
                on &= (dot > 0) & (dot < span)
                edge.append(a[on])
                cut.append(end[b[on]])
        t_up, s_up = _cross(w[:, 0], w[:, 1], e[:, 0], e[:, 1]), _cross(w[:, 0], w[:, 1], d[:, 0], d[:, 1])
        sign = np.sign(across)
        proper = (across != 0) & (t_up * sign > 0) & (t_up * sign < np.abs(across)) & (s_up * sign > 0) & (s_up * sign < np.abs(across))
        if proper.any():
            a, b = i[proper], j[proper]
            start, end, other, to = grid.reals(p[a]), grid.reals(q[a]), grid.reals(p[b]), grid.reals(q[b])
            (fx, fy), (gx, gy), (vx, vy) = (end - start).T, (to - other).T, (other - start).T
            # Edges that cross on the grid only by what was rounded meet in its terms: nearly parallel ones may really
            # meet far away, where a cut would lengthen the other edge.
            with np.errstate(divide="ignore", invalid="ignore"):
                turn = _cross(fx, fy, gx, gy)
                t, s = _cross(vx, vy, gx, gy) / turn, _cross(vx, vy, fx, fy) / turn
                t_own, s_own = t_up[proper] / across[proper], s_up[proper] / across[proper]
                near = (np.abs((t - t_own)[:, None] * d[proper]) <= NEAR).all(axis=1) & (np.abs((s - s_own)[:, None] * e[proper]) <= NEAR).all(axis=1)
                for k, along in ((t, d[proper]), (s, e[proper])):
                    # Ends may have been rounded over the other edge, by a step or so.
                    near &= np.abs(k - np.clip(k, 0, 1)) * np.abs(along).max(axis=1) <= 2
            t = np.where(near, t, t_own)[:, None]
            at = grid.places(start + (end - start) * t)
            for k in (a, b):
                inner = (at != p[k]).any(axis=1) & (at != q[k]).any(axis=1)
                edge.append(k[inner])
                cut.append(at[inner])
    edge, cut = np.concatenate(edge or [np.zeros(0, dtype=np.int64)]), np.concatenate(cut or [np.zeros((0, 2), dtype=np.int64)])
    if not len(edge):
        return None
    # Each edge's start, its cuts by distance from it, and its end.
    n = len(p)
    of = np.concatenate((np.arange(n), edge, np.arange(n)))
    at = np.concatenate((p, cut, q))
    far = np.concatenate((np.full(n, -1), ((cut - p[edge]) ** 2).sum(axis=1), np.full(n, np.iinfo(np.int64).max)))
    by = np.lexsort((far, of))
    of, at = of[by], at[by]
    same = of[1:] == of[:-1]
    a, b, of = at[:-1][same], at[1:][same], of[:-1][same]
    real = (a != b).any(axis=1)
    return a[real], b[real], of[real]


def _winding(low: np.ndarray, high: np.ndarray, net: np.ndarray) -> np.ndarray:
    """Winding numbers (labels by edges) to the left of each edge (``low`` to ``high`` in order of y, then x), by a ray to the west from its middle.

    A horizontal edge is taken as one that rises by next to nothing, so that every ray meets every edge properly.
    """
    n = len(low)
    middle = low + high
    low2, high2 = 2 * low, 2 * high
    # Edges are noted in the strips of y that they reach into.
    strips = max(1, int(np.sqrt(n) * 2))
    bottom = low2[:, 1].min()
    tall = (high2[:, 1].max() - bottom) // strips + 1
    first, last = (low2[:, 1] - bottom) // tall, (high2[:, 1] - bottom) // tall
    edge = np.repeat(np.arange(n), last - first + 1)
    strip = spread(first, last - first + 1)
    by = np.argsort(strip, kind="stable")
    edge, strip = edge[by], strip[by]
    own = (middle[:, 1] - bottom) // tall
    start, end = np.searchsorted(strip, own), np.searchsorted(strip, own, side="right")
    out = np.zeros((len(net), n), dtype=np.int64)
    total = np.cumsum(end - start)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + BLOCK)))
        e = np.repeat(np.arange(i, j), (end - start)[i:j])
        f = edge[spread(start[i:j], (end - start)[i:j])]
        m = middle[e]
        above = (low2[f, 1] < m[:, 1]) | (low2[f, 1] == m[:, 1]) & (low2[f, 0] <= m[:, 0])
        below = (high2[f, 1] > m[:, 1]) | (high2[f, 1] == m[:, 1]) & (high2[f, 0] > m[:, 0])
        d, v = high2[f] - low2[f], m - low2[f]
        left = above & below & (e != f) & (_cross(d[:, 0], d[:, 1], v[:, 0], v[:, 1]) < 0)
        for k in range(len(net)):
            out[k] -= np.bincount(e[left], weights=net[k][f[left]], minlength=n).astype(np.int64)
        i = j
    return out


def _walk(p: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
    """Rings of directed edges with the inside on their left. Where several meet, the sharpest turn to the left keeps areas apart that only touch."""
    points, at = np.unique(np.concatenate((p, q)), axis=0, return_inverse=True)
    a, b = at.reshape(-1)[: len(p)], at.reshape(-1)[len(p) :]
    out: dict[int, list[int]] = {}
    for k, start in enumerate(a.tolist()):
        out.setdefault(start, []).append(k)
    angle = np.arctan2((q - p)[:, 1].astype(float), (q - p)[:, 0].astype(float))
    ends = b.tolist()
    used = np.zeros(len(p), dtype=bool)
    rings = []
    for k in range(len(p)):
        if used[k]:
            continue
        path, seen = [], {}
        while not used[k]:
            used[k] = True
            start = int(a[k])
            if start in seen:
                # Came back to a point: what lies between is a ring of its own.
                cut = seen[start]
                rings.append(points[path[cut:]])
                for v in path[cut + 1 :]:
                    seen.pop(v, None)
                del path[cut + 1 :]
            else:
                seen[start] = len(path)
                path.append(start)
            choices = [c for c in out[ends[k]] if not used[c]]
            if not choices:
                break
            back = angle[k] + np.pi
            k = choices[0] if len(choices) == 1 else max(choices, key=lambda c: (angle[c] - back) % (2 * np.pi))
        if len(path) > 2:
            rings.append(points[path])
    return [r for r in rings if len(r) > 2]


def _within(ring: np.ndarray, x: float, y: float) -> bool:
    x0, y0 = ring.T.astype(float)
    x1, y1 = np.roll(x0, -1), np.roll(y0, -1)
    over = (y0 > y) != (y1 > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        return bool(np.count_nonzero(over & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)) % 2)


def _parts(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Outer rings with their holes: a hole goes to the smallest outer ring around it."""
    sized = [(signed_area(r.astype(float)), r) for r in rings]
    outer = sorted(((s, r) for s, r in sized if s > 0), key=lambda x: x[0])
    parts = [[r] for _, r in outer]
    boxes = [(r.min(axis=0), r.max(axis=0)) for _, r in outer]
    for s, hole in sized:
        if s < 0:
            x, y = (hole[0] + hole[1]) / 2
            for part, (lo, hi) in zip(parts, boxes):
                if lo[0] <= x <= hi[0] and lo[1] <= y <= hi[1] and _within(part[0], x, y):
                    part.append(hole)
                    break
    return parts


def overlay(groups: list[list[np.ndarray]], inside) -> list[list[np.ndarray]]:
    """Parts (outer ring, holes) of where ``inside`` holds of the groups' winding numbers (an array for each group of rings)."""
    groups = [[r for r in rings if len(r) > 2] for rings in groups]
    rings = [r for g in groups for r in g]
    if not rings:
        return []
    grid = _Grid(rings)
    label = np.concatenate([np.full(len(r), k) for k, g in enumerate(groups) for r in g])
    placed = [grid.places(r) for r in rings]
    p, q = np.concatenate(placed), np.concatenate([np.roll(r, -1, axis=0) for r in placed])
    real = (p != q).any(axis=1)
    p, q, label = p[real], q[real], label[real]
    while len(p) and (found := _split(p, q, grid)) is not None:
        p, q, of = found
        label = label[of]
        # Edges that run over one another count as one, with how often each direction is used.
        p, q, label = _merged(p, q, label)
    if not len(p):
        return []
    up = (p[:, 1] < q[:, 1]) | (p[:, 1] == q[:, 1]) & (p[:, 0] < q[:, 0])
    ends = np.concatenate((np.where(up[:, None], p, q), np.where(up[:, None], q, p)), axis=1)
    ends, of = np.unique(ends, axis=0, return_inverse=True)
    of = of.reshape(-1)
    net = np.stack([np.bincount(of[label == k], weights=np.where(up, 1, -1)[label == k], minlength=len(ends)).astype(np.int64) for k in range(len(groups))])
    some = (net != 0).any(axis=0)
    low, high, net = ends[some, :2], ends[some, 2:], net[:, some]
    if not len(low):
        return []
    left = _winding(low, high, net)
    in_left, in_right = inside(left), inside(left - net)
    border = in_left != in_right
    swap = ~in_left[border][:, None]
    walked = _walk(np.where(swap, high[border], low[border]), np.where(swap, low[border], high[border])) if border.any() else []
    return [[grid.reals(r) for r in part] for part in _parts([r for r in walked if not _thin(r)])]


def _thin(ring: np.ndarray) -> bool:
    """Whether a ring on the grid has an area of at most THIN steps times half its length."""
    ring = ring.astype(float)
    return 2 * abs(signed_area(ring)) <= THIN * np.hypot(*(np.roll(ring, -1, axis=0) - ring).T).sum()


def _merged(p: np.ndarray, q: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Less the pairs of edges of one label that run both ways: they part nothing."""
    up = (p[:, 1] < q[:, 1]) | (p[:, 1] == q[:, 1]) & (p[:, 0] < q[:, 0])
    rows = np.concatenate((label[:, None], np.where(up[:, None], p, q), np.where(up[:, None], q, p)), axis=1)
    rows, of = np.unique(rows, axis=0, return_inverse=True)
    net = np.bincount(of.reshape(-1), weights=np.where(up, 1, -1), minlength=len(rows)).astype(np.int64)
    rows = np.repeat(rows, np.abs(net), axis=0)
    turned = np.repeat(net, np.abs(net))[:, None] < 0
    return np.where(turned, rows[:, 3:], rows[:, 1:3]), np.where(turned, rows[:, 1:3], rows[:, 3:]), rows[:, 0]


def intersection(a: list[list[np.ndarray]], b: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    return overlay([oriented(a), oriented(b)], lambda w: (w[0] > 0) & (w[1] > 0))


def difference(a: list[list[np.ndarray]], b: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    return overlay([oriented(a), oriented(b)], lambda w: (w[0] > 0) & (w[1] <= 0))


def union(parts: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    """Of any number of parts at once."""
    return overlay([oriented(parts)], lambda w: w[0] > 0)


def repaired(parts: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    """Rings split where they cross themselves or each other; inside is what an odd number of them holds."""
    return overlay([[r for part in parts for r in part]], lambda w: w[0] % 2 == 1)


def buffered(parts: list[list[np.ndarray]], lines: list[np.ndarray], by: float, corners: int = 8) -> list[list[np.ndarray]]:
    """Everything within ``by`` of polygons and lines (a point is a line of one point): the union of the polygons and of a
    capsule around each edge, whose rounds have ``corners`` pieces a quarter."""
    edges = [(r, np.roll(r, -1, axis=0)) for part in parts for r in part] + [(r[:-1], r[1:]) if len(r) > 1 else (r, r) for r in lines]
    if not edges:
        return []
    a, b = (np.concatenate([e[k] for e in edges]) for k in (0, 1))
    turn = np.arctan2((b - a)[:, 1], (b - a)[:, 0])[:, None]
    arc = np.linspace(np.pi / 2, 3 * np.pi / 2, 2 * corners + 1)[None]
    round_a = np.stack((a[:, :1] + by * np.cos(turn + arc), a[:, 1:] + by * np.sin(turn + arc)), axis=2)
    round_b = np.stack((b[:, :1] - by * np.cos(turn + arc), b[:, 1:] - by * np.sin(turn + arc)), axis=2)
    return union([*parts, *[[c] for c in np.concatenate((round_a, round_b), axis=1)]])


def cut_line(line: np.ndarray, parts: list[list[np.ndarray]], keep_inside: bool) -> list[np.ndarray]:
    """Pieces of a line inside (or outside) polygons, cut exactly at their edges; inside is what an odd number of rings holds."""
    p = np.concatenate([r for part in parts for r in part]) if parts else np.zeros((0, 2))
    q = np.concatenate([np.roll(r, -1, axis=0) for part in parts for r in part]) if parts else p
    a, d, e = line[:-1, None], (line[1:] - line[:-1])[:, None], (q - p)[None]
    across = _cross(d[..., 0], d[..., 1], e[..., 0], e[..., 1])
    w = p[None] - a
    with np.errstate(divide="ignore", invalid="ignore"):
        t = _cross(w[..., 0], w[..., 1], e[..., 0], e[..., 1]) / across
        s = _cross(w[..., 0], w[..., 1], d[..., 0], d[..., 1]) / across
        # Ends of edges that run along the line.
        along = (across == 0) & (_cross(w[..., 0], w[..., 1], d[..., 0], d[..., 1]) == 0)
        t_along = (w * d).sum(axis=2) / np.maximum((d * d).sum(axis=2), 1e-300)
    hit = (across != 0) & (s >= 0) & (s <= 1) & (t > 0) & (t < 1)
    out: list[list[np.ndarray]] = []
    joined = False
    for i in range(len(line) - 1):
        cuts = np.unique(np.concatenate(([0.0], t[i][hit[i]], t_along[i][along[i] & (t_along[i] > 0) & (t_along[i] < 1)], [1.0])))
        at = line[i] + (line[i + 1] - line[i]) * cuts[:, None]
        at[-1] = line[i + 1]
        middle = (at[1:] + at[:-1]) / 2
        over = (p[None, :, 1] > middle[:, None, 1]) != (q[None, :, 1] > middle[:, None, 1])
        with np.errstate(divide="ignore", invalid="ignore"):
            x = (q - p)[None, :, 0] * (middle[:, None, 1] - p[None, :, 1]) / (q - p)[None, :, 1] + p[None, :, 0]
        inside = np.count_nonzero(over & (middle[:, None, 0] < x), axis=1) % 2 == 1
        for k, here in enumerate(inside == keep_inside):
            if here:
                if joined:
                    out[-1].append(at[k + 1])
                else:
                    out.append([at[k], at[k + 1]])
            joined = bool(here)
    return [np.array(x) for x in out]
