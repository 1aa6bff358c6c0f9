"""Plain NumPy polygon tests, for use inside vectorised functions. A ring is an (n, 2) array, closed implicitly."""

from __future__ import annotations

import numpy as np


def inside(ring: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Even-odd rule, half-open: lower and left edges belong to the ring."""
    ax, ay = ring[:, 0][:, None], ring[:, 1][:, None]
    bx, by = np.roll(ring[:, 0], -1)[:, None], np.roll(ring[:, 1], -1)[:, None]
    spans = (ay > y) != (by > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = (bx - ax) * (y - ay) / (by - ay) + ax
    return (spans & (x < cross)).sum(axis=0) % 2 == 1


def distance(ring: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Planar distance to the ring's outline."""
    a, d = ring, np.roll(ring, -1, axis=0) - ring
    p = np.stack([x, y], axis=-1)[:, None, :] - a
    length = np.maximum((d**2).sum(axis=1), 1e-300)
    t = np.clip((p * d).sum(axis=2) / length, 0, 1)
    return np.sqrt((((p - t[..., None] * d)) ** 2).sum(axis=2).min(axis=1))


def inside_or_near(ring: np.ndarray, x: np.ndarray, y: np.ndarray, margin: float) -> np.ndarray:
    """Membership of the ring dilated by ``margin`` (exact round joins)."""
    hit = inside(ring, x, y)
    return hit if margin <= 0 else hit | (distance(ring, x, y) <= margin)


def touches_box(ring: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """Whether closed boxes and the filled ring share a point (the all-touched rule used here)."""
    hit = inside(ring, x0, y0)
    a, b = ring, np.roll(ring, -1, axis=0)
    for k in range(len(ring)):  # outline against boxes by clipping each edge (Liang-Barsky)
        low, high = np.zeros(len(x0)), np.ones(len(x0))
        open_ = np.ones(len(x0), bool)
        for start, delta, lo, hi in ((a[k, 0], b[k, 0] - a[k, 0], x0, x1), (a[k, 1], b[k, 1] - a[k, 1], y0, y1)):
            if delta == 0:
                open_ &= (start >= lo) & (start <= hi)
                continue
            t0, t1 = (lo - start) / delta, (hi - start) / delta
            low, high = np.maximum(low, np.minimum(t0, t1)), np.minimum(high, np.maximum(t0, t1))
        hit |= open_ & (low <= high)
    return hit


def edge_hits(ax, ay, bx, by, x0, x1, y0, y1) -> np.ndarray:
    """Whether each segment shares a point with its own closed box; arrays of one length. The clipping is that of ``touches_box``."""
    low, high, open_ = np.zeros(len(ax)), np.ones(len(ax)), np.ones(len(ax), bool)
    for start, delta, lo, hi in ((ax, bx - ax, x0, x1), (ay, by - ay, y0, y1)):
        flat = delta == 0
        open_ &= ~flat | ((start >= lo) & (start <= hi))
        with np.errstate(divide="ignore", invalid="ignore"):
            t0, t1 = (lo - start) / delta, (hi - start) / delta
        low = np.where(flat, low, np.maximum(low, np.minimum(t0, t1)))
        high = np.where(flat, high, np.minimum(high, np.maximum(t0, t1)))
    return open_ & (low <= high)


def merged_runs(row: np.ndarray, first: np.ndarray, last: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of cells, at most ``width`` to a row, with those that overlap or adjoin made one; in the order of rows and columns."""
    if not len(row):
        return row, first, last
    order = np.lexsort((first, row))
    row, a, b = row[order], row[order] * (width + 2) + first[order], row[order] * (width + 2) + last[order]
    reach = np.maximum.accumulate(b)
    new = np.ones(len(row), bool)
    new[1:] = a[1:] > reach[:-1] + 1
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(row)) - 1
    row = row[starts]
    return row, a[starts] - row * (width + 2), reach[ends] - row * (width + 2)


def crossing_runs(ring: np.ndarray, y: np.ndarray, x_of, guess, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, first, last) of columns whose x lies in the ring on horizontal lines, by the rule of ``inside``.

    ``x_of(column)`` rises with the column; ``guess(x)`` is a column near x, and the columns around it decide.
    """
    ax, ay = ring[:, 0][:, None], ring[:, 1][:, None]
    bx, by = np.roll(ring[:, 0], -1)[:, None], np.roll(ring[:, 1], -1)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = np.where((ay > y) != (by > y), (bx - ax) * (y - ay) / (by - ay) + ax, np.inf)
    cross = np.sort(cross, axis=0)
    pairs = cross[: len(ring) // 2 * 2].reshape(-1, 2, len(y))
    k, line = np.nonzero(np.isfinite(pairs[:, 1]))
    at = []
    for side in (0, 1):  # the first column at or beyond each crossing
        x = pairs[k, side, line]
        column = np.clip(guess(x), -2, width + 1).astype(np.int64) - 1
        for _ in range(3):
            column += x_of(column) < x
        at.append(column)
    first, last = np.maximum(at[0], 0), np.minimum(at[1] - 1, width - 1)
    some = first <= last
    return line[some], first[some], last[some]


def touched_runs(ring: np.ndarray, rows: np.ndarray, transform: tuple, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in ``rows``, first, last) of cells that share a point with the filled ring, as ``touches_box`` has it; may overlap.

    Columns must rise with x. An edge meets a row's band in one stretch, whose outermost cells are put to the test.
    """
    a, _, c, _, e, f = transform
    y0, y1 = np.sort([rows * e + f, (rows + 1) * e + f], axis=0)
    runs = [crossing_runs(ring, y0, lambda k: k * a + c, lambda x: np.ceil((x - c) / a), width)]
    end = np.roll(ring, -1, axis=0)
    low, high = np.minimum(ring[:, 1], end[:, 1])[:, None], np.maximum(ring[:, 1], end[:, 1])[:, None]
    edge, line = np.nonzero((low <= y1) & (high >= y0))
    if len(edge):
        (ax, ay), (bx, by), lo, hi = ring[edge].T, end[edge].T, y0[line], y1[line]
        dy = by - ay
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.sort([(lo - ay) / dy, (hi - ay) / dy], axis=0)
        t = np.clip(np.where(dy == 0, [[0.0], [1.0]], t), 0, 1)
        x = np.sort(ax + t * (bx - ax), axis=0)
        ends = np.clip(np.floor((x - c) / a), -2, width + 1).astype(np.int64)
        near = np.concatenate([ends[0] + k for k in (-1, 0, 1)] + [ends[1] + k for k in (-1, 0, 1)]).reshape(6, -1)
        wide = lambda v: np.broadcast_to(v, near.shape).ravel()
        box = np.sort([near.ravel() * a + c, (near.ravel() + 1) * a + c], axis=0)
        hit = edge_hits(*map(wide, (ax, ay, bx, by)), *box, wide(lo), wide(hi)).reshape(near.shape)
        first, last = np.where(hit, near, width + 9).min(axis=0), np.where(hit, near, -9).max(axis=0)
        first, last = np.maximum(first, 0), np.minimum(last, width - 1)
        some = first <= last
        runs.append((line[some], first[some], last[some]))
    return tuple(map(np.concatenate, zip(*runs)))


def _turn(p: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Sign of the turn from pq to r, row by row."""
    return np.sign((q[:, 0] - p[:, 0]) * (r[:, 1] - p[:, 1]) - (q[:, 1] - p[:, 1]) * (r[:, 0] - p[:, 0]))


def close_edges(ring: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of edges i < j that are no neighbours and whose boxes meet: a sweep along x, with the edges sorted by where they begin."""
    n, end = len(ring), np.roll(ring, -1, axis=0)
    low, high = np.minimum(ring, end), np.maximum(ring, end)
    order = np.argsort(low[:, 0], kind="stable")
    upto = np.searchsorted(low[order, 0], high[order, 0], "right")
    count = np.maximum(upto - np.arange(n) - 1, 0)
    first = np.repeat(np.arange(n), count)
    second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count)
    i, j = np.sort([order[first], order[second]], axis=0)
    meet = (low[i, 1] <= high[j, 1]) & (low[j, 1] <= high[i, 1]) & (j - i > 1) & ~((i == 0) & (j == n - 1))
    return i[meet], j[meet]


def is_simple(ring: np.ndarray) -> bool:
    """No two non-neighbouring edges cross or touch."""
    i, j = close_edges(ring)
    end = np.roll(ring, -1, axis=0)
    one = _turn(ring[i], end[i], ring[j]) != _turn(ring[i], end[i], end[j])
    return not (one & (_turn(ring[j], end[j], ring[i]) != _turn(ring[j], end[j], end[i]))).any()


def signed_area(ring: np.ndarray) -> float:
    end = np.roll(ring, -1, axis=0)
    return float((ring[:, 0] * end[:, 1] - end[:, 0] * ring[:, 1]).sum() / 2)


def _without_spikes(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Repeated points and ways out and back along one line are taken out, whatever their length."""
    out: list[tuple[float, float]] = []

    def spike(p, q, r) -> bool:
        u, v = (q[0] - p[0], q[1] - p[1]), (r[0] - q[0], r[1] - q[1])
        return u[0] * v[1] - u[1] * v[0] == 0 and u[0] * v[0] + u[1] * v[1] < 0

    for point in points:
        while True:
            if out and out[-1] == point:
                break
            if len(out) >= 2 and spike(out[-2], out[-1], point):
                out.pop()
                continue
            out.append(point)
            break
    while len(out) >= 3:  # the same across the ring's end
        if out[0] == out[-1] or spike(out[-2], out[-1], out[0]):
            out.pop()
        elif spike(out[-1], out[0], out[1]):
            out.pop(0)
        else:
            break
    return out


def _noded(ring: np.ndarray) -> list[tuple[float, float]]:
    """The ring's points, with points of its own that lie on other edges put into these."""
    i, j = close_edges(ring)
    end, at = np.roll(ring, -1, axis=0), {}
    for edge, other in ((i, j), (j, i)):
        for point in (ring[other], end[other]):
            inside = (_turn(ring[edge], end[edge], point) == 0) & (((point - ring[edge]) * (point - end[edge])).sum(axis=1) < 0)
            for e, p in zip(edge[inside], point[inside]):
                at.setdefault(int(e), set()).add(tuple(p.tolist()))
    out = []
    for k, p in enumerate(map(tuple, ring.tolist())):
        out.append(p)
        out += sorted(at.get(k, ()), key=lambda q: (q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2)  # noqa: B023
    return out


def repaired(ring: np.ndarray) -> np.ndarray | None:
    """The ring of the one polygon that a ring which touches itself stands for, or None.

    Spikes fall away. Where the ring comes back to a point of its own it is cut into loops: loops inside the largest one that turn the other way are
    holes that touch it, and the ring stays as it is (the even-odd rule leaves them out); those that turn the same way are covered twice
    and fall away. Lobes side by side are several polygons, and edges that cross are a bow tie: neither is one polygon.
    """
    points = _without_spikes([tuple(p) for p in ring.tolist()])
    if len(points) < 3:
        return None
    whole = np.array(points)
    if is_simple(whole):
        return whole if signed_area(whole) else None
    loops, path, seen = [], [], {}
    for p in _noded(whole):
        if p in seen:
            k = seen[p]
            loops.append(path[k:])
            for q in path[k + 1 :]:
                del seen[q]
            del path[k + 1 :]
        else:
            seen[p] = len(path)
            path.append(p)
    loops.append(path)
    loops = [np.array(x) for x in (_without_spikes(x) for x in loops) if len(x) >= 3]
    loops = sorted((x for x in loops if signed_area(x)), key=lambda x: -abs(signed_area(x)))
    if not loops or not all(map(is_simple, loops)):
        return None
    outer, rest = loops[0], loops[1:]
    for x in rest:
        middle = (x + np.roll(x, -1, axis=0)) / 2  # corners may lie on the outer loop, middles of edges as well
        if not (inside(outer, *middle.T) | (distance(outer, *middle.T) == 0)).all() or (distance(outer, *middle.T) == 0).all():
            return None
    holes = [x for x in rest if (signed_area(x) > 0) != (signed_area(outer) > 0)]
    if not holes:
        return outer
    return whole if len(holes) == len(rest) else None


def clip_lon(ring: np.ndarray, low: float, high: float) -> np.ndarray:
    """The part of a ring with low <= x <= high (half-plane clipping, for seam cuts)."""
    for bound, sign in ((low, 1.0), (high, -1.0)):
        out = []
        for p, q in zip(ring, np.roll(ring, -1, axis=0)):
            inp, inq = sign * (p[0] - bound) >= 0, sign * (q[0] - bound) >= 0
            if inp:
                out.append(p)
            if inp != inq:
                t = (bound - p[0]) / (q[0] - p[0])
                out.append(np.array([bound, p[1] + t * (q[1] - p[1])]))
        ring = np.array(out)
        if len(ring) < 3:
            return np.zeros((0, 2))
    return ring


def split_seam(ring: np.ndarray, lat_max: float = 90.0) -> list[np.ndarray]:
    """Pieces of a ring brought back into [-180, 180] x [-lat_max, lat_max]."""
    pieces = []
    for shift in (-360.0, 0.0, 360.0):
        part = clip_lon(ring + np.array([shift, 0.0]), -180.0, 180.0)
        if len(part):
            part = clip_lon(part[:, ::-1], -lat_max, lat_max)[:, ::-1] if len(part) else part
        if len(part) >= 3 and np.ptp(part[:, 0]) > 0 and np.ptp(part[:, 1]) > 0:
            pieces.append(part)
    return pieces
