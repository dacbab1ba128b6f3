"""Nearest others and how many are near, among the places of one frame.

Places lie in strips of about one y, each sorted by x, so a circle meets a strip in one range: what lies surely inside is counted by its
ends, only what lies about the circle's edge is looked at. The nearest is sought from strip to strip until no nearer one can be there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def _distance(dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    return np.sqrt(dx * dx + dy * dy)


class _Strips:
    """Places by strip and x. Searches go by one key for all strips, which is rounded; so ranges are ``slack`` wider."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        levels, most = np.unique(y), max(1, int(2 * np.sqrt(len(y))))
        first = levels if len(levels) <= most else levels[:: -(-len(levels) // most)]  # the least y of each strip
        strip = np.searchsorted(first, y, "right") - 1
        self.order = np.lexsort((x, strip))
        self.x, self.y, strip = x[self.order], y[self.order], strip[self.order]
        ends = np.searchsorted(strip, np.arange(len(first) + 1))
        self.start, self.stop, self.n = ends[:-1], ends[1:], len(first)
        self.low, self.high = np.minimum.reduceat(self.y, self.start), np.maximum.reduceat(self.y, self.start)
        self.least, self.width = float(x.min()), float(x.max() - x.min()) * 2 + 1
        self.key, self.strip = self._key(strip, self.x), strip
        self.slack = 8 * np.finfo(float).eps * (self.width * (self.n + 1) + abs(self.least))

    def _key(self, strip: np.ndarray, x: np.ndarray) -> np.ndarray:
        return strip * self.width + np.clip(x - self.least, -self.width / 4, self.width * 3 / 4)

    def before(self, strip: np.ndarray, x: np.ndarray, side: str) -> np.ndarray:
        return np.clip(np.searchsorted(self.key, self._key(strip, x), side), self.start[strip], self.stop[strip])

    def gaps(self, strip: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How near and how far in y a strip's places may be."""
        low, high = self.low[strip], self.high[strip]
        return np.maximum(0.0, np.maximum(low - y, y - high)), np.maximum(np.abs(y - low), np.abs(high - y))


def _members(low: np.ndarray, high: np.ndarray, at_once: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(range, place) of all places in ranges, some million at once."""
    size = np.maximum(high - low, 0)
    some = np.flatnonzero(size)
    total = np.cumsum(size[some])
    done = 0
    while done < len(some):
        base = total[done - 1] if done else 0
        stop = max(done + 1, int(np.searchsorted(total, base + at_once, "right")))
        mine = some[done:stop]
        who = np.repeat(mine, size[mine])
        nth = np.arange(len(who)) - np.repeat(np.cumsum(size[mine]) - size[mine], size[mine])
        yield who, low[who] + nth
        done = stop


def _near(s: _Strips, x: np.ndarray, y: np.ndarray, own: np.ndarray, radius: float) -> np.ndarray:
    out, r = np.zeros(len(x), np.int64), radius * (1 + 1e-12)
    for step in range(1 - s.n, s.n):
        ask = np.flatnonzero((own + step >= 0) & (own + step < s.n))
        strip = own[ask] + step
        near, far = s.gaps(strip, y[ask])
        reached = near <= r
        ask, strip, near, far = ask[reached], strip[reached], near[reached], far[reached]
        if not len(ask):
            continue
        half = np.sqrt(np.maximum(r * r - near * near, 0.0)) * (1 + 1e-9) + s.slack + 1e-6 * radius * (near > 0.999 * r)
        sure = np.sqrt(np.maximum(radius * radius - far * far, 0.0)) * (1 - 1e-9) - s.slack
        sure = np.where(far < radius * (1 - 1e-6), sure, -1.0)
        lo, hi = s.before(strip, x[ask] - half, "left"), s.before(strip, x[ask] + half, "right")
        inside = sure > 0
        ilo = np.where(inside, np.clip(s.before(strip, x[ask] - sure, "left"), lo, hi), hi)
        ihi = np.where(inside, np.clip(s.before(strip, x[ask] + sure, "right"), ilo, hi), hi)
        out[ask] += ihi - ilo
        for low, high in ((lo, ilo), (ihi, hi)):
            for who, at in _members(low, high):
                hit = _distance(x[ask[who]] - s.x[at], y[ask[who]] - s.y[at]) <= radius
                out += np.bincount(ask[who[hit]], minlength=len(out))
    return out - 1  # itself


def _nearest(s: _Strips, x: np.ndarray, y: np.ndarray, own: np.ndarray, place: np.ndarray) -> np.ndarray:
    best = np.full(len(x), np.inf)
    for step in range(s.n):
        left = False
        for sign in (1, -1) if step else (1,):
            there = own + sign * step
            ask = np.flatnonzero((there >= 0) & (there < s.n))
            ask = ask[s.gaps(there[ask], y[ask])[0] < best[ask]]
            if not len(ask):
                continue
            left, strip = True, there[ask]
            at = s.before(strip, x[ask], "left") if step else place[ask]
            for other in (at - 1, at if step else at + 1):
                ok = (other >= s.start[strip]) & (other < s.stop[strip])
                w, o = ask[ok], other[ok]
                best[w] = np.minimum(best[w], _distance(x[w] - s.x[o], y[w] - s.y[o]))
            wide = s.high[strip] > s.low[strip]  # of more than one y: the nearest by x need not be the nearest
            # rounded keys may hide the very nearest by x, so places within the slack are looked at too
            reach = np.where(wide, best[ask], s.slack)
            reach = np.where(np.isfinite(reach), reach * (1 + 1e-9) + s.slack, np.inf)
            lo, hi = s.before(strip, x[ask] - reach, "left"), s.before(strip, x[ask] + reach, "right")
            for who, o in _members(lo, hi):
                w = ask[who]
                other = o != place[w]
                w, o = w[other], o[other]
                np.minimum.at(best, w, _distance(x[w] - s.x[o], y[w] - s.y[o]))
        if step and not left:
            break
    return best


def nearest_and_near(who: np.ndarray, x: np.ndarray, y: np.ndarray, radius: float) -> tuple[list[float | None], np.ndarray]:
    """Per row the distance to the nearest row of another name (None if there is none), and how many such rows are within ``radius``.

    A name with several rows gets the least and the sum of theirs; those rows and such with an infinite place are compared with all.
    """
    _, name, times = np.unique(who.astype(str), return_inverse=True, return_counts=True)
    finite = np.isfinite(x) & np.isfinite(y)
    dist, near = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
    if finite.any():
        places = np.flatnonzero(finite)
        s = _Strips(x[places], y[places])
        mine = places[s.order]  # rows in the order of the strips
        ask = np.flatnonzero(times[name[mine]] == 1)
        if radius >= 0:
            near[mine[ask]] = _near(s, s.x[ask], s.y[ask], s.strip[ask], radius)
        dist[mine[ask]] = _nearest(s, s.x[ask], s.y[ask], s.strip[ask], ask)
    for i in np.flatnonzero(~finite | (times[name] > 1)):
        other = name != name[i]
        with np.errstate(invalid="ignore"):
            d = _distance(x[other] - x[i], y[other] - y[i])
        d = d[~np.isnan(d)]
        dist[i], near[i] = (d.min() if len(d) else np.nan), (d <= radius).sum()
    for n in np.flatnonzero(times > 1):
        rows = name == n
        dist[rows], near[rows] = np.fmin.reduce(dist[rows]), near[rows].sum()
    alone = times[name] == len(x)
    return [None if a else float(d) for a, d in zip(alone, dist, strict=True)], near


def first_within(there: tuple[np.ndarray, ...], asking: tuple[np.ndarray, ...], radius: float, nearest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows of ``asking`` have a row of ``there`` of another name within ``radius``, and name and distance of the first: by distance,
    then name, or (not ``nearest``) by name, then distance. Both sides: names (numbers), x and y; places without end meet nothing.
    """
    name, x, y = (v[np.isfinite(there[1]) & np.isfinite(there[2])] for v in there)
    order = np.lexsort((name, y, x))
    name, x, y = name[order], x[order], y[order]
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])[: len(x)]
    other = new | np.concatenate([[True], name[1:] != name[:-1]])[: len(x)]
    name, x, y, new = name[other], x[other], y[other], new[other]
    # of the names at one place only the two least can be first for anybody
    kept = new | np.concatenate([[True], new[:-1]])[: len(x)]
    name, x, y = name[kept], x[kept], y[kept]
    ask = np.flatnonzero(np.isfinite(asking[1]) & np.isfinite(asking[2]))
    none = np.zeros(0, np.int64)
    if not len(x) or not len(ask):
        return none, none, np.zeros(0)
    size = radius * (1 + 1e-6) or 1.0
    cell = lambda v: np.clip(np.floor(v / size), -(2**30), 2**30).astype(np.int64)
    low = min(cell(y).min(), cell(asking[2][ask]).min()) - 1
    rows = max(cell(y).max(), cell(asking[2][ask]).max()) + 2 - low
    key = cell(x) * rows + cell(y) - low
    order = np.argsort(key, kind="stable")
    key, name, x, y = key[order], name[order], x[order], y[order]
    own = cell(asking[1][ask]) * rows + cell(asking[2][ask]) - low
    beside = (own[:, None] + rows * np.arange(-1, 2)).reshape(-1)  # three columns of cells, each a range of keys
    low, high = np.searchsorted(key, beside - 1, "left"), np.searchsorted(key, beside + 1, "right")
    hits, firsts, dists = [none], [none], [np.zeros(0)]
    total = np.cumsum((high - low).reshape(-1, 3).sum(axis=1))
    done = 0
    while done < len(ask):
        stop = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + (1 << 20), "right")))
        part = slice(3 * done, 3 * stop)
        width = high[part] - low[part]
        which = np.repeat(np.arange(len(width)), width)
        at = np.arange(len(which)) - np.repeat(np.cumsum(width) - width, width) + low[part][which]
        who = ask[done + which // 3]
        dist = _distance(x[at] - asking[1][who], y[at] - asking[2][who])
        ok = (dist <= radius) & (name[at] != asking[0][who])
        who, dist, given = who[ok], dist[ok], name[at[ok]]
        if len(who):
            for by_distance in (nearest, not nearest):
                by, start = dist if by_distance else given, np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
                first = by == np.repeat(np.minimum.reduceat(by, start), np.diff(np.append(start, len(who))))
                who, dist, given = who[first], dist[first], given[first]
            start = np.concatenate([[True], who[1:] != who[:-1]])
            hits.append(who[start])
            firsts.append(given[start])
            dists.append(dist[start])
        done = stop
    return np.concatenate(hits), np.concatenate(firsts), np.concatenate(dists)
