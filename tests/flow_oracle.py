"""Cheapest flows by successive shortest paths, held in one process: what chains are tested against."""

from __future__ import annotations

import heapq


def cheapest_flow(edges: list[tuple[str, str, str, int, float]], source: str = "S", sink: str = "T", reward: float = 0.0) -> list[tuple[str, int]]:
    """Edges (id, src, dst, capacity, cost) of the cheapest flow of at least one unit.

    Further units follow while a path costs less than ``reward``. Paths are found by successive shortest paths
    with reduced costs; equal costs go to the edges of the lesser id.
    """
    arcs: list[list] = []  # to, room, cost, id or None for a way back
    out: dict[str, list[int]] = {}
    for edge_id, src, dst, capacity, cost in sorted(edges):
        for a, b, room, c, name in ((src, dst, capacity, cost, edge_id), (dst, src, 0, -cost, None)):
            out.setdefault(a, []).append(len(arcs))
            out.setdefault(b, [])
            arcs.append([b, room, c, name])
    height = dict.fromkeys(out, 0.0)
    for _ in range(len(out)):  # Bellman-Ford, for negative costs
        changed = False
        for a, mine in out.items():
            for i in mine:
                b, room, c, _n = arcs[i]
                if room and (new := height[a] + c) < height[b] - 1e-12:
                    height[b], changed = new, True
        if not changed:
            break
    units = 0
    while source in out and sink in out:
        dist, via, heap = {source: 0.0}, {}, [(0.0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > dist[a] + 1e-12:
                continue
            for i in out[a]:
                b, room, c, _n = arcs[i]
                if room and (new := d + c + height[a] - height[b]) < dist.get(b, float("inf")) - 1e-12:
                    dist[b], via[b] = new, i
                    heapq.heappush(heap, (new, b))
        if sink not in dist:
            break
        price = dist[sink] + height[sink] - height[source]
        if units and price >= reward:
            break
        for n in height:
            height[n] += dist.get(n, dist[sink])
        node = sink
        while node != source:
            arcs[via[node]][1] -= 1
            arcs[via[node] ^ 1][1] += 1
            node = arcs[via[node] ^ 1][0]
        units += 1
    return [(a[3], arcs[i ^ 1][1]) for i, a in enumerate(arcs) if a[3] is not None and arcs[i ^ 1][1] > 0]


def unit_paths(flow: dict[str, int], ends: dict[str, tuple[str, str]], source: str = "S", sink: str = "T") -> list[list[str]]:
    """A flow as paths of one unit each; of several edges the one of the least id goes first."""
    left, paths = dict(flow), []
    while any(left[e] and ends[e][0] == source for e in left):
        node, path = source, [source]
        while node != sink:
            edge = min(e for e in left if left[e] and ends[e][0] == node)
            left[edge] -= 1
            node = ends[edge][1]
            path.append(node)
        paths.append(path)
    return paths


def persons(edges: list[tuple[str, str, str, str, int, float]], reward: float = 0.0) -> list[tuple[str, str, int, str]]:
    """key, person_id, step and node of the cheapest flow of each key's edges (key, edge_id, src, dst, capacity, cost)."""
    out = []
    for key in sorted({e[0] for e in edges}):
        mine = [e[1:] for e in edges if e[0] == key]
        flow = dict(cheapest_flow(mine, reward=reward))
        for i, path in enumerate(unit_paths(flow, {e[0]: (e[1], e[2]) for e in mine}), 1):
            out += [(key, f"p{i:04d}", j, n) for j, n in enumerate(path)]
    return sorted(out)
