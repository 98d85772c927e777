"""Plain single-machine nearest neighbours and density clusters, for the tests."""

import itertools

import numpy as np


def nearest(vectors, k):
    """(u, rank, v, distance) over a dict of key -> vector, by all pairs."""
    keys = sorted(vectors)
    width = max((len(v) for v in vectors.values()), default=0)
    x = np.zeros((len(keys), width))
    for i, key in enumerate(keys):
        x[i, :len(vectors[key])] = vectors[key]
    out = []
    for i, key in enumerate(keys):
        d = np.round(np.sqrt(((x - x[i]) ** 2).sum(axis=1)), 9)
        order = [j for j in np.lexsort((keys, d)).tolist() if j != i][:k]
        out += [(key, r, keys[j], d[j]) for r, j in enumerate(order, 1)]
    return out


def forest(graph, min_samples):
    """The edges (w, u, v) of the minimum spanning forest, ascending, by Kruskal."""
    core, pairs = {}, {}
    for u, rank, v, d in graph:
        if rank < min_samples:
            core[u] = max(core.get(u, 0.0), d)
        pairs[min(u, v), max(u, v)] = d
    parent = {u: u for u, *_ in graph}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    out = []
    for w, u, v in sorted((max(d, core[u], core[v]), u, v) for (u, v), d in pairs.items()):
        a, b = find(u), find(v)
        if a != b:
            parent[a] = b
            out.append((w, u, v))
    return out


def density_clusters(keys, graph, min_size, min_samples):
    """{key: cluster}: the tree is taken apart from the top, cluster by cluster, and the clusters chosen from below."""
    edges = forest(graph, min_samples)
    near = {k: [] for k in keys}
    for w, u, v in edges:
        near[u].append((w, u, v))
        near[v].append((w, u, v))

    def reach(start, below):
        """The points that edges lighter than ``below`` join to ``start``."""
        seen, todo = {start}, [start]
        while todo:
            x = todo.pop()
            for e in near[x]:
                for y in e[1:]:
                    if e < below and y not in seen:
                        seen.add(y)
                        todo.append(y)
        return seen

    density = lambda e: 1.0 / max(e[0], 1e-9)
    top = (float("inf"),)
    parts, left = [], set(keys)
    while left:
        parts.append(reach(min(left), top))
        left -= parts[-1]
    parts = [p for p in parts if len(p) >= min_size]
    clusters = []  # points, the sum of densities, those below

    def take_apart(points, birth):
        inside, total, gone = points, 0.0, 0
        while True:
            heaviest = max(e for x in inside for e in near[x] if e[1] in inside and e[2] in inside)
            a, b = (reach(x, heaviest) for x in heaviest[1:])
            at = density(heaviest)
            if min(len(a), len(b)) >= min_size:
                kids = [take_apart(s, at) for s in (a, b)]
                total += at * len(inside)
                break
            if max(len(a), len(b)) < min_size:
                kids = []
                total += at * len(inside)
                break
            few, inside = sorted((a, b), key=len)
            total += at * len(few)
            gone += len(few)
        return points, total - birth * len(points), kids

    def choose(c):
        """(the best sum, the clusters that make it)."""
        points, stability, kids = c
        below = [choose(k) for k in kids]
        if kids and stability < sum(b for b, _ in below):
            return sum(b for b, _ in below), list(itertools.chain(*(s for _, s in below)))
        return stability, [points]

    for p in parts:
        clusters.append(take_apart(p, 0.0))
    if len(clusters) > 1:
        chosen = [s for c in clusters for s in choose(c)[1]]
    else:
        chosen = [s for c in clusters for k in c[2] for s in choose(k)[1]]
    out = dict.fromkeys(keys, -1)
    for i, points in enumerate(sorted(chosen, key=lambda s: (-len(s), min(s)))):
        out.update(dict.fromkeys(points, i))
    return out
