"""Cutting one component inside a task: thresholds, then communities, until its parts are small enough or nothing divides them."""

from __future__ import annotations

import numpy as np

from alertmill.operators.components import roots

#: Rounds of moves on a level of communities.
ROUNDS = 10


def cut_component(a, b, score, strong, turns_a, turns_b, largest: int, steps: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Nodes, and the smallest node of each one's part. Edges a-b join all nodes; turns: bit i, whether a node may move in round i."""
    nodes, first, place = np.unique(np.concatenate([a, b]), return_index=True, return_inverse=True)
    turns = np.concatenate([turns_a, turns_b])[first]
    a, b = place[: len(a)], place[len(a) :]
    label, of = np.empty(len(nodes), np.int64), np.empty(len(nodes), np.int64)
    todo = [(np.arange(len(nodes)), np.arange(len(a)))]
    while todo:
        members, edges = todo.pop()
        part = _parts(members, a[edges], b[edges], score[edges], strong[edges], turns, steps) if len(members) > largest else None
        if part is None:
            label[members] = members[0]
            continue
        label[members] = members[part]  # of parts that are small enough
        of[members] = part
        order = np.argsort(part, kind="stable")
        names, starts, sizes = np.unique(part[order], return_index=True, return_counts=True)
        large = sizes > largest
        inside = edges[of[a[edges]] == of[b[edges]]]
        mine = inside[np.argsort(of[a[inside]], kind="stable")]
        lows, highs = (np.searchsorted(of[a[mine]], names[large], side) for side in ("left", "right"))
        for start, size, low, high in zip(starts[large], sizes[large], lows, highs, strict=True):
            todo.append((members[order[start : start + size]], mine[low:high]))
    return nodes, nodes[label]


def _parts(members, a, b, score, strong, turns, steps) -> np.ndarray | None:
    """The part of each member: of the lowest threshold whose strong edges leave several, else its community; None: nothing divides them."""
    x, y = np.searchsorted(members, a), np.searchsorted(members, b)
    for t in steps:
        use = strong & (score >= t)
        part = roots(len(members), x[use], y[use])
        if part.any():
            return part
    part = communities(x, y, score, turns[members])
    return part if part.any() else None


def communities(a: np.ndarray, b: np.ndarray, w: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """The smallest node of each node's community; all 0 if one community is the best. Nodes are 0..n-1, all with an edge."""
    n = len(turns)
    of = np.arange(n)
    while True:
        names, place = np.unique(of, return_inverse=True)
        x, y = place[a], place[b]
        pairs, inverse = np.unique(np.minimum(x, y) * len(names) + np.maximum(x, y), return_inverse=True)
        label, quality, gained = _level(pairs // len(names), pairs % len(names), np.bincount(inverse, w), turns[names])
        if not gained:
            break
        of = names[label][place]
    return of if quality > 1e-12 else np.zeros(n, np.int64)


def _level(a: np.ndarray, b: np.ndarray, w: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, float, bool]:
    """After the best round of moves: the smallest node of each node's community, the modularity, and whether it rose."""
    n = len(turns)
    k = np.bincount(a, w, n) + np.bincount(b, w, n)
    m2 = 2 * w.sum()
    apart = a != b
    x, y, both = np.concatenate([a[apart], b[apart]]), np.concatenate([b[apart], a[apart]]), np.concatenate([w[apart], w[apart]])
    loops = 2 * w[~apart].sum()

    def modularity(label: np.ndarray) -> float:
        totals = np.bincount(label, k, n)
        return (both[label[x] == label[y]].sum() + loops) / m2 - (totals * totals).sum() / (m2 * m2)

    label = np.arange(n)
    best, quality = label, modularity(label)
    start = quality
    for i in range(ROUNDS):
        pairs, inverse = np.unique(np.concatenate([x * n + label[y], np.arange(n) * n + label]), return_inverse=True)
        inside = np.bincount(inverse, np.concatenate([both, np.zeros(n)]))
        node, to = pairs // n, pairs % n
        totals = np.bincount(label, k, n)
        gain = np.round(inside - k[node] * (totals[to] - np.where(to == label[node], k[node], 0.0)) / m2, 12)
        order = np.lexsort((to, -gain, node))
        choice = to[order[np.searchsorted(node[order], np.arange(n))]]
        label = np.where(turns >> i & 1, choice, label)
        now = modularity(label)
        if now > quality + 1e-12:
            best, quality = label, now
    heads = np.full(n, n)
    np.minimum.at(heads, best, np.arange(n))
    return heads[best], quality, quality > start + 1e-12
