"""Small joins inside one task: relations of a bounded neighbourhood as arrays of masks."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_, or_

import numpy as np


def project(rows: np.ndarray, positions: list[int]) -> np.ndarray:
    out = np.zeros(len(rows), np.int64)
    for i, p in enumerate(positions):
        out |= ((rows >> p) & 1) << i
    return out


def natural_join(left: tuple[list[int], np.ndarray], right: tuple[list[int], np.ndarray]) -> tuple[list[int], np.ndarray]:
    """The join over ascending union bits; rows distinct and ascending."""
    (lb, lr), (rb, rr) = left, right
    bits = sorted({*lb, *rb})
    place = {b: i for i, b in enumerate(bits)}
    lift = lambda own, rows: sum((((rows >> i) & 1) << place[b] for i, b in enumerate(own)), np.zeros(len(rows), np.int64))
    shared = sum(1 << place[b] for b in set(lb) & set(rb))
    l, r = lift(lb, lr), lift(rb, rr)
    r = r[np.argsort(r & shared, kind="stable")]
    keys = r & shared
    lo, hi = np.searchsorted(keys, l & shared, "left"), np.searchsorted(keys, l & shared, "right")
    n = hi - lo
    at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return bits, np.unique(np.repeat(l, n) | r[at])


def join_project(anchor: tuple[list[int], np.ndarray], others: list[tuple[list[int], np.ndarray]]) -> tuple[np.ndarray, int]:
    """The anchor's rows that the join supports, and the most rows on the way. Next is always the table with most bits in common."""
    joined, rest, peak = anchor, list(others), len(anchor[1])
    while rest:
        k = min(range(len(rest)), key=lambda i: (-len(set(rest[i][0]) & set(joined[0])), len(rest[i][1]), i))
        joined = natural_join(joined, rest.pop(k))
        peak = max(peak, len(joined[1]))
    bits, rows = joined
    return np.unique(project(rows, [bits.index(b) for b in anchor[0]])), peak


def latent_split(bits: list[int], rows: np.ndarray) -> tuple[list[int], list[int], list[list[tuple[int, int]]]] | None:
    """A split into two sides joined by few new bits: the bipartite graph of side values is
    covered by the fewest closed bicliques; None if no split makes every factor smaller than the
    table. Least arity first, then fewest new bits, fewest bicliques and first side. Sides of all sizes are
    tried, with all their values and pairs. Gives left bits, right bits and, for each biclique, its
    (left value, right value) pairs."""
    k = len(bits)
    if k < 4:
        return None
    sides: dict[int, list[int]] = {}
    for mask in range(1, 1 << (k - 1)):
        sides.setdefault(max(mask.bit_count(), k - mask.bit_count()), []).append(mask)
    least = dict.fromkeys(range(1, 1 << (k - 1)), 0)  # bicliques that a split takes, as far as is known
    for arity in range(min(sides), k):
        for largest in range(arity, min(sides) - 1, -1):
            # fewer bicliques would have made a smaller arity
            for most in range((1 << (arity - largest)) // 2 + 1, (1 << (arity - largest)) + 1):
                for mask in sides[largest]:
                    if least[mask] > most:
                        continue
                    left, right = ([i for i in range(k) if mask >> i & 1 == one] for one in (1, 0))
                    least[mask], find = _covers(project(rows, left), project(rows, right))
                    if least[mask] <= most and (cover := find(most)) is not None:
                        return [bits[i] for i in left], [bits[i] for i in right], cover
                    least[mask] = max(least[mask], most + 1)
    return None


def _biclique_cover(pairs: list[tuple[int, int]], lefts: list[int], most: int | None = None) -> list[list[tuple[int, int]]] | None:
    """The fewest closed bicliques that cover the pairs, or None if that takes more than `most`."""
    limit, find = _covers(*np.array(pairs, np.int64).T)
    while most is None or limit <= most:
        if (found := find(limit)) is not None:
            return found
        limit += 1
    return None


def _covers(left: np.ndarray, right: np.ndarray) -> tuple[int, Callable[[int], list[list[tuple[int, int]]] | None]]:
    """How many bicliques a cover of the pairs (left[i], right[i]) takes at least, and the search for one of at most as many
    closed bicliques as it is told, exact for any number of values and pairs. Values with the same
    partners count once. A pair goes without saying if another's bicliques can all take it in; the rest
    are vertices that conflict unless they can share a biclique: a cover colours them, since pairs
    that can share one each with each can all together."""
    (ls, i), (rs, j) = (np.unique(x, return_inverse=True) for x in (left, right))
    whole = np.zeros((len(ls), len(rs)), bool)
    whole[i, j] = True
    same_l, same_r = _alike(whole), _alike(whole.T)
    held = whole[np.ix_([g[0] for g in same_l], [g[0] for g in same_r])]
    one = held.astype(np.float32)
    within = [x @ x.T == x.sum(1) for x in (one, one.T)]  # [y, x]: all partners of x are y's
    bare = held & (within[0] @ one @ within[1].T < 1.5)  # no other pair of such two values
    pairs = np.argwhere(bare)
    pairs = pairs[np.argsort((one @ bare.T.astype(np.float32) @ one)[bare], kind="stable")].tolist()  # by how many can share a biclique
    # each of most bicliques has a value or not: there are 2^most - 1 sets of partners
    least, alone, free = max(held.shape).bit_length(), 0, bare.copy()
    for a, b in pairs:
        if free[a, b]:  # shares a biclique with none of those counted
            alone += 1
            free[np.ix_(held[:, b], held[a])] = False

    def find(most: int) -> list[list[tuple[int, int]]] | None:
        by_l, by_r = ([int.from_bytes(np.packbits(x, bitorder="little").tobytes(), "little") for x in m] for m in (held, held.T))
        of_l, of_r = [0] * len(by_l), [0] * len(by_r)
        for e, (a, b) in enumerate(pairs):
            of_l[a] |= 1 << e
            of_r[b] |= 1 << e
        reach_l, reach_r = ([reduce(or_, (of[x] for x in _ones(own))) for own in by] for of, by in ((of_r, by_l), (of_l, by_r)))
        found = _classes([reach_l[a] & reach_r[b] for a, b in pairs], most)
        return None if found is None else [closed(by_l, members) for members in found]

    def closed(by_l: list[int], members: int) -> list[tuple[int, int]]:
        partners = reduce(and_, (by_l[pairs[e][0]] for e in _ones(members)))
        owners = [a for a, x in enumerate(by_l) if x & partners == partners]
        return sorted((int(ls[x]), int(rs[y])) for a in owners for x in same_l[a] for b in _ones(partners) for y in same_r[b])

    return max(least, alone), find


def _alike(m: np.ndarray) -> list[list[int]]:
    """Groups of equal rows, by first row."""
    groups: dict[bytes, list[int]] = {}
    for i, row in enumerate(m):
        groups.setdefault(row.tobytes(), []).append(i)
    return list(groups.values())


def _ones(mask: int) -> Iterator[int]:
    while mask:
        yield (mask & -mask).bit_length() - 1
        mask &= mask - 1


def _apart(near: list[int], left: int) -> int:
    """Vertices of left that all conflict with each other, found greedily."""
    n = 0
    while left:
        n += 1
        left &= ~near[(left & -left).bit_length() - 1]
    return n


def _classes(near: list[int], most: int) -> list[int] | None:
    """The vertices in at most `most` classes (masks) without conflicts, or None if that takes more: depth first, next always
    a vertex that the fewest classes can take. near[v] has the vertices without conflict with v; first ones conflict most."""
    waiting: list[tuple[int, list[int], list[int]]] = [((1 << len(near)) - 1, [], [])]  # vertices left, what each class can take, what it has
    while waiting:
        left, takes, has = waiting.pop()
        while left:
            at_least = [left] + [0] * (len(takes) + 1)  # by number of classes that can take a vertex
            for n, x in enumerate(takes, 1):
                for c in range(n, 0, -1):
                    at_least[c] |= at_least[c - 1] & x
            new = left & ~at_least[1]
            if new and _apart(near, new) > most - len(takes):
                break
            c = next(c for c in range(len(takes) + 1) if left & ~at_least[c + 1])
            fewest = left & ~at_least[c + 1]
            v = (fewest & -fewest).bit_length() - 1
            left ^= 1 << v
            options = sorted(((x & left & ~near[v]).bit_count(), n) for n, x in enumerate(takes) if x >> v & 1)
            if options and not options[0][0]:  # a class loses nothing by it
                has = [x | 1 << v if n == options[0][1] else x for n, x in enumerate(has)]
                continue
            states = [([x & near[v] if n == k else x for n, x in enumerate(takes)], [x | 1 << v if n == k else x for n, x in enumerate(has)]) for _, k in options]
            if len(takes) < most:
                states.append(([*takes, near[v]], [*has, 1 << v]))
            (takes, has), *others = states
            waiting += [(left, *x) for x in reversed(others)]
        else:
            return has
    return None


def loose_parts(cubes: np.ndarray, arity: int) -> Iterator[tuple[int, list[list[int]]]]:
    """For each set of positions (a mask) that leaves two or more: for each of the relations, which are cubes of
    2^arity booleans, the other positions in masks of those connected by dependent pairs. A bit of a packed word stands for a relation."""
    n = len(cubes)
    words = np.packbits(cubes.T, axis=1)
    seen = {(1 << arity) - 1: words.reshape((2,) * arity + (-1,))}  # axis i is position arity - 1 - i
    axes = lambda mask: [p for p in reversed(range(arity)) if mask >> p & 1]
    at = lambda mask, p, value: (slice(None),) * axes(mask).index(p) + (value,)
    for mask in sorted(range(1, (1 << arity) - 1), key=lambda m: -m.bit_count()):
        gone = next(p for p in range(arity) if not mask >> p & 1)
        whole = seen[mask | 1 << gone]
        seen[mask] = whole[at(mask | 1 << gone, gone, 0)] | whole[at(mask | 1 << gone, gone, 1)]
    for shared in range(1 << arity):
        free = [p for p in range(arity) if not shared >> p & 1]
        if len(free) < 2:
            continue
        pairs = list(itertools.combinations(free, 2))
        tied = []
        for a, b in pairs:
            mask = shared | 1 << a | 1 << b
            low, high = (seen[mask][at(mask, b, v)] for v in (0, 1))
            of = at(mask ^ 1 << b, a, 0), at(mask ^ 1 << b, a, 1)
            # a set of values of two positions is a product of two sets just if both diagonals are whole, or neither
            tied.append(np.bitwise_or.reduce(((low[of[0]] & high[of[1]]) ^ (low[of[1]] & high[of[0]])).reshape(-1, words.shape[1]), axis=0))
        codes, which = np.unique(np.unpackbits(np.stack(tied), axis=1, count=n).T, axis=0, return_inverse=True)
        made = [_connected(free, [p for p, t in zip(pairs, code, strict=True) if t]) for code in codes]
        yield shared, [made[i] for i in which.ravel()]


def _connected(nodes: list[int], edges: list[tuple[int, int]]) -> list[int]:
    """The nodes in masks of those that edges connect."""
    parts = [1 << p for p in nodes]
    for a, b in edges:
        edge = 1 << a | 1 << b
        parts = [x for x in parts if not x & edge] + [sum(x for x in parts if x & edge)]
    return sorted(parts)
