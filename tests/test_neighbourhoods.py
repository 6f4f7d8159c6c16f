"""Neighbourhoods that grow for all anchors at once, against one anchor after the other in plain Python."""

import random
from collections.abc import Callable

import pytest

from maskspark.operators import local_consistency as local
from maskspark.system import System

Schemas = dict[int, tuple[frozenset[int], int]]


def _by_bit(relations: Schemas) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for t, (bits, _) in relations.items():
        for b in bits:
            out.setdefault(b, []).append(t)
    return out


def _grow(anchor: int, relations: Schemas, around: Callable[[set[int]], set[int]], order: Callable[[int, set[int]], tuple], bits: int, most: int, least: int) -> list[int] | None:
    """Relations added one by one: always the first in order that keeps the union within bits."""
    chosen, union = [anchor], set(relations[anchor][0])
    if len(union) > bits:
        return None
    while len(chosen) < most:
        fits = [t for t in around(union) if t not in chosen and len(union | relations[t][0]) <= bits]
        if not fits:
            break
        chosen.append(min(fits, key=lambda t: order(t, union)))
        union |= relations[chosen[-1]][0]
    return chosen if len(chosen) >= least else None


def neighbourhoods(relations: Schemas, bits: int = 32, most: int = 10, least: int = 3) -> dict[int, list[int]]:
    """Anchor -> itself and its neighbours: most bits in common with the anchor, then fewest new bits, bits, rows, id."""
    index, out = _by_bit(relations), {}
    for a, (own, _) in relations.items():
        near = {t for b in own for t in index[b]} - {a}
        if near and len(near) + 1 >= least:
            found = _grow(a, relations, lambda _, n=near: n, lambda t, u, own=own: (-len(own & relations[t][0]), len(relations[t][0] - u), len(relations[t][0]), relations[t][1], t), bits, most, least)
            if found:
                out[a] = found
    return out


def local_components(relations: Schemas, bits: int = 32, most: int = 12, least: int = 4) -> dict[int, list[int]]:
    """Anchor -> a component grown from all bits chosen so far: most bits in common with them, then with the anchor, fewest new bits, rows, bits, id."""
    index, out = _by_bit(relations), {}
    for a, (own, _) in relations.items():
        found = _grow(a, relations, lambda u: {t for b in u for t in index[b]}, lambda t, u, own=own: (-len(u & relations[t][0]), -len(own & relations[t][0]), len(relations[t][0] - u), relations[t][1], len(relations[t][0]), t), bits, most, least)
        if found:
            out[a] = found
    return out


def triangles(relations: Schemas, bits: int = 32, neighbours: int = 8, pairs: int = 8, shared: int = 1, product: int = 2_000_000) -> dict[int, list[tuple[int, int]]]:
    """Anchor -> pairs of its first neighbours that overlap each other."""
    index, out = _by_bit(relations), {}
    for a, (own, _) in relations.items():
        near = sorted({t for b in own for t in index[b]} - {a}, key=lambda t: (-len(own & relations[t][0]), len(relations[t][0]), relations[t][1], t))[:neighbours]
        found = []
        for i, x in enumerate(near):
            for y in near[i + 1 :]:
                (xb, xn), (yb, yn) = relations[x], relations[y]
                if len(xb & yb) >= shared and xn * yn <= product and len(own | xb | yb) <= bits:
                    found.append(((-len(xb & yb), -len(own & xb) - len(own & yb), len(own | xb | yb), xn * yn, x, y), (x, y)))
        if found:
            out[a] = [p for _, p in sorted(found)[:pairs]]
    return out


@pytest.fixture(scope="module")
def system(spark):
    r = random.Random(12)
    relations = []
    for _ in range(40):
        bits = sorted(r.sample(range(1, 25), r.randint(1, 5)))
        relations.append((bits, sorted(r.sample(range(1 << len(bits)), r.randint(1, 1 << len(bits))))))
    return System.of(spark, relations).canonical().indexed().saved()


def schemas(system):
    return {x.table_id: (frozenset(x.bits), x.row_count) for x in system.sized.collect()}


def groups(frame):
    out = {}
    for x in sorted(frame.collect(), key=lambda x: (x.anchor, x.place)):
        out.setdefault(x.anchor, []).append(x.table_id)
    return out


@pytest.mark.parametrize("limits", [(8, 3, 2), (10, 4, 3), (63, 40, 3), (3, 5, 2)])
def test_neighbourhoods(system, limits):
    """Tight limits decide every choice; loose ones take all neighbours."""
    assert groups(local.neighbourhoods(system, *limits)) == neighbourhoods(schemas(system), *limits)


@pytest.mark.parametrize("limits", [(8, 4, 2), (12, 6, 4), (3, 5, 1)])
def test_components(system, limits):
    assert groups(local.local_components(system, *limits)) == local_components(schemas(system), *limits)


@pytest.mark.parametrize("limits", [(9, 4, 2, 1, 200), (32, 8, 8, 2, 2_000_000), (7, 2, 5, 1, 30)])
def test_triangles(system, limits):
    out = {}
    for x in sorted(local.triangles(system, *limits).collect(), key=lambda x: (x.anchor, x.place)):
        out.setdefault(x.anchor, []).append((x.x, x.y))
    assert out == triangles(schemas(system), *limits)
