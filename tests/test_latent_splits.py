"""Latent splits cover all sides, values and pairs, against every split with every cover."""

import itertools
import random

import numpy as np
import pytest

from maskspark.functions.kernel import latent_split
from maskspark.operators import decomposition
from maskspark.operators.decomposition import latent_factors, latent_splits, splits
from maskspark.operators.joins import join_all
from maskspark.system import System


def put(value, positions):
    return sum((value >> i & 1) << p for i, p in enumerate(positions))


def score(found):
    """(arity, new bits, bicliques, mask of the first side)."""
    if found is None:
        return None
    left, right, cover = found
    width = (len(cover) - 1).bit_length()
    return max(len(left), len(right)) + width, width, len(cover), sum(1 << p for p in left)


def best_score(arity, rows):
    """The least score, of all splits and all covers by bicliques."""
    scores = []
    for mask in range(1, 1 << (arity - 1)):
        left, right = ([p for p in range(arity) if mask >> p & 1 == one] for one in (1, 0))
        pairs = {(sum((r >> p & 1) << i for i, p in enumerate(left)), sum((r >> p & 1) << i for i, p in enumerate(right))) for r in rows}
        ls = {a for a, _ in pairs}
        cliques = []
        for n in range(1, len(ls) + 1):
            for some in itertools.combinations(sorted(ls), n):
                common = set.intersection(*({b for a, b in pairs if a == x} for x in some))
                if common:
                    cliques.append(set(itertools.product(some, common)))
        largest = max(len(left), len(right))
        for n in range(1, (1 << (arity - 1 - largest)) + 1):
            if any(set().union(*c) == pairs for c in itertools.combinations(cliques, n)):
                width = (n - 1).bit_length()
                scores.append((largest + width, width, n, mask))
                break
    return min(scores, default=None)


@pytest.mark.parametrize("seed", range(3))
def test_against_all_splits_and_covers(seed):
    r = random.Random(seed)
    for _ in range(25):
        arity = r.choice((4, 4, 5))
        rows = sorted({r.randrange(1 << arity) for _ in range(r.randrange(1, 14))})
        assert score(latent_split(list(range(arity)), np.array(rows))) == best_score(arity, rows), (arity, rows)


def hidden(arity, side, states, seed):
    """Rows over a side of the lowest bits and all others, that a few states join: many values and pairs, few bicliques."""
    r = random.Random(seed)
    rows = set()
    for _ in range(states):
        a, b = r.sample(range(1 << side), (1 << side) // 2), r.sample(range(1 << (arity - side)), (1 << (arity - side)) // 2)
        rows |= {x | y << side for x in a for y in b}
    return sorted(rows)


@pytest.mark.parametrize(
    "arity, rows, want",
    [
        (9, [x for x in range(512) if x.bit_count() % 2 == 0], (6, 1)),  # 32 values on a side
        (10, [x for x in range(1024) if x.bit_count() % 2 == 0], (6, 1)),  # five bits on the smaller side
        (8, list(range(1, 256)), (5, 1)),  # 255 pairs
        (8, hidden(8, 3, 4, 1), (7, 2)),
        (10, hidden(10, 5, 4, 2), (7, 2)),
    ],
)
def test_sides_values_and_pairs_without_bound(arity, rows, want):
    found = latent_split(list(range(arity)), np.array(rows))
    assert score(found)[:2] == want
    left, right, cover = found
    assert {put(a, left) | put(b, right) for pairs in cover for a, b in pairs} == set(rows)
    for pairs in cover:
        assert {*pairs} == set(itertools.product({a for a, _ in pairs}, {b for _, b in pairs}))


def test_fewer_new_bits_with_more_values():
    """Twenty values on a side: three bicliques there, where the splits with sixteen values or fewer take more new bits."""
    r = random.Random(7)
    parts = [r.sample(range(32), 8) for _ in range(3)]
    rows = sorted({a | b << 3 for state, own in zip((1, 2, 4), parts, strict=True) for a in range(8) if a & state for b in own})
    assert len({x >> 3 for x in rows}) > 16
    assert score(latent_split(list(range(8)), np.array(rows)))[:2] == (7, 2)


def test_dense_relations_end():
    r = np.random.default_rng(0)
    for n in (128, 179, 230):
        rows = np.sort(r.choice(256, n, replace=False))
        found = latent_split(list(range(8)), rows)
        if found is not None:
            left, right, cover = found
            assert {put(a, left) | put(b, right) for pairs in cover for a, b in pairs} == set(rows.tolist())


def test_system_of_wide_sides(spark):
    parity = [x for x in range(512) if x.bit_count() % 2 == 0]
    held = [(list(range(10, 19)), parity), (list(range(8)), list(range(1, 256)))]
    system = System.of(spark, held)
    assert {(r.kind, r.latent_bits, r.max_arity) for r in splits(system).collect()} == {("latent", 1, 6), ("latent", 1, 5)}
    factors = latent_factors(system, latent_splits(system).cache()).saved()
    for t, (bits, rows) in enumerate(held):
        both = factors.only(spark.createDataFrame([(2 * t,), (2 * t + 1,)], "table_id long"))
        assert join_all(both).keep_bits(spark.createDataFrame([(b,) for b in bits], "bit long")).local() == [(bits, rows)]


@pytest.mark.parametrize("canonical", [True, False])
def test_equal_rows_split_alike(spark, canonical):
    """Relations with the same rows over other bits are worked on once, and each is named by its own bits."""
    parity, product = [x for x in range(16) if x.bit_count() % 2 == 0], [0, 1, 6, 7]
    held = [([1, 2, 3, 4], parity), ([5, 6, 7, 9], parity), ([3, 5, 8, 9], parity), ([1, 2, 3], product), ([4, 6, 8], product), ([1, 5, 9], [1, 2, 4]), ([2, 6, 8], [1, 2, 4]), ([1, 9], [0, 3]), ([1, 2, 9], [])]
    system = System.of(spark, held)
    got = {r.table_id: (r.kind, sorted({*r.left_bits, *r.right_bits}), r.latent_bits, r.max_arity) for r in splits(system, canonical=canonical).collect()}
    kinds = {4: ("latent", 1, 3), 3: ("projection", 0, 2)}
    want = {t: (kinds[len(b)][0], b, *kinds[len(b)][1:]) for t, (b, _) in enumerate(held[:5])} | {t: ("none", [], 0, 3) for t in (5, 6)}
    assert got == want
    assert sorted(r.table_id for r in decomposition._shapes(system, 3, 15)[1].relations.collect()) == [0, 3, 5]
