"""Lossless projection splits against a search over all pairs of masks."""

import random

import pytest

from maskspark.operators.decomposition import lost_or_added, projection_factors, projection_splits, splits
from maskspark.system import System


def best_split(arity, rows):
    """(left mask, right mask) of the best lossless pair, tried one after the other."""
    full, best = (1 << arity) - 1, None
    for left in range(1, full):
        for right in range(left + 1, full):
            if left | right != full:
                continue
            a, b, common = {r & left for r in rows}, {r & right for r in rows}, left & right
            if sum(x & common == y & common for x in a for y in b) == len(rows):
                sizes = left.bit_count(), right.bit_count()
                score = (max(sizes), len(a) + len(b), sum(sizes), -common.bit_count(), left, right)
                best = min(best, score) if best else score
    return best and best[-2:]


def relations(seed):
    r = random.Random(seed)
    out = []
    for arity in (3, 4, 4, 5, 5, 6):
        some = {r.randrange(1 << arity) for _ in range(r.randrange(1, 1 << arity))}
        out.append((list(range(10, 10 + arity)), sorted(some)))
    chain = sorted({a | b << 1 | c << 2 | d << 3 for a in (0, 1) for b in (0, 1) for c in (0, 1) for d in (0, 1) if a <= b <= c <= d})
    product = sorted({a | b << 3 for a in (0, 3, 5) for b in (1, 6)})
    return [*out, ([1, 2, 3, 4], chain), ([1, 2, 3, 4, 5, 6], product), ([1, 2], [0, 3]), ([1, 2, 3], []), ([1, 2, 3], [5]), ([], [0]), ([1, 2, 3], list(range(8)))]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    held = relations(seed)
    system = System.of(spark, held)
    found = projection_splits(system)
    got = {r.table_id: (r.left, r.right) for r in found.collect()}
    want = {i: best_split(len(b), rows) for i, (b, rows) in enumerate(held) if len(b) >= 3 and rows}
    assert got == {i: x for i, x in want.items() if x}
    factors = projection_factors(system, found)
    assert lost_or_added(system, factors).collect() == []
    assert {r.table_id for r in factors.sized.collect()} == {2 * i + k for i in got for k in (0, 1)}


def test_factors_that_lost_a_row(spark):
    system = System.of(spark, [([1, 2, 3], [0, 1, 6, 7])])
    factors = projection_factors(system, projection_splits(system)).saved()
    less = System(factors.relations, factors.rows.where("not (table_id = 0 and row = 0)"))
    assert lost_or_added(system, less).count() > 0


def test_kinds(spark):
    """A lossless projection is taken before a latent split, and a relation without either stays whole."""
    parity = [r for r in range(16) if r.bit_count() % 2 == 0]
    held = [([1, 2, 3], [0, 1, 6, 7]), ([1, 2, 3, 4], parity), ([5, 6, 7], [1, 2, 4])]
    got = {tuple(r.left_bits + r.right_bits): r.kind for r in splits(System.of(spark, held)).collect()}
    assert sorted(got.values()) == ["latent", "none", "projection"]


def test_nothing_to_split(spark):
    assert projection_splits(System.of(spark, [([1, 2], [0, 3])])).collect() == []
    assert projection_splits(System.of(spark, [])).collect() == []


def test_latent_factors_join_back(spark):
    """Parity of four bits has no lossless projection; its latent factors share new bits and join back to it."""
    from maskspark.operators.decomposition import latent_factors, latent_splits, split_coverage
    from maskspark.operators.joins import join_all

    parity = [r for r in range(16) if r.bit_count() % 2 == 0]
    wide = [r for r in range(64) if (r & 7).bit_count() % 2 == (r >> 3).bit_count() % 2]
    held = [([1, 2, 3, 4], parity), ([3, 4, 5, 6, 7, 8], wide), ([1, 2, 3], [1, 2, 4]), ([5, 6, 7], [0, 1, 6, 7])]
    system = System.of(spark, held)
    found = latent_splits(system).cache()
    assert {r.table_id: r.latent_bits for r in found.collect()} == {0: 1, 1: 1}
    factors = latent_factors(system, found).saved()
    new = {b for r in factors.relations.collect() for b in r.bits if b > 8}
    assert new == {9, 10}  # each split has a bit of its own
    for t, (bits, rows) in enumerate(held[:2]):
        both = factors.only(spark.createDataFrame([(2 * t,), (2 * t + 1,)], "table_id long"))
        assert all(len(r.bits) < len(bits) for r in both.relations.collect())
        joined = join_all(both).keep_bits(spark.createDataFrame([(b,) for b in bits], "bit long"))
        assert joined.local() == [(bits, rows)]
    got = {(r.kind, r.arity): (r.relations, r.rows_before, r.rows_after) for r in split_coverage(system).collect()}
    assert got == {("latent", 4): (1, 8, 8), ("latent", 6): (1, 32, 16), ("none", 3): (1, 3, 3), ("projection", 3): (1, 4, 4)}
