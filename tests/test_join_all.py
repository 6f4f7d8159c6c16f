"""The join of many relations, against Python sets."""

import random
from itertools import product

import pytest

from maskspark.operators.joins import join_all
from maskspark.system import System


def solutions(relations):
    bits = sorted({b for own, _ in relations for b in own})
    out = []
    for v in product((0, 1), repeat=len(bits)):
        s = dict(zip(bits, v, strict=True))
        if all(sum(s[b] << i for i, b in enumerate(own)) in rows for own, rows in relations):
            out.append(sum(x << i for i, x in enumerate(v)))
    return [(bits, sorted(out))]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_sets(spark, seed):
    r = random.Random(seed)
    relations = []
    for _ in range(7):
        bits = r.sample(range(1, 9), r.randint(1, 3))  # in any order
        relations.append((bits, sorted(r.sample(range(1 << len(bits)), r.randint(1 << (len(bits) - 1), 1 << len(bits))))))
    assert join_all(System.of(spark, relations)).local() == solutions(relations)


def test_disjoint_empty_and_bare_relations(spark):
    for relations in ([([1], [0, 1]), ([2, 3], [0, 3])], [([1, 2], [0]), ([2, 3], []), ([4], [1])], [([1], [1]), ([], [0])], [([1], [1]), ([], [])], [([3, 1], [1])], [([1, 2], [0, 1]), ([2, 1], [0, 1])]):
        assert join_all(System.of(spark, relations)).local() == solutions(relations)
    with pytest.raises(ValueError):
        join_all(System.of(spark, []))


def test_overlapping_relations_come_first(spark):
    """Forty relations of two bits in a chain, numbered so that neighbours are far apart: no step has more rows than the chain's beginnings."""
    n = 41
    links = [(i * 17) % (n - 1) for i in range(n - 1)]
    relations = [([i, i + 1], [0, 2, 3]) for i in links]  # ascending: bit i is set only if bit i + 1 is
    got = join_all(System.of(spark, relations))
    assert got.rows.count() == n + 1
