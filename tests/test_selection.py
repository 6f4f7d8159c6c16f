"""Pools of small projections that are selected greedily, and what the selection tells."""

from itertools import combinations

from maskspark.operators.decomposition import reconstruct, selective_report
from maskspark.operators.joins import join_all
from maskspark.system import System


def informative(bits, rows, k):
    """Projections to k bits that do not allow everything."""
    n = 0
    for at in combinations(range(len(bits)), k):
        n += len({tuple(r >> i & 1 for i in at) for r in rows}) < 1 << k
    return n


def test_parity_needs_one_factor_of_three_bits(spark):
    parity = [r for r in range(8) if r.bit_count() % 2 == 0]
    pool, report = selective_report(System.of(spark, [([1, 2, 3], parity)]))
    assert pool.local() == [([1, 2, 3], parity)]
    assert report.pool == {3: 1}
    assert report.choices == [{"bits": [1, 2, 3], "missing_bits": 3, "extra_rows": None, "candidates": 1, "gain": 3}]


def test_each_choice_is_counted(spark):
    bits, rows = [1, 2, 3, 4], [r for r in range(16) if all(r >> i & 1 <= r >> i + 1 & 1 for i in range(3))]
    pool, report = selective_report(System.of(spark, [(bits, rows)]), most=3)
    assert report.pool == {k: informative(bits, rows, k) for k in (2, 3)}
    assert join_all(pool).local() == [(bits, rows)] == reconstruct(pool).local()
    assert len(report.choices) == pool.relations.count()
    missing = [c["missing_bits"] for c in report.choices]
    extra = [c["extra_rows"] for c in report.choices if not c["missing_bits"]]
    assert missing == sorted(missing, reverse=True) and extra == sorted(extra, reverse=True) and all(c["gain"] > 0 for c in report.choices)


def test_tautology_and_too_small_projections(spark):
    assert selective_report(System.of(spark, [([1, 2], [0, 1, 2, 3])]))[0] is None
    parity = [r for r in range(16) if r.bit_count() % 2 == 0]
    pool, report = selective_report(System.of(spark, [([1, 2, 3, 4], parity)]), most=3)
    assert pool is None and report.pool == {} and report.choices == []
