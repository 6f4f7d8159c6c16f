"""Classes of bits on the executors, against the union-find of one process; and the provenance of a reduction."""

import random
from itertools import product

import pytest

from maskspark.operators import equivalence, reductions
from maskspark.plans import pipeline
from maskspark.system import ContradictionError, System

PAIRS = "left long, right long, inverted boolean"


def rows(frame):
    return sorted((r.bit, r.representative, r.inverted) for r in frame.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_union_find(spark, seed):
    r = random.Random(seed)
    sign = {b: r.random() < 0.5 for b in range(300)}
    pairs = [(a, b, sign[a] != sign[b]) for a, b in (sorted(r.sample(range(300), 2)) for _ in range(220))]
    pairs += [(i, i + 1, sign[i] != sign[i + 1]) for i in range(250, 299)]  # a long chain
    pairs += [(7, b, sign[7] != sign[b]) for b in range(100, 140)]  # a hub
    relations = spark.createDataFrame(pairs, PAIRS)
    guard = {b for b in range(300) if b % 17 == 0}
    got = equivalence.protect(equivalence.parity_components(relations), spark.createDataFrame([(b,) for b in guard], "bit long"))
    assert rows(got) == reductions.rewrite_map(relations, guard)
    assert rows(equivalence.parity_components(relations)) == reductions.rewrite_map(relations)


def test_contradiction(spark):
    for pairs in ([(1, 2, False), (2, 3, False), (1, 3, True)], [(1, 2, True), (2, 3, True), (3, 4, True), (1, 4, False)], [(5, 6, False), (5, 6, True)]):
        with pytest.raises(ContradictionError):
            equivalence.parity_components(spark.createDataFrame(pairs, PAIRS))
    assert equivalence.parity_components(spark.createDataFrame([], PAIRS)).collect() == []


def test_same_step_on_the_executors(spark, monkeypatch):
    system = System.of(spark, [([1, 2], [0, 3]), ([2, 3], [1, 2]), ([3, 4, 5], [0, 3, 5, 6]), ([5, 6], [0, 3])])
    local = reductions.pair_step(system, {6})
    monkeypatch.setattr(reductions, "LOCAL_RELATIONS", 0)
    spread = reductions.pair_step(system, {6})
    assert (local[0].local(), *local[1:]) == (spread[0].local(), *spread[1:])


def test_many_relations(spark):
    """200,000 bits in classes of 100, in chains; no relation passes the driver."""
    df = spark.range(200_000).where("id % 100 <> 99").selectExpr("id as left", "id + 1 as right", "id % 2 = 0 as inverted")
    got = equivalence.parity_components(df)
    odd = "(id div 2 + id % 2) % 2 = 1"  # two of each four steps turn the value around
    want = spark.range(200_000).selectExpr("id as bit", "id - id % 100 as representative", f"({odd}) != (((id - id % 100) div 2) % 2 = 1) as inverted")
    assert got.count() == 200_000 and got.join(want, ["bit", "representative"]).where("representative % 100 = 0").count() == 200_000
    sample = {r.bit: r.inverted for r in got.where("bit < 100").collect()}
    value, expected = False, {0: False}
    for i in range(99):
        value ^= i % 2 == 0
        expected[i + 1] = value
    assert sample == expected


def solutions(relations):
    bits = sorted({b for own, _ in relations for b in own})
    fits = lambda s, own, held: sum(s[b] << i for i, b in enumerate(own)) in held
    return [s for v in product((0, 1), repeat=len(bits)) for s in [dict(zip(bits, v, strict=True))] if all(fits(s, own, held) for own, held in relations)]


def test_provenance_against_all_solutions(spark):
    relations = [([1, 2], [0, 3]), ([2, 3], [1, 2]), ([3, 4, 5], [0, 1, 3, 6, 7]), ([5, 6, 7], [0, 2, 3, 5, 7]), ([8], [1]), ([8, 9], [1, 3]), ([9, 4], [0, 1, 3])]
    want = solutions(relations)
    out = pipeline.reduce_system(System.of(spark, relations), protected={3, 4, 5, 6, 7})
    assert out.mapping and set(out.mapping) == set(range(1, 10))
    for s in want:
        assert all(s[b] == v for b, v in out.forced.items())
        values = [(rep, s[rep]) for rep in {rep for b, (rep, _) in out.mapping.items() if b not in out.forced}]
        got = {r.bit: r.value for r in equivalence.values_of(out.mapping_frame, out.forced_frame, spark.createDataFrame(values, "bit long, value int")).collect()}
        assert got == s
    history = out.history.where("round = 1 and iteration = 1").collect()
    assert {(r.left, r.right, r.inverted, r.support, tuple(r.arities)) for r in history} >= {(2, 3, True, 1, (2,))}  # bit 1 is in one table only and has gone before
    assert {(r.bit, r.representative, r.inverted) for r in equivalence.replaced(out.mapping_frame, out.forced_frame).collect()} == {(b, *x) for b, x in out.mapping.items() if b not in out.forced and x != (b, False)}
    assert out.report()["components"] == len(out.components()) >= 1


def test_serialised_nodes(spark):
    system = System.of(spark, [([1, 2, 3], [0, 3, 7]), ([1, 2, 4], [0, 3]), ([5, 6], [1])])
    node, members = reductions.nodes(system)
    got = [(list(r.bits), list(r.rows), list(r.members)) for r in reductions.serialised_nodes(node, members).collect()]
    assert got == [([1, 2], [0, 3], [0, 1])]
