"""Systems of many relations: no relation, and nothing that has a row for each, is gathered on the driver to be broadcast."""

import random

import pytest

from maskspark import storage, wide
from maskspark.operators import decomposition, metrics
from maskspark.system import System
from maskspark.wide import WideSystem


@pytest.fixture
def many(monkeypatch):
    """Two relations count as many."""
    monkeypatch.setattr(storage, "BROADCAST", 1)


def broadcasts(df):
    return "BroadcastExchange" in df._jdf.queryExecution().executedPlan().toString()


def relations(seed, sizes=(1, 3, 6, 7, 9, 0)):
    r = random.Random(seed)
    return [(sorted(r.sample(range(20), n)), [r.getrandbits(n) if n else 0 for _ in range(30)]) for n in sizes] + [([1, 2], [])]


def test_wide_projections_deal_relations_out(spark, many):
    held = [(list(range(70)), [1 << 69, 5, 3]), (list(range(1, 71)), [1, 7]), ([70, 2], [0, 3])]
    system = WideSystem.of(spark, held).saved()
    kept = system.keep_bits(spark.createDataFrame([(b,) for b in (0, 1, 69, 70)], "bit long"))
    assert not broadcasts(kept.rows) and not broadcasts(kept.relations)
    assert kept.local() == sorted([([0, 1, 69], [1, 3, 4]), ([1, 69, 70], [1]), ([70], [0, 1])], key=lambda t: (len(t[0]), t[0], t[1]))
    kept = kept.saved()
    found = wide.verify_projections(system, kept)
    assert not broadcasts(found) and all(r.matches for r in found.collect())
    assert not broadcasts(wide.texts(kept)) and not broadcasts(system.without(spark.range(1, 3).toDF("table_id")).rows)


def test_few_relations_are_broadcast(spark):
    system = WideSystem.of(spark, [(list(range(70)), [1 << 69, 5])]).saved()
    assert broadcasts(system.keep_bits(spark.createDataFrame([(69,)], "bit long")).rows)


def test_zero_collapse_counts_words_of_rows(spark):
    held = relations(1)
    system = System.of(spark, held).saved()
    found = metrics.zero_collapse(system)
    assert not broadcasts(found)
    want = {(t, p, b, len(rows), len({x & ~(1 << p) for x in rows})) for t, (bits, rows) in enumerate(held) for p, b in enumerate(bits)}
    assert {(r.table_id, r.pos, r.bit, r.before, r.after) for r in found.collect()} == want
    high = System.of(spark, [(list(range(63)), [1 << 62, 0, 1 << 61, 1 << 6, 3])])
    rows = [1 << 62, 0, 1 << 61, 1 << 6, 3]
    assert {(r.pos, r.after) for r in metrics.zero_collapse(high).collect()} == {(p, len({x & ~(1 << p) for x in rows})) for p in range(63)}


def test_one_probabilities_count_by_place(spark):
    held = relations(2)
    found = metrics.one_probabilities(System.of(spark, held).saved())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not broadcasts(found) and plan.index("Generate") < plan.index("Aggregate")  # bits are named above the counts
    want = {(t, p, b): sum(x >> p & 1 for x in rows) / len(rows) for t, (bits, rows) in enumerate(held) if rows for p, b in enumerate(bits)}
    assert {(r.table_id, r.pos, r.bit): r.p_one for r in found.collect()} == pytest.approx(want)


def test_subtables_name_their_bits_without_joins(spark, many):
    held = relations(3, (1, 3, 5))
    found = decomposition.subtables(System.of(spark, held).saved(), 2)
    assert not broadcasts(found.rows) and not broadcasts(found.relations)
    want = []
    for bits, rows in held:
        for i, a in enumerate(bits):
            want += [([a, b], sorted({(x >> i & 1) + 2 * (x >> j & 1) for x in rows})) for j, b in enumerate(bits) if j > i]
    assert found.local() == sorted(want, key=lambda t: (len(t[0]), t[0], t[1]))


def test_loose_parts_against_pairs():
    import itertools

    import numpy as np

    from maskspark.functions.kernel import loose_parts

    r, arity = random.Random(4), 4
    held = [sorted({r.randrange(16) for _ in range(r.randrange(1, 16))}) for _ in range(11)] + [list(range(16)), [5]]
    cubes = np.zeros((len(held), 16), bool)
    for i, rows in enumerate(held):
        cubes[i, rows] = True
    got = dict(loose_parts(cubes, arity))
    assert set(got) == {s for s in range(16) if s.bit_count() <= 2}
    for shared, parts in got.items():
        free = [p for p in range(arity) if not shared >> p & 1]
        for rows, found in zip(held, parts, strict=True):
            want = [{p} for p in free]
            for a, b in itertools.combinations(free, 2):
                seen = {}
                for x in rows:
                    seen.setdefault(x & shared, set()).add((x >> a & 1, x >> b & 1))
                if any(len(v) != len({x for x, _ in v}) * len({y for _, y in v}) for v in seen.values()):
                    want = [w for w in want if not w & {a, b}] + [set().union(*(w for w in want if w & {a, b}))]
            assert found == sorted(sum(1 << p for p in w) for w in want)


def test_items_join_masks_only(spark):
    from maskspark.plans import fixture

    found = fixture.items(spark, "/root/testdata/sf0.001")
    assert set(found.columns) == {"l_partkey", "mask"}
    whole = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    for t, (a, b) in fixture._SOURCES.items():
        whole = whole.join(spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet"), a_equals(a, b))
    want = whole.selectExpr("l_partkey", " | ".join(f"shiftleft(cast({p} as bigint), {i})" for i, p in enumerate(fixture.PREDICATES.values())) + " as mask")
    assert found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty()


def a_equals(a, b):
    from pyspark.sql import functions as F

    return F.col(a) == F.col(b)
