"""Derived mains against plain Python over sets of assignments."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from maskspark.operators import metrics
from maskspark.plans import derived
from maskspark.plans.derived import derived_main_cycles
from maskspark.system import System


def rows_of(bits, rows):
    return {frozenset(b for k, b in enumerate(bits) if row >> k & 1) for row in rows}


def joined(parts):
    """The join of (bits, set of true bits) relations, by trying all assignments."""
    bits = sorted({b for own, _ in parts for b in own})
    every = (frozenset(c) for n in range(len(bits) + 1) for c in itertools.combinations(bits, n))
    return bits, {x for x in every if all(x & set(own) in rows for own, rows in parts)}


def projected(relation, keep):
    bits, rows = relation
    return [b for b in bits if b in keep], {x & set(keep) for x in rows}


def brute(relations, cycles, cap, order, initial):
    system = {i: (sorted(b), rows_of(b, r)) for i, (b, r) in enumerate(relations)}
    start = {}
    for bits, _ in system.values():
        for b in bits:
            start.setdefault(b, set()).update(bits)
    mains, done, log = {}, [], []
    for cycle in range(1, cycles + 1):
        known = {b for bits, _ in mains.values() for b in bits}
        left = {b: near - set(done) for b, near in start.items() if b not in done and len(near - set(done)) <= cap}
        if not left:
            break
        told = {b: len((start[b] & known) - {b}) for b in left}
        key = {"fewest_related": lambda b: (len(left[b]), b), "most_related": lambda b: (-len(left[b]), b), "derived_first": lambda b: (-told[b], -len(start[b]), b)}[order]
        bit = min(left, key=key)
        near = start[bit] if initial else left[bit]
        holding = {i for i, (bits, _) in system.items() if bit in bits}
        union = {b for i in holding for b in system[i][0]}
        within = {i for i, (bits, _) in system.items() if i not in holding and set(bits) < union}
        touched = [m for m in mains.values() if set(m[0]) & (near - {bit})]
        parts = [p for p in (projected(m, near) for m in touched) if len(p[1]) < 2 ** len(p[0])]
        wide = union | {b for bits, _ in parts for b in bits}
        if not holding:
            outcome, told_rows = "absent", (0,) * 9
        elif len(wide) > cap:
            outcome, told_rows = "too wide", (0,) * 9
        else:
            main = joined([system[i] for i in sorted(holding | within)] + parts)
            rest = projected(main, [b for b in main[0] if b != bit])
            taken_rows = sum(len(system.pop(i)[1]) for i in holding | within)
            told_rows = (len(holding), len(within), taken_rows, len(touched), len(parts), len(main[0]), len(main[1]), len(rest[0]), len(rest[1]))
            outcome = "empty" if not rest[1] else "tautology" if len(rest[1]) == 2 ** len(rest[0]) else "stored"
            if outcome == "stored":
                mains[cycle] = rest
        log.append((cycle, bit, len(left[bit]), told[bit], *told_rows, outcome, len(system), sum(len(r) for _, r in system.values()), len({b for bits, _ in system.values() for b in bits})))
        done.append(bit)
    return system, mains, log


def random_relations(seed, bits=7, n=5, share=0.7):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        own = r.sample(range(1, bits + 1), r.randint(1, 4))
        out.append((own, sorted({0} | {row for row in range(1 << len(own)) if r.random() < share})))
    return out


def told(system):
    return {r.table_id: (list(r.bits), rows_of(r.bits, r.rows)) for r in system.packed().collect()}


@pytest.mark.parametrize("order,initial,cap,seed", [("fewest_related", False, 32, 1), ("most_related", True, 32, 2), ("derived_first", False, 6, 3), ("derived_first", True, 32, 4)])
def test_equals_plain_python(spark, order, initial, cap, seed):
    relations = [*random_relations(seed), ([2, 1], [0, 1, 1]), ([1, 2], [0, 2])]  # a repeated row, equal schemas
    want = brute(relations, 3, cap, order, initial)
    got = derived_main_cycles(System.of(spark, relations), 3, cap, order, initial)
    assert [tuple(r) for r in got.log] == want[2]
    assert told(got.mains) == want[1] and told(got.system) == want[0]


def test_compaction_changes_nothing(spark, monkeypatch):
    relations = random_relations(5)
    want = brute(relations, 3, 32, "fewest_related", False)
    monkeypatch.setattr(derived._Run, "COMPACT", 1)
    got = derived_main_cycles(System.of(spark, relations), 3)
    assert [tuple(r) for r in got.log] == want[2] and told(got.mains) == want[1]


def test_contradiction_and_empty_system(spark):
    got = derived_main_cycles(System.of(spark, [([1, 2], [0]), ([1, 2, 3], [1])]), 3)
    assert [r.outcome for r in got.log] == ["empty", "absent", "absent"] and told(got.mains) == {}
    assert derived_main_cycles(System.of(spark, [([1], [0])]).only(spark.createDataFrame([], "table_id long"))).log == []


def test_deltas(spark):
    before, after = System.of(spark, [([1, 2], [0, 1, 3]), ([3], [0, 1])]), System.of(spark, [([1, 2], [0])])
    d = metrics.metric_deltas(before, after).first()
    assert (d.relations_delta, d.bits_delta, d.row_total_delta) == (-1, -1, -4)
    assert d.max_rank_delta == pytest.approx(1 - 2) and d.min_rank_delta == pytest.approx(1 - 3**0.5)
    none = before.only(spark.range(0).select(F.col("id").alias("table_id")))
    assert metrics.metric_deltas(before, none).first().relations_delta == -2
