"""The greedy chain with a kept queue, against recomputing every pair at each step."""

import random

from maskspark.operators.ranking import CandidateQueue
from maskspark.plans import chains
from maskspark.system import System


def join(a, b):
    (ab, ar), (bb, br) = a, b
    bits = sorted({*ab, *bb})
    both = [x for x in ab if x in bb]
    value = lambda own, row, x: row >> own.index(x) & 1
    rows = {
        sum((value(ab, r, x) if x in ab else value(bb, s, x)) << i for i, x in enumerate(bits))
        for r in ar for s in br if all(value(ab, r, x) == value(bb, s, x) for x in both)
    }
    return bits, sorted(rows)


def canonical(relations):
    held = {}
    for bits, rows in relations:
        order = sorted(bits)
        moved = {sum((r >> bits.index(x) & 1) << i for i, x in enumerate(order)) for r in rows}
        key = tuple(order)
        held[key] = held[key] & moved if key in held else moved
    return [(list(b), sorted(held[b])) for b in sorted(held, key=lambda b: (len(b), b))]


def chain(relations, target):
    """(log, final relations): every pair is joined anew at each step."""
    alive = dict(enumerate(canonical(relations)))
    log, n = [], len(alive)
    while True:
        found = []
        for i, a in alive.items():
            for j, b in alive.items():
                if i < j and set(a[0]) & set(b[0]):
                    bits, rows = join(a, b)
                    found.append((len(rows) ** (1 / len(bits)) if rows else 0.0, len(rows), len(bits), i, j))
        if not found:
            break
        _, rows, arity, i, j = min(found)
        shared = len(set(alive[i][0]) & set(alive[j][0]))
        alive[n] = join(alive.pop(i), alive.pop(j))
        log.append((len(log) + 1, i, j, n, shared, arity, rows, len(alive)))
        n += 1
        if arity == target:
            break
    return log, sorted(alive.values(), key=lambda t: (len(t[0]), t[0], t[1]))


def relations(seed, n=7):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        bits = r.sample(range(1, 13), r.randint(1, 4))
        out.append((bits, sorted(r.sample(range(1 << len(bits)), r.randint(1, 1 << len(bits))))))
    return out


def test_same_log_as_recomputing(spark):
    for seed, target in ((1, 99), (2, 6)):
        held = relations(seed)
        system, log = chains.greedy_rank_chain(System.of(spark, held), target=target)
        want, final = chain(held, target)
        assert [tuple(x) for x in log] == want
        assert system.local() == final


def test_compacting_changes_nothing(spark, monkeypatch):
    held = relations(3)
    want, final = chain(held, 99)
    monkeypatch.setattr(CandidateQueue, "COMPACT", 2)
    system, log = chains.greedy_rank_chain(System.of(spark, held), target=99)
    assert [tuple(x) for x in log] == want and system.local() == final


def test_a_step_counts_the_new_relations_pairs_only(spark):
    held = relations(4)
    queue = CandidateQueue(System.of(spark, held))
    best = queue.pop()
    before = {(r.l_table_id, r.r_table_id): r.join_rows for r in queue.candidates().collect()}
    new, _ = queue.merge(best)
    assert {r.r_table_id for r in queue.pairs[-1].collect()} <= {new}
    after = {(r.l_table_id, r.r_table_id): r.join_rows for r in queue.candidates().collect()}
    old = {p: n for p, n in before.items() if not {*p} & {best.l_table_id, best.r_table_id}}
    assert {p: n for p, n in after.items() if p[1] != new} == old
    assert queue.pop(queue.candidates()["union_arity"] < 0) is None


def test_nothing_to_merge(spark):
    system, log = chains.greedy_rank_chain(System.of(spark, [([1], [0]), ([2], [1])]))
    assert log == [] and len(system.local()) == 2
    assert chains.greedy_rank_chain(System.of(spark, []))[1] == []
