"""Reachability through determining sets, against a plain search."""

import random
from itertools import combinations

from maskspark.operators import dependencies
from maskspark.system import System


def rules_of(relations, full, empty):
    """(target, bits) -> best (length, not full, arity, rows, table, bits)."""
    best = {}
    for t, (bits, rows) in enumerate(relations):
        for target in bits:
            others, minimal = [b for b in bits if b != target], []
            for n in range(0 if empty else 1, len(others) + 1):
                for some in combinations(others, n):
                    if any(set(m) <= set(some) for m in minimal):
                        continue
                    seen = {}
                    for r in rows:
                        seen.setdefault(tuple(r >> bits.index(b) & 1 for b in some), set()).add(r >> bits.index(target) & 1)
                    whole = len(seen) == 1 << n
                    if rows and all(len(v) == 1 for v in seen.values()) and (whole or not full):
                        minimal.append(some)
                        score = (n, not whole, len(bits), len(rows), t, list(some))
                        best[target, some] = min(best.get((target, some), score), score)
    return best


def closure(relations, origins, most=None, full=False, empty=False):
    rules, known, out, g = rules_of(relations, full, empty), dict.fromkeys(origins, 0), {b: (0, None, None, None) for b in origins}, 0
    while most is None or g < most:
        g += 1
        new = {}
        for (target, bits), score in rules.items():
            if target not in known and all(b in known for b in bits):
                new[target] = min(new.get(target, score), score)
        if not new:
            break
        for b, (_, part, _, _, t, bits) in new.items():
            out[b] = (g, bits, [known[x] for x in bits], (not part, t))
        known |= dict.fromkeys(new, g)
    return out, sorted({b for bits, _ in relations for b in bits} - set(known))


def check(spark, relations, origins, **options):
    found, missing = dependencies.closure(System.of(spark, relations), origins, **options)
    got = {r.bit: (r.generation, r.bits, r.generations, None if r.bits is None else (r.full_domain, r.table_id)) for r in found.collect()}
    assert (got, sorted(r.bit for r in missing.collect())) == closure(relations, origins, **options)


def test_against_a_plain_search(spark):
    r = random.Random(8)
    relations = []
    for _ in range(8):
        bits = sorted(r.sample(range(1, 12), r.randint(2, 4)))
        relations.append((bits, sorted(r.sample(range(1 << len(bits)), r.randint(1, 1 << (len(bits) - 1))))))
    check(spark, relations, [1, 2, 5])
    check(spark, relations, [1, 2, 5], full=True)
    check(spark, relations, [], empty=True)
    check(spark, relations, [1, 2, 5], most=1)


def test_full_domain_makes_other_sets_minimal(spark):
    """One bit alone determines the target, but not all of its values occur; both together have a full domain nowhere."""
    relations = [([1, 2], [0]), ([2, 3], [0, 3])]
    check(spark, relations, [1])
    check(spark, relations, [1], full=True)


def test_lists(spark):
    system = System.of(spark, [([1, 2], [0, 3]), ([2, 3], [0, 3])])
    assert dependencies.generations(system, [1], most=9) == ([[1], [2], [3]], [], True)
    assert dependencies.generations(system, [9]) == ([[9]], [1, 2, 3], True)
