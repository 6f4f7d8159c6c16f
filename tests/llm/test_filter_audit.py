import random
import re
from itertools import permutations

from maskspark.llm.filter_audit import COUNTS, audit

GAP = r"[^\x20\x09-\x0D]+"


def brute(docs, labels):
    """Every order of the filters, run one after the other."""
    of = {}
    for d, q, t in labels:
        if d is not None:
            a = of.setdefault(d, [False, False])
            a[0] |= q == 1
            a[1] |= t == 1
    held = []
    for d, text, source in docs:
        text = text or ""
        words = re.findall(GAP, text)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": d is not None and any((x or "") == text and i is not None and i < d for i, x, _ in docs),
        }
        held.append((source or "", "".join(k for k, v in fails.items() if v), *of.get(d, (False, False))))
    out = {}
    for part in {h[0] for h in held}:
        own = [h[1:] for h in held if h[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            rest = own
            for step, f in enumerate(order, 1):
                gone = [h for h in rest if f in h[0]]
                failing = sum(f in h[0] for h in own)
                rest = [h for h in rest if f not in h[0]]
                shapley[f] += len(gone)
                out[part, order, step] = [len(rest), len(gone), failing - len(gone), sum(h[0] == f for h in own), sum(h[1] for h in gone), sum(h[2] for h in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def check(spark, docs, labels, schema="doc_id long, text string, source string"):
    got = audit(spark.createDataFrame(docs, schema), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = got.collect()
    assert {(r.part, r.filter_order, r.step): [r[c] for c in (*COUNTS, "shapley")] for r in rows} == brute([d[:3] for d in docs], labels)
    assert len(rows) == len({(r.part, r.filter_order, r.step) for r in rows})


def test_against_brute_force(spark):
    r = random.Random(5)
    texts = [None, "", " \t\n", "word", "a " * 60, "LOUD " * 55, " ".join(f"w{i}" for i in range(80)), "# " + " ".join(f"w{i}" for i in range(80)), "É" * 40, "x|y " * 50, "w w " * 70]
    docs = [(r.choice([i, i, i, None, 3]), r.choice(texts), r.choice(["a", "b", "", None])) for i in range(150)]
    labels = [(r.choice([i, None]), r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(100)] + [(3, 1, 0), (3, 0, 1)]
    check(spark, docs + docs[:4], labels)


def test_borders(spark):
    """Just at and beyond each threshold."""
    docs = [
        (1, " ".join(f"w{i}" for i in range(49)), "s"), (2, " ".join(f"w{i}" for i in range(50)), "s"),
        (3, " ".join(f"w{i % 65}" for i in range(100)), "s"), (4, " ".join(f"w{i % 64}" for i in range(100)), "s"),
        (5, "A" * 5 + "a" * 95, "s"), (6, "A" * 6 + "a" * 94, "s"), (7, "é" * 95 + "A" * 5, "s"), (8, "same", "s"), (9, "same", "t"), (10, "Same", "t"),
    ]
    check(spark, docs, [(i, 1, i % 2) for i in range(1, 11)])


def test_very_long_text(spark):
    check(spark, [(1, "word " * 400000, "s"), (2, " ".join(f"w{i}" for i in range(200000)) + " #", "s"), (3, "word " * 400000, None)], [(3, 1, 1)])


def test_hot_copies_and_columns_that_clash(spark):
    docs = [(i, "the same text" if i % 3 else f"text {i}", f"s{i % 4}", 7, 1, 0, "m") for i in range(300)]
    check(spark, docs, [(i, i % 2, 0) for i in range(300)], "doc_id long, text string, source string, n int, quality int, toxic int, mask string")


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
    check(spark, [(1, "x", "s")], [])
