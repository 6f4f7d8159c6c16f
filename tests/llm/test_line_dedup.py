import random

import numpy as np
import pytest

from maskspark.llm import line_dedup
from maskspark.llm.line_dedup import PerfectHash, Shard, drop_repeated_lines

GAP = " \t\n\x0b\x0c\r"


def brute(rows):
    """(doc_id, text, n_lines, n_dropped) by plain dictionaries; a missing id counts as one document after all others."""
    order = lambda d: (d is None, d or 0)
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(GAP))
    holders = {}
    for d, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(order(d))
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == order(d)]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def check(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in drop_repeated_lines(docs, **options).collect()), key=repr)
    assert got == brute(rows)


def corpus(seed, n=200):
    r = random.Random(seed)
    pool = [f"line number {i} of the pool" for i in range(60)] + ["Short", "", "  ", "ÄÖÜäöüßéàç", "ÄÖÜäöüßéà"]
    twist = [lambda x: x, str.upper, lambda x: f" \t{x}\r", lambda x: f"\x0b{x} "]
    rows = [(r.choice([i, i, i, None, 7]), "\n".join(r.choice(twist)(r.choice(pool)) if r.random() < 0.7 else f"own line {i} {j}" for j in range(r.randrange(8)))) for i in range(n)]
    return rows + [(1000, None), (1001, ""), (1002, "\n\n"), (None, None), rows[0], rows[0]]


@pytest.mark.parametrize("head_keys", [1 << 20, 12, 0.5])
def test_against_brute_force(spark, head_keys):
    """All keys in the head, some in it, none in it."""
    check(spark, corpus(3), head_keys=head_keys)


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 4)
    for head_keys in (1 << 20, 0.5):
        check(spark, corpus(4), head_keys=head_keys)


def test_hot_line_and_very_long_text(spark):
    """A line in every document, and a text of 60,000 lines of which every second repeats elsewhere."""
    rows = [(i, f"the line that all documents hold\nown line of {i}") for i in range(500)]
    rows.append((900, "\n".join(f"long text line {i % 30000}" if i % 2 else f"once {i}" for i in range(60000))))
    rows.append((901, "\n".join(f"long text line {i}" for i in range(30000)) + "\n" + "x" * 300000))
    for head_keys in (1 << 20, 0.5):
        check(spark, rows, head_keys=head_keys)


def test_border_of_length_and_white_space(spark):
    check(spark, [(1, "123456789\n1234567890\nÄ234567890"), (2, "123456789 \n 1234567890\t\nä234567890"), (3, "1234567890 \n1234567890")])


def test_head_is_bounded(spark):
    """No more keys are broadcast than asked for, whatever the ties in their counts."""
    docs = spark.createDataFrame([(d, "\n".join(f"shared line {i}" for i in range(50))) for d in range(4)], "doc_id long, text string")
    keys = line_dedup.repeated_keys(docs)
    total = sum(r.n for r in keys.collect())
    assert keys.where(f"n > {total / 20}").count() <= 20
    check(spark, [(d, "\n".join(f"shared line {i}" for i in range(50))) for d in range(4)], head_keys=20)


def test_empty_and_extra_columns(spark):
    assert drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    clash = spark.createDataFrame([(1, "a shared line", 3, "x", 9), (2, "A shared line", 4, "y", 8)], "doc_id long, text string, n_lines int, places string, h1 int")
    assert sorted(tuple(r) for r in drop_repeated_lines(clash).collect()) == [(1, "a shared line", 1, 0, 0), (2, "", 1, 1, 2)]


def test_perfect_hash():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 63, 64, 65, 5000):
        h = r.integers(0, 1 << 63, (n, 2), dtype=np.uint64)
        found = PerfectHash.build(h[:, 0], h[:, 1])(h[:, 0], h[:, 1])
        assert sorted(found.tolist()) == list(range(n))
    bits = len(PerfectHash.build(h[:, 0], h[:, 1]).bits) * 8
    assert bits < 6 * n


def test_keys_elsewhere_are_not_found():
    r = np.random.default_rng(1)
    h, other = r.integers(-(1 << 62), 1 << 62, (2, 2000, 2))
    counts, owners = r.integers(2, 9, 2000), r.integers(0, 1 << 40, 2000)
    shard = Shard(Shard.columns(h, counts, owners))
    got = shard.probe(h[:, 0].view(np.uint64), h[:, 1].view(np.uint64))
    assert np.array_equal(got[0], counts) and np.array_equal(got[1], owners)
    assert not shard.probe(other[:, 0].copy().view(np.uint64), other[:, 1].copy().view(np.uint64))[0].any()
