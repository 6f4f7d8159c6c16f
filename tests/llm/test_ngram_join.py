import random

import numpy as np
import pytest

from maskspark.llm import ngram_join
from maskspark.llm.ngram_join import choose_boundary, components, jaccard_components, linked, shingle_sets


def brute(rows):
    sets = []
    for _, text in rows:
        w = [x for x in (text or "").encode().lower().replace(b"\x1c", b"x").split()]
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, groups, size, vocabulary=2000, lengths=(3, 9, 14, 30, 60, 150)):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    out = []
    for _ in range(groups):
        base = [r.choice(words) for _ in range(r.choice(lengths))]
        for _ in range(r.randint(1, size)):
            copy = list(base)
            for _ in range(r.choice((0, 0, 1, 1, 2, 3))):
                copy[r.randrange(len(copy))] = r.choice(words)
            if r.random() < 0.3:
                copy = copy[: max(1, len(copy) - r.randint(0, len(copy) // 5))]
            out.append(" ".join(copy))
    r.shuffle(out)
    return [(1000 - i, x) for i, x in enumerate(out)]


@pytest.mark.parametrize("seed,groups,size", [(1, 40, 8), (2, 4, 70)])
def test_against_all_pairs(spark, seed, groups, size):
    rows = corpus(seed, groups, size)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "Same words", "x"), (5, "same  WORDS", "x"), (5, "same  WORDS", "x"), (6, "ÄB c d", "x"), (7, "äb c d", "x")]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string, cls string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7)]
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_boundary_follows_cost():
    assert choose_boundary({10: 100}, scan=1.0) <= choose_boundary({10: 100}, scan=8.0)


def test_hash_depends_on_the_word_alone():
    plain, long_ = b"one two three four five six", b"x" * 65 + b" y " + b"ab" * 100
    alone = [shingle_sets([t])[0].tolist() for t in (plain, long_)]
    assert [s.tolist() for s in shingle_sets([plain, long_])] == alone
    far = [b"x" * 64 + b"a" + b"x" * 63 + b"b", b"x" * 64 + b"b" + b"x" * 63 + b"a", b"a" + b"x" * 127 + b"b", b"x" * 128 + b"a"]
    assert len({s[0] for s in shingle_sets(far)}) == len(far)


def test_copies_in_pieces_with_and_without_a_long_word(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, text), (3, text + " tail"), (4, "https://host.org/" + "a" * 80), (5, text), (6, text + " other end")]
    halves = spark.sparkContext.parallelize(rows, 2)  # rows 1 to 3 are one piece, 4 to 6, with the long word, another
    got = jaccard_components(spark.createDataFrame(halves, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
    assert len({r.class_id for r in got if r.doc_id in (1, 2, 5)}) == 1


def test_long_lists_and_small_blocks(spark):
    """One large group of near copies: lists dealt in parts of ten entries, comparisons in blocks of some kilobytes."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(r.choice((0, 1, 2, 3, 4))):
            copy[r.randrange(len(copy))] = f"x{i}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame([*rows, (None, rows[3][1]), (None, "alone here"), (None, None)], "doc_id long, text string").repartition(3)
    got = linked(docs, long_list=10, block_bytes=20_000, broadcast_rows=0).collect()
    named = [x for x in got if x.doc_id is not None]
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in named) == brute(rows)
    nameless = sorted((x.n_shingles, x.component_id) for x in got if x.doc_id is None)
    own = next(x for x in named if x.doc_id == 3)
    assert nameless == sorted([(own.n_shingles, own.component_id), (1, None), (0, None)], key=lambda x: x[0])


def test_sketches_bound_the_difference():
    r = np.random.default_rng(3)
    for n, m, both in ((40, 50, 30), (300, 400, 250), (5000, 4000, 100)):
        x = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[:both], r.integers(0, 2**63, m - both, dtype=np.uint64)]))
        wide, other = ngram_join._sketch(x), ngram_join._sketch(y)
        most = min(len(wide), len(other))
        pairs = [(z.reshape(-1, most), ngram_join._folded(z)) for z in (wide, other)]
        same_width = [np.bitwise_xor.reduce(z, axis=0) for z, _ in pairs]
        bits = lambda z: sum((int(v) & (1 << 64) - 1).bit_count() for v in z)
        apart = len(np.setxor1d(x, y))
        assert bits(pairs[0][1] ^ pairs[1][1]) <= bits(same_width[0] ^ same_width[1]) <= apart
        assert ngram_join._shared(x, y) == len(np.intersect1d(x, y))


def test_classes_with_one_first_hash_are_told_apart():
    a, b = (np.array(x, np.uint64) for x in ([1, 2], [3, 4]))
    first, second = ngram_join._two_hashes(a)
    assert ngram_join._class_of(a) == first and ngram_join._class_of(a, frozenset([first])) == second
    assert ngram_join._class_of(b, frozenset([first])) == ngram_join._two_hashes(b)[0] and ngram_join._class_of(a[:0]) is None


def test_very_long_text(spark):
    long_ = " ".join(f"w{i % 9973}x{i // 9973}" for i in range(120_000))
    rows = [(1, long_), (2, long_ + " more"), (3, "short one"), (4, long_[: len(long_) // 2])]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.component_id for x in got} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_cost_chooses_by_the_lists_met():
    assert choose_boundary({n: 10 for n in range(3, 60)}, scan={n: 1.0 for n in range(3, 60)}) == 2
    assert choose_boundary({n: 10 for n in range(3, 400)}, scan={n: 500.0 for n in range(3, 400)}) > 200


def test_components_in_one_task_and_in_many(spark):
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(60)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(45)] + [(7, 7)]
    up = {x: x for e in edges for x in e}

    def top(x):
        return x if up[x] == x else top(up[x])

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    want = {(x, top(x)) for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    for most in (10, 1000):
        assert sorted(map(tuple, components(df, most).collect())) == sorted(want)
    assert components(df.limit(0)).collect() == []
