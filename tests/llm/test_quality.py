import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from maskspark.llm.quality import GRID, binomial_tail, certified, judge, kept_rows, with_counts

GAP = r"[\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = [w for w in re.split(GAP, text) if w]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.sub(GAP, "", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_counts(spark):
    r = random.Random(2)
    bits = ["a", "b", "c", "ü𝒳", "#", "|<", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\u00a0", "a b c", "\n\n", "!!", "A"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 160))), "x") for i in range(400)] + [(9000, None, None), (9001, "", "y"), (9002, "w " * 3000, "y"), (9003, "w w", "y")]
    got = {r.doc_id: r for r in with_counts(spark.createDataFrame(rows, "doc_id long, text string, lang string"), ["doc_id", "lang"]).collect()}
    for doc, text, _ in rows:
        x = got[doc]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == brute(text), repr(text)


@pytest.mark.parametrize("n,k,p", [(10, 0, 0.1), (50, 3, 0.05), (1000, 4, 0.01), (5, 5, 0.2)])
def test_tail(n, k, p):
    assert binomial_tail(n, k, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_certified():
    clean = [("a", 0, h, 0, 3000) for h in (0, 1)]
    bad = [("a", 40, h, 1, 200) for h in (0, 1)]
    step = certified(clean + bad, strata=30).get("a")
    assert step is not None and 0 < step <= 40
    assert certified([*clean, *bad, ("a", 40, 1, 0, 200)], strata=30).get("a", GRID + 1) > 40
    assert certified([("a", 0, 0, 0, 20), ("a", 0, 1, 0, 20), *bad], strata=30) == {}  # too few rows to certify
    assert certified([], strata=1) == {} and GRID > 0


def test_a_sequence_needs_no_correction_for_its_length():
    bad = [("a", 5, h, 1, 200) for h in (0, 1)]
    assert certified([("a", 0, 0, 0, 299), ("a", 0, 1, 0, 299), *bad], strata=1) == {"a": 5}
    assert certified([("a", 0, 0, 0, 298), ("a", 0, 1, 0, 298), *bad], strata=1) == {}
    assert certified([("a", 0, 0, 0, 299), ("a", 0, 1, 0, 299), *bad], strata=2) == {}


def test_rules_share_one_risk():
    """Each rule rejects 8 of 2,500 good rows, which a test passes; two of them together lose too many."""
    assert binomial_tail(2500, 8, 0.01) <= 0.05 < binomial_tail(2500, 24, 0.01)
    one = lambda rule: [(rule, 0, 0, 0, 2500), (rule, 0, 1, 0, 2492), (rule, 9, 1, 0, 8), *((rule, 9, h, 1, 900) for h in (0, 1))]
    assert certified(one("a"), strata=1) == {"a": 9}
    found = certified(one("a") + one("b") + one("c"), strata=1)
    assert found["a"] == found["b"] == 9 and found["c"] == 10


def test_random_labels_keep_the_bound():
    """Over many draws of a rule that rejects just more than RISK of good rows, few certify it."""
    r = random.Random(3)
    broken = 0
    for _ in range(300):
        k = sum(r.random() < 0.0101 for _ in range(1500))
        cells = [("a", 0, 0, 0, 1500), ("a", 0, 1, 0, 1500 - k), ("a", 30, 1, 0, k), *(("a", 30, h, 1, 500) for h in (0, 1))]
        broken += certified(cells, strata=1).get("a", GRID) <= 30
    assert broken <= 300 * 0.05 + 3 * math.sqrt(300 * 0.05 * 0.95)


def test_false_rejection_is_limited(spark):
    r = random.Random(7)
    words = [f"w{i}" for i in range(5000)]
    rows, labels = [], []
    for i in range(9000):
        bad = i % 10 == 0
        text = " ".join(r.choice(words) + ("###" if bad else "") for _ in range(60))
        rows.append((i, text, "xy"[i % 2]))
        labels.append((i, int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("n_words", F.lit("clash"))
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {x.doc_id: x.kept for x in judge(docs, known).collect()}
    assert sum(not got[i] for i, q in labels if q) <= 0.01 * 8100
    assert sum(not got[i] for i, q in labels if not q) > 0.9 * 900
    kept = kept_rows(docs, known)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {i for i in got if got[i]}


def test_a_small_stratum_is_not_cut_by_others(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    rows, labels = [], []
    for i in range(6000):
        lang = "small" if i % 300 == 0 else None if i % 300 == 1 else "hot"
        good = lang != "hot" or i % 10 != 0
        rows.append((i, " ".join(r.choice(words) + ("" if good and lang == "hot" else "###") for _ in range(60)), lang))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x.kept for x in judge(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert all(got[i] for i, q in labels if q)
    assert not any(got[i] for i, q in labels if not q)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", None), (None, " ".join(map(str, range(60))), "q")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {x.doc_id: x.kept for x in judge(docs, none).collect()} == {1: False, None: True}
    assert judge(docs.limit(0), none).collect() == []


def test_repeated_rows_ties_and_long_texts(spark):
    """Repeated rows each give a row and count twice; rows that sit on a cutoff are all rejected alike."""
    r = random.Random(9)
    rows, labels = [], []
    for i in range(3000):
        bad = i % 5 == 0
        rows += [(i, " ".join(f"w{r.randrange(9999)}" for _ in range(60)) + ("#" * 120 if bad else ""), None)] * 2
        labels.append((i, int(not bad)))
    rows.append((9999, " ".join(str(i) for i in range(60000)), None))
    got = judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    kept = Counter((x.doc_id, x.kept) for x in got)
    assert all(kept[i, bool(q)] == 2 for i, q in labels) and kept[9999, True] == 1
