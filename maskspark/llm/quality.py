"""Quality rules with risk-controlled thresholds; DataFrame functions only.

Base counts come from fixed definitions. The method adds one cutoff for each rule (a ratio of a
text) and stratum. Labelled rows are a holdout in two halves by the id's crc32: the first half
certifies nothing but proposes, for each rule, the cutoff that rejects most bad rows for the good
ones it costs, and orders the steps towards all proposed cutoffs by the good rows they cost there,
from cutoffs that reject nothing to stricter ones. The second half tests these steps in that fixed
sequence and stops at the first that fails: each test is the exact binomial tail
P(Bin(n, RISK) <= k) <= DELTA / strata, with n good rows of the stratum and k of them rejected,
counted once for each rule that rejects them, so no fewer than the rules reject together. A
sequence that ends at its first failure needs no correction of its own, strata share DELTA
(Bonferroni); so with probability 1 - DELTA the rules together reject at most the share RISK of
good rows in every stratum. A cutoff holds only in the stratum whose own rows certified it: where
nothing can be certified, the rules reject nothing, so the bad rows of a stratum with few labels
stay unless a base rule rejects them.

Edge cases. Null text counts as without words: n_words 0, which fails the base rule. Null strata
form one stratum. Labels of an id that disagree count as bad; labels without text are ignored.
Repeated rows each give a row and each count. Very long texts are handled whole. Without labels
only the base rules reject. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskspark.llm.common import WORD_GAP, let, materialize, remainder

#: Share of a stratum's good rows that the rules together may reject, and the chance that any stratum breaks it.
RISK, DELTA = 0.01, 0.05
#: Cutoffs of a rule: this many steps of its range (fixed grids, so histograms are bounded).
GRID = 64
#: Good rows that a cutoff may reject for each bad row, in the proposing half.
PRICE = 20.0

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"

#: name -> (numerator, denominator, top of the grid) over the columns of counts(). Larger is worse.
RULES = {
    "symbols": ("n_symbols", "word_chars", 0.64),
    "repeats": ("n_repeat_words", "n_words", 0.64),
    "same_lines": ("n_dup_lines", "n_lines", 0.64),
    "capitals": ("n_capitals", "word_chars", 0.64),
    "marks": ("n_marks", "word_chars", 0.64),
}
#: Good rows in the certifying half below which no test can pass, even one with nothing rejected and no other stratum.
LEAST_GOOD = math.ceil(math.log(DELTA) / math.log1p(-RISK))


def counts(text: Column) -> dict[str, Column]:
    """The columns that the rules need, from a text column."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    without = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    return {
        "words": words,
        "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
        "n_symbols": without(SYMBOLS).cast("long"),
        "n_capitals": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long"),
        "n_marks": without("!?").cast("long"),
        "lines": lines,
    }


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. Windows are sorted by hash with
    their places; equal neighbours mark repeated ones, and each counts the words up to the next."""
    return F.coalesce(let(words, lambda w: let(_windows(w), _covered)), F.lit(0).cast("long"))


def _windows(w: Column) -> Column:
    """(hash, place) of every window, sorted."""
    at = lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))
    return F.sort_array(F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), at)))


def _covered(ordered: Column) -> Column:
    twice = F.filter(ordered, lambda x, j: (F.get(ordered, j - 1)["h"] == x["h"]) | F.coalesce(F.get(ordered, j + 1)["h"] == x["h"], F.lit(False)))
    return F.aggregate(
        F.sort_array(F.transform(twice, lambda x: x["i"])),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )


def with_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns of docs and word_chars, n_words, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_marks, base_failed."""
    c = counts(F.col("text"))
    df = docs.select(*keep, *(v.alias(f"q_{k}") for k, v in c.items()))
    out = df.select(
        *keep,
        F.size("q_words").cast("long").alias("n_words"),
        *(F.col(f"q_{k}").alias(k) for k in ("word_chars", "n_symbols", "n_capitals", "n_marks")),
        F.size("q_lines").cast("long").alias("n_lines"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("q_words")).alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def binomial_tail(n: int, k: int, p: float) -> float:
    """P(Bin(n, p) <= k), exact but for rounding."""
    if k >= n:
        return 1.0
    top = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, -1, -1)]
    high = max(top)
    return min(1.0, math.exp(high) * math.fsum(math.exp(x - high) for x in top))


def certified(cells: list[tuple[str, int, int, int, int]], strata: int, risk: float = RISK, delta: float = DELTA) -> dict[str, int]:
    """rule -> step of the grid from which it rejects, for one stratum. cells: (rule, step, half, bad, rows); strata: how many are tested."""
    proposing = {rule: [[0, 0] for _ in range(GRID + 1)] for rule, *_ in cells}
    certifying = {rule: [0] * (GRID + 1) for rule in proposing}
    for rule, step, half, bad, n in cells:
        if half:
            certifying[rule][step] += 0 if bad else n
        else:
            proposing[rule][step][bad] += n
    path = []
    for rule, held in proposing.items():
        best, reached, lost, won, steps = 0.0, 0, 0, 0, []
        for step in range(GRID, 0, -1):
            lost, won = lost + held[step][0], won + held[step][1]
            steps.append((lost, rule, -step))
            if won - PRICE * lost > best:
                best, reached = won - PRICE * lost, len(steps)
        path += steps[:reached]
    good = sum(next(iter(certifying.values()), []))  # each row has a cell of every rule
    found: dict[str, int] = {}
    k = 0
    for _, rule, step in sorted(path):
        k += certifying[rule][-step]
        # k over n * risk cannot pass; the sum would be long
        if k > good * risk or binomial_tail(good, k, risk) > delta / strata:
            break
        found[rule] = -step
    return found


def _step(rule: str) -> Column:
    over, under, top = RULES[rule]
    return F.least(F.lit(GRID), F.floor(F.col(over) * (GRID / top) / F.greatest(F.col(under), F.lit(1)))).cast("int")


def learn(counted: DataFrame, labels: DataFrame, stratum: str) -> dict[str, dict[str, int]]:
    """rule -> stratum -> step from which it rejects."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    judged = counted.where("not base_failed").select("doc_id", F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), F.struct(*(_step(r).alias(r) for r in RULES)).alias("steps")).join(known, "doc_id")
    each = judged.select("stratum", remainder("doc_id", 2).cast("int").alias("half"), (1 - F.col("quality")).cast("int").alias("bad"), F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"steps.{r}").alias("step")) for r in RULES))).alias("x"))
    cells = each.groupBy("stratum", "half", "bad", F.col("x.rule").alias("rule"), F.col("x.step").alias("step")).count()
    judges = F.sum(F.when((F.col("half") == 1) & (F.col("bad") == 0) & (F.col("rule") == next(iter(RULES))), F.col("count")).otherwise(0))
    strata = cells.groupBy("stratum").agg(judges.alias("good"), F.collect_list(F.struct("rule", "step", "half", "bad", "count")).alias("cells"))  # at most rules * grid * 4
    strata = materialize(strata, "quality-cells").where(F.col("good") >= LEAST_GOOD)
    tested = strata.count()
    found: dict[str, dict[str, int]] = {r: {} for r in RULES}
    for row in strata.toLocalIterator():
        for rule, step in certified([(c.rule, c.step, c.half, c.bad, c["count"]) for c in row.cells], tested).items():
            found[rule][row.stratum] = step
    return found


def rejected(cutoffs: dict[str, dict[str, int]], stratum: str) -> Column:
    """Whether a counted row reaches the cutoff of a rule in its stratum."""
    tests = []
    for rule, steps in cutoffs.items():
        for step in sorted(set(steps.values())):
            names = sorted(name for name, own in steps.items() if own == step)
            tests.append(F.coalesce(F.col(stratum), F.lit("")).isin(names) & (_step(rule) >= step))
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every row of docs."""
    counted = materialize(with_counts(docs, ["doc_id", stratum]), "quality")
    cut = rejected(learn(counted, labels, stratum), stratum)
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~cut).alias("kept"))


def kept_rows(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The rows of docs, all columns, that judge() keeps. Counts are written beside the rows, so that no text is counted twice."""
    rows = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("q_row"), "text", F.col("doc_id").alias("q_id"), F.col(stratum).alias("q_stratum"))
    counted = materialize(with_counts(rows, ["q_row", "q_id", "q_stratum"]), "quality")
    cutoffs = learn(counted.drop("q_row").withColumnRenamed("q_id", "doc_id"), labels, "q_stratum")
    return counted.where(~F.col("base_failed") & ~rejected(cutoffs, "q_stratum")).select("q_row.*")
