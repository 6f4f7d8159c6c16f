"""Filter interaction audit: what each order of a few filters removes, read off a lattice of subsets.

A document fails a set of filters, kept as a bit mask. An edge of the lattice is (set of filters
already applied, next filter); for n filters there are n * 2^(n-1) edges. Documents with equal part,
mask and labels are counted first, and each such count contributes to every edge: it is removed on
an edge whose filter is the first that it fails. An order of the filters is a path of n edges, so
the n * n! steps of all orders are a join of the aggregated edges with the steps; no order is run.

Texts are compared by their SHA-256 digest: documents with equal texts fail the same content
filters, so only counts and the smallest ids of each text meet, never texts or pairs of copies.

Edge cases. Null text counts as empty, null source as the empty part. A document without id has no
smaller id and is no smaller id: it neither fails the duplicate filter nor makes others fail it,
and it has no labels. Rows that repeat id and text each count and fail alike. Labels that repeat an
id are joined: a label is set if one of its rows sets it. Null labels are not set. Extra columns
are ignored. An empty table has no part and gives an empty result.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskspark.llm.common import WORD_GAP

#: The content filters by letter: conditions on text, words, n_words and n_distinct under which a document fails.
CONTENT = {
    "A": "n_words < 50",
    "B": "100 * n_distinct < 65 * n_words",
    "C": "100 * length(regexp_replace(text, '[^A-Z]+', '')) > 5 * length(text)",
    "D": "text rlike '[#$%&*|]'",
}
#: The letter of the filter on texts that a smaller id has too.
DUPLICATE = "E"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(docs: DataFrame, content: dict[str, str] = CONTENT) -> DataFrame:
    """part, doc_id, digest and the mask of content filters that each row fails, and n, the number of equal rows."""
    text = docs.select(F.coalesce("source", F.lit("")).alias("part"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = text.withColumn("words", F.array_remove(F.split("text", WORD_GAP), ""))
    sized = words.select("part", "doc_id", "text", F.size("words").cast("long").alias("n_words"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct"))
    mask = sum((F.expr(rule).cast("int") * (1 << i) for i, rule in enumerate(content.values())), F.lit(0))
    return sized.select("part", "doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask")).groupBy("part", "doc_id", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))


def labelled(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """failed with booleans good and toxic. Rows without id meet no label and are dealt out by their text."""
    is_set = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    flags = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("label_id")).agg(is_set("quality"), is_set("toxic"))
    flags = flags.withColumn("label_spread", F.lit(b""))
    spread = failed.withColumn("spread", F.when(F.col("doc_id").isNull(), F.col("digest")).otherwise(F.lit(b"")))
    held = spread.join(flags, (F.col("doc_id") == F.col("label_id")) & (F.col("spread") == F.col("label_spread")), "left")
    false = F.lit(False)
    return held.select(*failed.columns, F.coalesce("quality", false).alias("good"), F.coalesce("toxic", false).alias("toxic"))


def profiles(failed: DataFrame, duplicate: int) -> DataFrame:
    """Documents n of each part, mask and labels, with bit `duplicate` set where a smaller id has the same text.

    For one text there is one row for each part and labels when its smallest id is looked for."""
    kinds = failed.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_unnamed"),
        F.min("doc_id").alias("first"),
        F.min_by("n", "doc_id").alias("n_first"),  # rows of that smallest id
    )
    least = F.min("first").over(Window.partitionBy("digest"))
    passed = F.col("n_unnamed") + F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0)
    split = kinds.withColumn("least", least).select(
        "part", "good", "toxic",
        F.explode(F.array(F.struct(F.col("mask"), passed.alias("n")), F.struct((F.col("mask") + (1 << duplicate)).alias("mask"), (F.col("n") - passed).alias("n")))).alias("x"),
    )
    return split.groupBy("part", "x.mask", "good", "toxic").agg(F.sum("x.n").alias("n")).where("n > 0")


def edges(profile: DataFrame, letters: str) -> DataFrame:
    """part, applied, next and the counts of every edge of the lattice, with each filter's Shapley total."""
    n = len(letters)
    every = F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(f).alias("next")) for f in range(n) for s in range(1 << n) if not s >> f & 1))
    at = profile.select("*", F.explode(every).alias("e")).select("*", "e.applied", "e.next", F.expr("shiftleft(1, e.next)").alias("bit"))
    fails, alive = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("applied")) == 0

    def total(when: Column, name: str) -> Column:
        return F.sum(F.when(when, F.col("n")).otherwise(0)).alias(name)

    counted = at.groupBy("part", "applied", "next").agg(
        total(alive & ~fails, "kept"),
        total(alive & fails, "removed"),
        total(~alive & fails, "redundant"),
        total(F.col("mask") == F.col("bit"), "unique_fails"),
        total(alive & fails & F.col("good"), "good_lost"),
        total(alive & fails & F.col("toxic"), "toxic_lost"),
    )
    # An edge after k filters lies on k! * (n - 1 - k)! paths.
    orders = F.element_at(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n))), F.bit_count("applied") + 1)
    return counted.withColumn("shapley", F.sum(F.col("removed") * orders).over(Window.partitionBy("part", "next")))


def paths(edge: DataFrame, letters: str) -> DataFrame:
    """part, filter_order, step and the counts of that step, for all orders of the filters."""
    steps = [("".join(letters[i] for i in p), k + 1, sum(1 << i for i in p[:k]), p[k]) for p in permutations(range(len(letters))) for k in range(len(letters))]
    held = edge.sparkSession.createDataFrame(steps, "filter_order string, step int, applied int, next int")
    return edge.join(F.broadcast(held), ["applied", "next"]).select("part", "filter_order", "step", *COUNTS, "shapley")


def audit(docs: DataFrame, labels: DataFrame, content: dict[str, str] = CONTENT) -> DataFrame:
    """One row for each part, order of all filters (content and duplicates) and step."""
    letters = "".join(content) + DUPLICATE
    return paths(edges(profiles(labelled(failures(docs, content), labels), len(content)), letters), letters)
