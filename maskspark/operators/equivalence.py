"""Classes of equal or opposite bits, and what a chain of rewrites made of each original bit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskspark.storage import cut
from maskspark.system import ContradictionError

MAPPING = "bit long, representative long, inverted boolean"


def _stars(edges: DataFrame) -> DataFrame:
    """(u, v): each node u joined to the least node v of its component, from edges(u, v). In each round
    every node's larger neighbours, then its smaller ones, go over to the least node that it sees;
    components shrink to stars in a number of rounds that grows with the logarithm of their size."""
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return edges
        before = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        large = cut(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        small = large.join(least, "u").where("v > least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        edges = cut(small.unionByName(least.select("u", F.col("least").alias("v"))).distinct(), "edges")


def parity_components(relations: DataFrame) -> DataFrame:
    """bit, representative, inverted of every bit of relations(left, right, inverted): the least bit of
    each class stands for it. Each bit is two nodes, itself and its opposite, and each relation two
    edges; a class is a pair of components, and a bit that meets its own opposite contradicts the
    relations. Nothing but a count leaves the executors."""
    node = lambda bit, parity: F.col(bit) * 2 + parity
    odd = F.col("inverted").cast("long")
    edges = relations.select(F.explode(F.array(F.struct(node("left", 0).alias("u"), node("right", odd).alias("v")), F.struct(node("left", 1).alias("u"), node("right", 1 - odd).alias("v")))).alias("e")).select("e.u", "e.v")
    stars = _stars(edges)
    nodes = stars.unionByName(stars.select(F.col("v").alias("u"), "v")).distinct()
    half = lambda c: F.expr(f"{c} div 2")
    named = cut(nodes.select(half("u").alias("bit"), (F.col("u") % 2).alias("parity"), half("v").alias("representative"), (F.col("v") % 2).alias("side")), "classes")
    both = named.groupBy("bit").agg(F.countDistinct("representative", "side").alias("sides"), F.count(F.lit(1)).alias("n"))
    if not both.where("n <> 2 or sides <> 2").isEmpty():
        raise ContradictionError("contradiction: a bit is equal to its opposite")
    return named.where("parity = 0").select("bit", "representative", (F.col("side") == 1).alias("inverted"))


def protect(mapping: DataFrame, protected: DataFrame) -> DataFrame:
    """The mapping in which protected bits stand for themselves, and the least protected bit of a class, where there is one, for the rest."""
    guard = protected.select(F.col("bit").alias("guarded")).distinct()
    held = mapping.join(guard, F.col("bit") == F.col("guarded"), "left")
    first = held.where("guarded is not null").groupBy("representative").agg(F.min(F.struct("bit", "inverted")).alias("x")).select("representative", F.col("x.bit").alias("stands"), F.col("x.inverted").alias("turned"))
    new = held.join(first, "representative", "left")
    own = F.col("guarded").isNotNull()
    return new.select(
        "bit",
        F.when(own, F.col("bit")).otherwise(F.coalesce("stands", "representative")).alias("representative"),
        F.when(own, F.lit(False)).otherwise(F.col("inverted") != F.coalesce("turned", F.lit(False))).alias("inverted"),
    )


def compose(mapping: DataFrame, moves: DataFrame) -> DataFrame:
    """mapping, and moves after it: a bit whose representative moves goes along."""
    step = moves.select(F.col("bit").alias("from"), F.col("representative").alias("to"), F.col("inverted").alias("turned"))
    held = mapping.join(step, F.col("representative") == F.col("from"), "left")
    return held.select("bit", F.coalesce("to", "representative").alias("representative"), (F.col("inverted") != F.coalesce("turned", F.lit(False))).alias("inverted"))


def classes(mapping: DataFrame, forced: DataFrame) -> DataFrame:
    """representative, size, bit, inverted: classes of two or more bits that are not forced."""
    free = mapping.join(forced.select("bit"), "bit", "left_anti")
    sizes = free.groupBy("representative").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return free.join(sizes, "representative").select("representative", "size", "bit", "inverted")


def replaced(mapping: DataFrame, forced: DataFrame) -> DataFrame:
    """bit, representative, inverted of bits that are neither forced nor their own representatives."""
    return mapping.join(forced.select("bit"), "bit", "left_anti").where("bit <> representative or inverted")


def values_of(mapping: DataFrame, forced: DataFrame, solution: DataFrame) -> DataFrame:
    """bit, value of every original bit that is forced, or whose representative has a value in solution(bit, value)."""
    known = solution.select(F.col("bit").alias("representative"), "value").join(mapping, "representative")
    found = known.select("bit", F.col("value").bitwiseXOR(F.col("inverted").cast("int")).alias("value")).join(forced.select("bit"), "bit", "left_anti")
    return found.unionByName(forced.select("bit", "value"))
