"""Relations observed in data: which combinations of predicates occur, for each group of rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskspark.functions.mask import project_to
from maskspark.operators.limits import check_arity
from maskspark.storage import numbered
from maskspark.system import System


def observe(df: DataFrame, predicates: Mapping[int, str], relations: Sequence[Sequence[int]], group: str) -> DataFrame:
    """group, relation, row, n: the assignments of each relation's bits that occur in each group, and
    the rows of df with them. Predicates are SQL over df by bit; null is false. Whole combinations
    are counted before they are projected, so a hot group shuffles few rows."""
    check_arity(len(predicates))
    place = {bit: i for i, bit in enumerate(predicates)}
    mask = F.lit(0).cast("long")
    for bit, i in place.items():
        mask = mask + F.coalesce(F.expr(predicates[bit]).cast("boolean"), F.lit(False)).cast("long") * F.lit(1 << i)
    whole = df.select(F.col(group).cast("string").alias("group"), mask.alias("mask")).groupBy("group", "mask").agg(F.count(F.lit(1)).alias("n"))
    parts = F.array(*(F.struct(F.lit(i).alias("relation"), project_to(F.col("mask"), [place[b] for b in bits]).alias("row")) for i, bits in enumerate(relations)))
    return whole.select("group", "n", F.explode(parts).alias("x")).groupBy("group", "x.relation", "x.row").agg(F.sum("n").alias("n"))


def system_of(observed: DataFrame, relations: Sequence[Sequence[int]]) -> tuple[System, DataFrame]:
    """The observed relations of all groups as one system, and groups(number, group). Each group has
    bits of its own, so groups do not constrain each other: bit b of group number g is g * width + b,
    with width() of the relations; its relation i has the id g * len(relations) + i."""
    groups = numbered(observed.select("group").distinct(), "group")
    held = observed.select(F.col("group").alias("name"), "relation", "row").join(groups, F.col("name").eqNullSafe(F.col("group")))
    table_id = (F.col("number") * len(relations) + F.col("relation")).alias("table_id")
    schemas = F.array(*(F.array(*(F.lit(b).cast("long") for b in bits)) for bits in relations))
    bits = F.transform(F.element_at(schemas, F.col("relation") + 1), lambda b: b + F.col("number") * width(relations)).alias("bits")
    return System(held.select("number", "relation").distinct().select(table_id, bits), held.select(table_id, "row")), groups


def width(relations: Sequence[Sequence[int]]) -> int:
    """The least factor that keeps the bits of two groups apart."""
    return max((b for bits in relations for b in bits), default=0) + 1
