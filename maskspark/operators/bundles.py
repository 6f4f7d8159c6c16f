"""Operations on whole bundles of relations: concatenation, duplicates, selections by bits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskspark.system import System


def concat(systems: list[System], origins: list[dict[str, list[int]]] | None = None) -> tuple[System, dict[str, list[int]]]:
    """All relations of all systems, each kept; origin arrays of one name must agree."""
    named: dict[str, list[int]] = {}
    for held in origins or []:
        for name, values in held.items():
            if named.setdefault(name, values) != values:
                raise ValueError(f"origin arrays {name!r} differ")
    own = lambda df, i: df.withColumn("table_id", F.xxhash64(F.lit(i), "table_id"))
    relations = [own(s.relations, i) for i, s in enumerate(systems)]
    rows = [own(s.rows, i) for i, s in enumerate(systems)]
    return System(reduce(DataFrame.unionByName, relations), reduce(DataFrame.unionByName, rows)), named


def duplicate_groups(system: System) -> DataFrame:
    """bits, rows, first (least id), copies of each distinct table, by bits and rows as sets."""
    order = F.array_sort("bits")
    from maskspark.functions.mask import positions_of, project

    moved = system.relations.select("table_id", order.alias("bits"), positions_of(order, F.col("bits")).alias("at"))
    rows = system.rows.join(moved, "table_id").select("table_id", project(F.col("row"), F.col("at")).alias("row"))
    packed = System(moved.select("table_id", "bits"), rows).packed()
    return packed.groupBy("bits", "rows").agg(F.min("table_id").alias("first"), F.count(F.lit(1)).alias("copies"))


def without_duplicates(system: System) -> System:
    """The first of equal relations stays: least id, which for containers is the first by file and place in it."""
    return system.only(duplicate_groups(system).select(F.col("first").alias("table_id")))


def with_any_bit(system: System, bits: list[int]) -> tuple[System, DataFrame]:
    """The relations that hold any of the bits; and for each bit (0 if none) how many do."""
    wanted = system.relations.sparkSession.createDataFrame([(b,) for b in sorted(set(bits))], "bit long")
    hits = system.schema.join(wanted, "bit", "left_semi")
    counts = wanted.join(hits.groupBy("bit").agg(F.count(F.lit(1)).alias("relations")), "bit", "left").na.fill(0, ["relations"])
    return system.only(hits.select("table_id").distinct()), counts


def upsert_origins(origins: dict[str, list[int]], name: str, values: list[int]) -> dict[str, list[int]]:
    """A named array replaced in place, or added, which sorts the names."""
    out = {**origins, name: values}
    return out if name in origins else dict(sorted(out.items()))
