"""Systems of boolean relations.

A system is two DataFrames: relations(table_id, bits) and rows(table_id, row). A table with no rows
or no bits still has its entry in relations. Names in relations and rows are fixed; ids are any
distinct longs and only mean the canonical order after indexed().
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskspark.functions.mask import is_full, positions_of, project
from maskspark.storage import cut, numbered

RELATIONS = "table_id long, bits array<long>"
ROWS = "table_id long, row long"


class ContradictionError(ValueError):
    """No assignment satisfies the system."""


@dataclass(frozen=True)
class System:
    relations: DataFrame
    rows: DataFrame

    @staticmethod
    def of(spark: SparkSession, relations: Iterable[tuple[list[int], list[int]]]) -> System:
        """A system from (bits, rows) pairs."""
        held = list(relations)
        return System(
            spark.createDataFrame([(i, list(b)) for i, (b, _) in enumerate(held)], RELATIONS),
            spark.createDataFrame([(i, r) for i, (_, rows) in enumerate(held) for r in rows], ROWS),
        )

    def local(self) -> list[tuple[list[int], list[int]]]:
        """(bits, rows) in canonical order; for small systems and reports."""
        packed = self.packed().select("bits", "rows").collect()
        return sorted(((list(r.bits), list(r.rows)) for r in packed), key=lambda t: (len(t[0]), t[0], t[1]))

    def packed(self) -> DataFrame:
        """table_id, bits, rows (sorted): a table's rows in one value."""
        grouped = self.rows.groupBy("table_id").agg(F.array_sort(F.collect_set("row")).alias("rows"))
        return self.relations.join(grouped.hint("merge"), "table_id", "left").withColumn("rows", F.coalesce("rows", F.array().cast("array<long>")))

    @staticmethod
    def unpacked(packed: DataFrame) -> System:
        return System(packed.select("table_id", "bits"), packed.select("table_id", F.explode("rows").alias("row")))

    @cached_property
    def sized(self) -> DataFrame:
        """table_id, bits, arity, row_count."""
        n = self.rows.groupBy("table_id").agg(F.count(F.lit(1)).alias("row_count"))
        return self.relations.join(n, "table_id", "left").select("table_id", "bits", F.size("bits").alias("arity"), F.coalesce("row_count", F.lit(0).cast("long")).alias("row_count"))

    @cached_property
    def schema(self) -> DataFrame:
        """table_id, pos, bit."""
        return self.relations.select("table_id", F.posexplode("bits").alias("pos", "bit"))

    def canonical(self) -> System:
        """Bits ascending, rows distinct, equal schemas joined by intersection under their least id."""
        order = F.array_sort("bits")
        moved = self.relations.select("table_id", order.alias("sorted"), positions_of(order, F.col("bits")).alias("from"))
        relations = moved.groupBy(F.col("sorted").alias("bits")).agg(F.min("table_id").alias("first"), F.count(F.lit(1)).alias("n"))
        rows = self.rows.join(moved, "table_id").select("table_id", F.col("sorted").alias("bits"), project(F.col("row"), F.col("from")).alias("row")).distinct()
        held = rows.groupBy("bits", "row").agg(F.count(F.lit(1)).alias("held"))
        kept = held.join(relations, "bits").where("held = n").select(F.col("first").alias("table_id"), "row")
        return System(relations.select(F.col("first").alias("table_id"), "bits"), kept)

    def indexed(self) -> System:
        """Ids by (arity, bits) from 0: the canonical order, counted over ranges without one task for all relations."""
        keyed = self.relations.select(F.size("bits").alias("arity"), "bits", F.col("table_id").alias("old"))
        new = numbered(keyed, "arity", "bits", "old", name="new")
        rows = self.rows.join(new.select("old", "new"), self.rows["table_id"] == new["old"]).select(F.col("new").alias("table_id"), "row")
        return System(new.select(F.col("new").alias("table_id"), "bits"), rows)

    def saved(self) -> System:
        """Both parts written and read again."""
        return System(cut(self.relations, "relations"), cut(self.rows, "rows"))

    def must_hold(self, what: str) -> System:
        """Raises if a table has no row left."""
        empty = self.sized.where("row_count = 0").limit(1).collect()
        if empty:
            raise ContradictionError(f"{what}: table over bits {empty[0].bits} has no rows")
        return self

    def fingerprint(self) -> tuple:
        """Counts and hash sums of schemas and rows: equal for equal systems, whatever their ids."""
        row = self.rows.join(self.relations, "table_id").agg(F.count(F.lit(1)), F.sum(F.xxhash64("bits", "row").cast("decimal(38,0)"))).first()
        schema = self.relations.agg(F.count(F.lit(1)), F.sum(F.xxhash64("bits").cast("decimal(38,0)"))).first()
        return (*row, *schema)

    def counts(self) -> tuple[int, int, int]:
        """Relations, rows, distinct bits."""
        r = self.sized.agg(F.count(F.lit(1)), F.coalesce(F.sum("row_count"), F.lit(0))).first()
        return r[0], r[1], self.schema.select("bit").distinct().count()

    def tautologies(self) -> DataFrame:
        return self.sized.where(is_full(F.col("row_count"), F.col("arity")))

    def only(self, ids: DataFrame) -> System:
        """The relations whose table_id is in ids."""
        return System(self.relations.join(ids.select("table_id"), "table_id", "left_semi"), self.rows.join(ids.select("table_id"), "table_id", "left_semi"))

    def except_(self, ids: DataFrame) -> System:
        """The relations whose table_id is not in ids."""
        return System(self.relations.join(ids.select("table_id"), "table_id", "left_anti"), self.rows.join(ids.select("table_id"), "table_id", "left_anti"))

    def keep_bits(self, bits: DataFrame, keep: bool = True) -> System:
        """Each table projected to its bits that are (or, keep=False, are not) in bits(bit); rows distinct."""
        named = self.schema.join(bits.select("bit").distinct().withColumn("hit", F.lit(True)), "bit", "left")
        wanted = named.where("hit" if keep else "hit is null")
        parts = wanted.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("pos", "bit"))).alias("p"))
        new = self.relations.select("table_id").join(parts, "table_id", "left").select(
            "table_id",
            F.coalesce(F.transform("p", lambda x: x["bit"]), F.array().cast("array<long>")).alias("bits"),
            F.coalesce(F.transform("p", lambda x: x["pos"]), F.array().cast("array<int>")).alias("from"),
        )
        rows = self.rows.join(new, "table_id").select("table_id", project(F.col("row"), F.col("from")).alias("row")).distinct()
        return System(new.select("table_id", "bits"), rows)
