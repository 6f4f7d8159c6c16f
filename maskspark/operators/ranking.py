"""Greedy choices: which pair to merge, which bit to take next."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from maskspark.functions.mask import rank
from maskspark.operators.joins import join_pairs, shared_pairs, shared_row_counts
from maskspark.operators.limits import check_arity
from maskspark.operators.metrics import incident_union_arity, related_bits
from maskspark.storage import cut
from maskspark.system import RELATIONS, System


#: The order in which candidates are taken.
BEST_FIRST = ("rank", "join_rows", "union_arity", "l_table_id", "r_table_id")


class CandidateQueue:
    """The overlapping pairs of a changing system, each counted once. A merge takes its two relations'
    pairs out and adds those of the new relation; no other pair is looked at again. Relations and
    pairs are kept as parts: the first system's, and what each merge added, with the ids that are
    gone. After COMPACT merges the parts are written as one."""

    COMPACT = 32

    def __init__(self, system: System):
        system = system.canonical().indexed().saved()
        self.gone: list[int] = []
        self.relations, self.rows, self.pairs = [system.relations], [system.rows], []
        self.next_id = system.relations.count()
        self.left = self.next_id
        self.pairs.append(cut(self._counted(system, shared_pairs(system)), "candidates"))

    @staticmethod
    def _counted(system: System, pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs, "pairs")
        counted = pairs.join(shared_row_counts(system, pairs=pairs), ["l_table_id", "r_table_id"]).withColumn("union_arity", F.size("union"))
        return counted.withColumn("rank", rank(F.col("join_rows"), F.col("union_arity")))

    def _alive(self, parts: list[DataFrame], *ids: str) -> DataFrame:
        df = reduce(DataFrame.unionByName, parts)
        for c in ids if self.gone else ():
            df = df.where(~F.col(c).isin(self.gone))
        return df

    @property
    def system(self) -> System:
        return System(self._alive(self.relations, "table_id"), self._alive(self.rows, "table_id"))

    def candidates(self) -> DataFrame:
        return self._alive(self.pairs, "l_table_id", "r_table_id")

    def pop(self, where: Column | None = None) -> Row | None:
        """The best candidate (of those that satisfy a condition)."""
        held = self.candidates() if where is None else self.candidates().where(where)
        return held.orderBy(*BEST_FIRST).limit(1).first()

    def merge(self, pair: Row) -> tuple[int, int]:
        """Replaces a candidate's relations by their join; the new id and its rows."""
        check_arity(pair.union_arity)
        spark, new = self.relations[0].sparkSession, self.next_id
        one = spark.createDataFrame([pair], self.pairs[0].schema)
        joined = join_pairs(one, self.system).select(F.lit(new).cast("long").alias("table_id"), "row").distinct()
        self.rows.append(cut(joined, "merged"))
        self.relations.append(spark.createDataFrame([(new, list(pair.union))], RELATIONS))
        self.gone += [pair.l_table_id, pair.r_table_id]
        self.next_id, self.left = new + 1, self.left - 1
        system = self.system
        self.pairs.append(cut(self._counted(system, shared_pairs(system, right=new)), "candidates"))
        if len(self.pairs) > self.COMPACT:
            self.relations, self.rows, self.pairs = [cut(system.relations)], [cut(system.rows)], [cut(self.candidates(), "candidates")]
            self.gone = []
        return new, pair.join_rows  # a join has just as many rows as were counted


def merge_candidates(system: System, least: int = 1) -> DataFrame:
    """l_table_id, r_table_id, union_arity, join_rows, rank of every overlapping pair, by exact counts."""
    pairs = shared_pairs(system, least).select("l_table_id", "r_table_id", F.size("union").alias("union_arity"))
    return pairs.join(shared_row_counts(system, least), ["l_table_id", "r_table_id"]).withColumn("rank", rank(F.col("join_rows"), F.col("union_arity")))


def best_pair(system: System, top: int = 1) -> DataFrame:
    """The pairs of least rank, then rows, union arity and ids."""
    return merge_candidates(system).orderBy(*BEST_FIRST).limit(top)


def min_related_bit(system: System) -> int | None:
    """The bit that shares relations with the fewest other bits."""
    r = related_bits(system).orderBy(F.size("related"), "bit").limit(1).collect()
    return r[0].bit if r else None


def central_bits(system: System, cap: int = 32) -> DataFrame:
    """bit, row_total, relations, related: bits with at most cap related bits; most rows first, then most relations."""
    rows = system.schema.join(system.sized.select("table_id", "row_count"), "table_id").groupBy("bit").agg(F.sum("row_count").alias("row_total"))
    return incident_union_arity(system).join(rows, "bit").where(F.col("union_arity") - 1 <= cap).select("bit", "row_total", "relations", (F.col("union_arity") - 1).alias("related")).orderBy(F.desc("row_total"), F.desc("relations"), "bit")


def next_central_bit(system: System, done: set[int], cap: int = 32, fewest: bool = True) -> int | None:
    """The next bit to eliminate: fewest (or most) related bits first, then least id."""
    left = central_bits(system, cap).where(~F.col("bit").isin(sorted(done))) if done else central_bits(system, cap)
    r = left.orderBy(F.asc("related") if fewest else F.desc("related"), "bit").limit(1).collect()
    return r[0].bit if r else None


def best_partner(system: System, table_id: int) -> DataFrame:
    """Every other table by the rank of its join with one table; disjoint relations count by the product of rows."""
    mine = system.sized.where(F.col("table_id") == table_id).first()
    sized = system.sized.where(F.col("table_id") != table_id)
    overlapping = merge_candidates(system).where((F.col("l_table_id") == table_id) | (F.col("r_table_id") == table_id))
    named = overlapping.select(F.when(F.col("l_table_id") == table_id, F.col("r_table_id")).otherwise(F.col("l_table_id")).alias("table_id"), "union_arity", "join_rows")
    all_ = sized.join(named, "table_id", "left")
    arity = F.coalesce("union_arity", F.col("arity") + mine.arity)
    n = F.coalesce("join_rows", F.col("row_count") * mine.row_count)
    return all_.select("table_id", arity.alias("union_arity"), n.alias("join_rows"), rank(n, arity).alias("rank")).orderBy("rank", "join_rows", "union_arity", "table_id")


def neighbours(system: System) -> DataFrame:
    """bit, other: each pair of bits in one relation, both ways, and each bit with itself."""
    bits = system.relations.select(F.explode("bits").alias("bit"), "bits").select("bit", F.explode("bits").alias("other"))
    return bits.distinct()


#: How a central bit is chosen: expressions over its counts, in their order.
CENTRAL_ORDERS = {
    "fewest_related": (F.asc, "related"),
    "most_related": (F.desc, "related"),
    "derived_first": (F.desc, "known", "initial"),
}


def choose_central_bit(related: DataFrame, done: list[int], known: DataFrame, cap: int = 32, order: str = "fewest_related") -> Row | None:
    """bit, initial, related, known of the best bit not done, or None: its neighbours at the start, those
    not done, and those (other than itself) in known(bit). Bits with more than cap neighbours not done are
    no candidates. fewest_related and most_related go by the neighbours not done, derived_first by the
    known ones and then by those at the start, most first; the least bit breaks ties."""
    direction, *by = CENTRAL_ORDERS[order]
    left = related.where(~F.col("bit").isin(done)) if done else related
    open_ = ~F.col("other").isin(done) if done else F.lit(True)
    told = left.join(known.select(F.col("bit").alias("other"), F.lit(True).alias("is_known")), "other", "left")
    counted = told.groupBy("bit").agg(
        F.count(F.lit(1)).alias("initial"),
        F.count_if(open_).alias("related"),
        F.count_if(F.col("is_known").isNotNull() & (F.col("other") != F.col("bit"))).alias("known"),
    )
    return counted.where(F.col("related") <= cap).orderBy(*(direction(c) for c in by), "bit").limit(1).first()
