"""Central bits taken out one by one: what their relations imply about other bits is kept apart and takes part later."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from maskspark.functions.mask import positions_of, project
from maskspark.operators import joins
from maskspark.operators.ranking import choose_central_bit, neighbours
from maskspark.storage import cut
from maskspark.system import RELATIONS, ROWS, System


@dataclass(frozen=True)
class DerivedMains:
    """What a run leaves: the relations that no cycle took, the derived ones (their ids are the cycles), and each cycle's record."""

    before: System
    system: System
    mains: System
    log: list[Row]


def _each_sorted(system: System) -> System:
    """Every relation with ascending bits and distinct rows; equal schemas stay apart."""
    order = F.array_sort("bits")
    moved = system.relations.select("table_id", order.alias("sorted"), positions_of(order, F.col("bits")).alias("from"))
    rows = system.rows.join(moved, "table_id").select("table_id", project(F.col("row"), F.col("from")).alias("row")).distinct()
    return System(moved.select("table_id", F.col("sorted").alias("bits")), rows)


def _union(relations: DataFrame) -> list[int]:
    return sorted(r.bit for r in relations.select(F.explode("bits").alias("bit")).distinct().collect())


class _Run:
    """The live system as what was written last and the ids gone since; derived relations as parts."""

    COMPACT = 32

    def __init__(self, system: System):
        self.start = self.held = _each_sorted(system).saved()
        self.gone: list[DataFrame] = []
        spark = system.relations.sparkSession
        self.mains = System(spark.createDataFrame([], RELATIONS), spark.createDataFrame([], ROWS))
        self.parts = 0
        self.relations, self.rows, self.bits = self.held.counts()

    @property
    def live(self) -> System:
        return self.held.except_(reduce(DataFrame.unionByName, self.gone)) if self.gone else self.held

    def take(self, ids: DataFrame, relations: int, rows: int) -> None:
        self.gone.append(ids)
        self.relations, self.rows = self.relations - relations, self.rows - rows
        if len(self.gone) >= self.COMPACT:
            self.held, self.gone = self.live.saved(), []
        self.bits = self.live.schema.select("bit").distinct().count()

    def keep(self, cycle: int, bits: list[int], rows: DataFrame) -> None:
        relations = self.mains.relations.sparkSession.createDataFrame([(cycle, bits)], RELATIONS)
        self.mains = System(self.mains.relations.unionByName(relations), self.mains.rows.unionByName(rows.select(F.lit(cycle).cast("long").alias("table_id"), "row")))
        self.parts += 1
        if self.parts % self.COMPACT == 0:
            self.mains = self.mains.saved()


def derived_main_cycles(system: System, cycles: int = 1000, cap: int = 32, order: str = "fewest_related", initial: bool = False) -> DerivedMains:
    """In each cycle a bit is chosen (see choose_central_bit) and a main relation is made: the join of
    all relations that hold the bit, of those whose schemas are within theirs, and of the earlier
    derived relations that share one of its neighbours, each projected to the bit and its neighbours (with initial, those at
    the start, else those not chosen yet), unless that projection allows everything. The system's relations among them leave it. The main
    without the bit is kept as a derived relation, unless it has no row or allows everything. A bit
    whose main would have more than cap bits, or that no relation holds any longer, is skipped.
    The choice is made on the driver, from counts by bit; rows stay in DataFrames."""
    run, log, done = _Run(system), [], []
    related = cut(neighbours(run.held), "neighbours")
    while len(log) < cycles:
        known = run.mains.schema.select("bit").distinct()
        choice = choose_central_bit(related, done, known, cap, order)
        if choice is None:
            break
        record = _cycle(run, len(log) + 1, choice, related, done, cap, initial)
        log.append(Row(cycle=len(log) + 1, bit=choice.bit, related=choice.related, known=choice.known, **record, relations_left=run.relations, rows_left=run.rows, bits_left=run.bits))
        done.append(choice.bit)
    return DerivedMains(run.start, run.live.saved(), run.mains.saved(), log)


def _cycle(run: _Run, cycle: int, choice: Row, related: DataFrame, done: list[int], cap: int, initial: bool) -> dict:
    record = dict.fromkeys(("incident", "absorbed", "taken_rows", "considered", "merged", "main_bits", "main_rows", "kept_bits", "kept_rows"), 0)
    bit, live, spark = choice.bit, run.live, run.held.relations.sparkSession
    incident = live.schema.where(F.col("bit") == bit).select("table_id").distinct()
    union = _union(live.relations.join(incident, "table_id", "left_semi"))
    if not union:
        return record | {"outcome": "absent"}
    if len(union) > cap:
        return record | {"outcome": "too wide"}
    whole = F.array(*(F.lit(b).cast("long") for b in union))
    within = (F.size(F.array_except("bits", whole)) == 0) & (F.size("bits") < len(union))
    holds = F.array_contains("bits", F.lit(bit).cast("long"))
    ids = cut(live.relations.where(holds | within).select("table_id", holds.alias("holds")), "taken")
    taken = live.only(ids).saved()

    near = related.where(F.col("bit") == bit).select(F.col("other").alias("bit"))
    if done and not initial:
        near = near.where(~F.col("bit").isin(done))
    touched = run.mains.schema.join(near.where(F.col("bit") != bit), "bit", "left_semi").select("table_id").distinct()
    parts = run.mains.only(touched).keep_bits(near).saved()
    telling = cut(parts.sized.where("row_count < shiftleft(1L, arity)").select("table_id"), "telling")
    parts = parts.only(telling)
    bits = sorted({*union, *_union(parts.relations)})
    if len(bits) > cap:
        return record | {"outcome": "too wide"}
    apart = lambda df: df.withColumn("table_id", -1 - F.col("table_id"))
    # equal schemas meet first: one step of the join for each schema
    main = joins.join_all(System(taken.relations.unionByName(apart(parts.relations)), taken.rows.unionByName(apart(parts.rows))).canonical().saved()).saved()
    rest = main.keep_bits(spark.createDataFrame([(bit,)], "bit long"), keep=False).saved()
    kept, kept_bits = rest.rows.count(), len(bits) - 1
    held = {r.holds: r["count"] for r in ids.groupBy("holds").count().collect()}
    record |= {
        "incident": held.get(True, 0), "absorbed": held.get(False, 0), "taken_rows": taken.rows.count(), "considered": touched.count(), "merged": telling.count(),
        "main_bits": len(bits), "main_rows": main.rows.count(), "kept_bits": kept_bits, "kept_rows": kept,
    }
    run.take(ids.select("table_id"), sum(held.values()), record["taken_rows"])
    if kept == 0:
        return record | {"outcome": "empty"}
    if kept == 1 << kept_bits:
        return record | {"outcome": "tautology"}
    run.keep(cycle, [b for b in bits if b != bit], rest.rows)
    return record | {"outcome": "stored"}
