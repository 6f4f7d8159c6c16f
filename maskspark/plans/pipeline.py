"""The reduction pipeline: seven steps, repeated to a fixed point."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskspark.operators import equivalence
from maskspark.operators import reductions as r
from maskspark.storage import cut
from maskspark.system import ContradictionError, System


HISTORY = "round int, iteration int, left long, right long, inverted boolean, support long, arities array<int>"


@dataclass
class Reduced:
    system: System
    nodes: System | None
    #: bit, representative, inverted of every original bit.
    mapping_frame: DataFrame
    #: bit, value of forced original bits.
    forced_frame: DataFrame
    #: The pair relations found in each round and iteration of the pair step.
    history: DataFrame
    rounds: list[dict[str, dict[str, int]]] = field(default_factory=list)

    @cached_property
    def mapping(self) -> dict[int, tuple[int, bool]]:
        """bit -> (representative, inverted); for reports and small systems."""
        return {x.bit: (x.representative, x.inverted) for x in self.mapping_frame.collect()}

    @cached_property
    def forced(self) -> dict[int, int]:
        return {x.bit: int(x.value) for x in self.forced_frame.collect()}

    def components(self) -> list[tuple[int, list[tuple[int, bool]]]]:
        """Classes of equal or opposite bits, the largest first: representative and members."""
        groups: dict[int, list[tuple[int, bool]]] = {}
        for x in equivalence.classes(self.mapping_frame, self.forced_frame).orderBy("bit").collect():
            groups.setdefault(x.representative, []).append((x.bit, x.inverted))
        return sorted(groups.items(), key=lambda g: (-len(g[1]), g[0]))

    def report(self) -> dict:
        relations, rows, bits = self.system.counts()
        return {"rounds": self.rounds, "relations": relations, "rows": rows, "bits": bits, "forced_bits": self.forced_frame.count(), "components": len(self.components())}


def reduce_system(system: System, protected: set[int] = frozenset(), zero_collapse: bool = True, max_rounds: int | None = None) -> Reduced:
    """Absorption, forced bits, single-table bits, pair relations (to their own fixed point),
    zero-collapse bits, tautologies, shared subrelations; until a round changes nothing. A
    max_rounds of 0 counts as 1. Raises ContradictionError where a table loses its last row."""
    spark = system.relations.sparkSession
    system = system.canonical().saved().must_hold("input")
    guard = spark.createDataFrame([(b,) for b in sorted(protected)], "bit long")
    mapping = cut(system.schema.select("bit").distinct().select("bit", F.col("bit").alias("representative"), F.lit(False).alias("inverted")), "mapping")
    out = Reduced(system, None, mapping, spark.createDataFrame([], "bit long, value int"), spark.createDataFrame([], HISTORY))
    while True:
        log: dict[str, dict[str, int]] = {}
        system, log["absorption"] = r.subset_absorption(system)
        system, found, log["forced"] = r.force_step(system)
        system.must_hold("forced bits")
        if log["forced"]["forced_bits"]:
            out.forced_frame = cut(out.forced_frame.unionByName(r.original_forced(mapping, found)), "forced")
        system, log["single"] = r.single_table_bits(system, guard)
        log["pairs"] = {"relations": 0, "replaced_bits": 0}
        for iteration in itertools.count(1):
            system, moves, told, stats = r.rewrite_step(system, protected)
            log["pairs"] = {k: log["pairs"][k] + stats[k] for k in stats}
            if stats["relations"]:
                out.history = out.history.unionByName(told.select(F.lit(len(out.rounds) + 1).alias("round"), F.lit(iteration).alias("iteration"), "left", "right", "inverted", "support", "arities"))
            if not stats["replaced_bits"]:
                break
            mapping = out.mapping_frame = cut(equivalence.compose(mapping, moves), "mapping")
        if zero_collapse:
            system, log["zero_collapse"] = r.zero_collapse_bits(system, guard)
        system, log["tautologies"] = r.tautology_filter(system)
        system, out.nodes, log["nodes"] = r.node_filter(system.saved())
        out.system = system
        out.rounds.append(log)
        changed = any(stats.get(k) for stats in log.values() for k in ("rows_removed", "dropped_relations", "forced_bits", "removed_bits", "replaced_bits", "removed_relations", "row_deletions", "collapsed_relations"))
        if not changed or (max_rounds is not None and len(out.rounds) >= max(1, max_rounds)):
            return out


def with_assignment(system: System, values: dict[int, int], **kwargs) -> Reduced | None:
    """The pipeline after some bits are set; None if that contradicts the system."""
    spark = system.relations.sparkSession
    try:
        forced = r.propagate_forced(system, spark.createDataFrame(sorted(values.items()), "bit long, value int")).saved()
        return reduce_system(forced.must_hold("assignment"), **kwargs)
    except ContradictionError:
        return None


class SplitMix:
    """The splitmix64 generator (fixed constants), for reproducible trials."""

    def __init__(self, seed: int):
        self.state = seed & (1 << 64) - 1

    def next(self) -> int:
        wrap = (1 << 64) - 1
        self.state = (self.state + 0x9E3779B97F4A7C15) & wrap
        z = self.state
        z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 & wrap
        z = (z ^ (z >> 27)) * 0x94D049BB133111EB & wrap
        return z ^ (z >> 31)


def random_assignments(system: System, origins: list[int], trials: int = 64, seed: int = 20260407, **kwargs) -> list[tuple[dict[int, int], bool]]:
    """Full assignments of the origins, drawn bit by bit, and whether the pipeline finds no contradiction."""
    draw, out = SplitMix(seed), []
    for _ in range(trials):
        values = {b: draw.next() & 1 for b in origins}
        out.append((values, with_assignment(system, values, **kwargs) is not None))
    return out


def solution_exists(reduced: Reduced | None) -> bool:
    return reduced is not None and not reduced.system.sized.where(F.col("row_count") == 0).count()
