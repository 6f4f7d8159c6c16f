"""Row filters by the joins of bounded neighbourhoods. Every anchor reads the input system only,
so anchors are independent: all neighbourhoods grow at once, by joins of schemas, and tasks join each of them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskspark.functions.kernel import join_project, natural_join, project
from maskspark.storage import cut
from maskspark.system import ContradictionError, System

def _near(system: System, sized: DataFrame) -> DataFrame:
    """anchor, own, t, shared and t's bits, arity and rows: the relations that share a bit with each anchor."""
    a, t = system.schema.select(F.col("table_id").alias("anchor"), "bit"), system.schema.select(F.col("table_id").alias("t"), "bit")
    met = a.join(t, "bit").where("anchor <> t").groupBy("anchor", "t").agg(F.count(F.lit(1)).cast("int").alias("shared"))
    own = sized.select(F.col("table_id").alias("anchor"), F.col("bits").alias("own"))
    return met.join(own, "anchor").join(_named(sized), "t")


def _named(sized: DataFrame) -> DataFrame:
    return sized.select(F.col("table_id").alias("t"), F.col("bits").alias("t_bits"), F.col("arity").alias("t_arity"), F.col("row_count").alias("t_rows"))


def _grown(start: DataFrame, candidates: Callable[[DataFrame], DataFrame], order: Callable[[], list[Column]], bits: int, most: int, least: int) -> DataFrame:
    """anchor, place, table_id: the groups that grow from start(anchor, own), all at once. In each round
    every group takes the first in order of its candidates(state) that is not in it and keeps its
    union within bits; groups that find none are done."""
    state = start.where(F.size("own") <= bits).select("anchor", "own", F.array("anchor").alias("chosen"), F.col("own").alias("union"))
    done = []
    for _ in range(most - 1):
        state = cut(state, "groups")
        free = candidates(state).where(~F.array_contains("chosen", F.col("t"))).withColumn("added", F.size(F.array_except("t_bits", "union")))
        first = free.where(F.size("union") + F.col("added") <= bits).groupBy("anchor").agg(F.min(F.struct(*order(), "t", "t_bits")).alias("x"))
        best = cut(first.select("anchor", F.col("x.t").alias("t"), F.col("x.t_bits").alias("t_bits")), "next")
        if best.isEmpty():
            break
        done.append(state.join(best, "anchor", "left_anti"))
        state = state.join(best, "anchor").select("anchor", "own", F.array_append("chosen", F.col("t")).alias("chosen"), F.array_union("union", "t_bits").alias("union"))
    whole = reduce(DataFrame.unionByName, [*done, state]).where(F.size("chosen") >= least)
    return cut(whole.select("anchor", F.posexplode("chosen").alias("place", "table_id")), "groups")


def neighbourhoods(system: System, bits: int = 32, most: int = 10, least: int = 3) -> DataFrame:
    """anchor, place, table_id: each anchor with its neighbours: most bits in common with it first, then fewest new bits, bits, rows, id."""
    sized = cut(system.sized, "sized")
    near = cut(_near(system, sized), "near")
    start = near.groupBy("anchor", "own").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") + 1 >= least)
    return _grown(start, lambda state: state.join(near.drop("own"), "anchor"), lambda: [-F.col("shared"), F.col("added"), F.col("t_arity"), F.col("t_rows")], bits, most, least)


def local_components(system: System, bits: int = 32, most: int = 12, least: int = 4) -> DataFrame:
    """anchor, place, table_id: components that grow from all bits chosen so far: most bits in common with them first, then with the anchor, fewest new bits, rows, bits, id."""
    sized = cut(system.sized, "sized")
    by_bit, named = system.schema.select(F.col("table_id").alias("t"), "bit"), _named(sized)

    def around(state: DataFrame) -> DataFrame:
        met = state.select("anchor", F.explode("union").alias("bit")).join(by_bit, "bit").select("anchor", "t").distinct()
        return met.join(state, "anchor").join(named, "t")

    common = lambda c: -F.size(F.array_intersect("t_bits", c))
    return _grown(sized.select(F.col("table_id").alias("anchor"), F.col("bits").alias("own")), around, lambda: [common("union"), common("own"), F.col("added"), F.col("t_rows"), F.col("t_arity")], bits, most, least)


def triangles(system: System, bits: int = 32, neighbours: int = 8, pairs: int = 8, shared: int = 1, product: int = 2_000_000) -> DataFrame:
    """anchor, x, y: pairs of each anchor's first neighbours that overlap each other, the first in order."""
    near = _near(system, cut(system.sized, "sized"))
    first = near.withColumn("r", F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("shared"), "t_arity", "t_rows", "t"))).where(F.col("r") <= neighbours)
    first = cut(first, "near")
    x, y = (first.select("anchor", "own", *(F.col(c).alias(f"{s}_{c}") for c in ("t", "shared", "t_bits", "t_rows", "r"))) for s in "xy")
    both = x.join(y.drop("own"), "anchor").where("x_r < y_r")
    both = both.withColumn("outer", F.size(F.array_intersect("x_t_bits", "y_t_bits"))).withColumn("rows", F.col("x_t_rows") * F.col("y_t_rows"))
    both = both.withColumn("width", F.size(F.array_union(F.array_union("own", "x_t_bits"), "y_t_bits")))
    fits = both.where((F.col("outer") >= shared) & (F.col("rows") <= product) & (F.col("width") <= bits))
    order = Window.partitionBy("anchor").orderBy(F.desc("outer"), F.desc(F.col("x_shared") + F.col("y_shared")), "width", "rows", "x_t", "y_t")
    return cut(fits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= pairs).select("anchor", "place", F.col("x_t").alias("x"), F.col("y_t").alias("y")), "triangles")


def _filtered(system: System, wanted: DataFrame, keep: Callable[[int, dict, list], np.ndarray], what: str) -> tuple[System, dict[str, int]]:
    """Each anchor's rows by keep(anchor, packed relations of its group, pairs) for wanted(anchor,
    table_id, pairs); others unchanged. A group is bounded by the filter's limits."""
    anchors = wanted.select("anchor").distinct().count()
    if not anchors:
        return system, {"anchors": 0, "changed_relations": 0, "removed_rows": 0}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        anchor = int(pdf["anchor"].iloc[0])
        held = {int(t): (list(map(int, b)), np.asarray(r, np.int64)) for t, b, r in zip(pdf["table_id"], pdf["bits"], pdf["rows"], strict=True)}
        pairs = next((p for p in pdf["pairs"] if p is not None), [])
        rows = keep(anchor, held, [(int(p["x"]), int(p["y"])) for p in pairs])
        return pd.DataFrame({"table_id": np.full(max(1, len(rows)), anchor), "row": rows if len(rows) else [-1], "empty": [not len(rows)] * max(1, len(rows))})

    found = cut(wanted.join(system.packed(), "table_id").groupBy("anchor").applyInPandas(run, "table_id long, row long, empty boolean"), "local")
    bad = found.where("empty").limit(1).collect()
    if bad:
        raise ContradictionError(f"{what}: table {bad[0].table_id} has no supported row")
    ids = wanted.select(F.col("anchor").alias("table_id")).distinct()
    out = System(system.relations, system.rows.join(ids, "table_id", "left_anti").unionByName(found.select("table_id", "row"))).saved()
    before = system.sized.select("table_id", F.col("row_count").alias("n"))
    changed = out.sized.join(before, "table_id").where("row_count < n").agg(F.count(F.lit(1)).alias("t"), F.coalesce(F.sum(F.col("n") - F.col("row_count")), F.lit(0)).alias("r")).first()
    return out, {"anchors": anchors, "changed_relations": changed.t, "removed_rows": changed.r}


_NO_PAIRS = "cast(null as array<struct<x:bigint,y:bigint>>)"


def _supported(anchor: int, held: dict, _: list) -> np.ndarray:
    return join_project(held[anchor], [t for i, t in sorted(held.items()) if i != anchor])[0]


def neighbourhood_join_filter(system: System, bits: int = 32, most: int = 10, least: int = 3) -> tuple[System, dict[str, int]]:
    system = system.canonical().indexed().saved()
    return _filtered(system, neighbourhoods(system, bits, most, least).selectExpr("anchor", "table_id", f"{_NO_PAIRS} as pairs"), _supported, "neighbourhood join")


def exact_elimination_filter(system: System, bits: int = 32, most: int = 12, least: int = 4) -> tuple[System, dict[str, int]]:
    system = system.canonical().indexed().saved()
    return _filtered(system, local_components(system, bits, most, least).selectExpr("anchor", "table_id", f"{_NO_PAIRS} as pairs"), _supported, "local elimination")


def triangle_filter(system: System, bits: int = 32, neighbours: int = 8, pairs: int = 8, shared: int = 1, product: int = 2_000_000) -> tuple[System, dict[str, int]]:
    system = system.canonical().indexed().saved()
    chosen = triangles(system, bits, neighbours, pairs, shared, product)
    # the pairs go with the anchor's own row, the relations of its pairs beside it
    own = chosen.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("pairs")).select("anchor", F.col("anchor").alias("table_id"), "pairs")
    others = chosen.select("anchor", F.explode(F.array("x", "y")).alias("table_id")).distinct().selectExpr("anchor", "table_id", f"{_NO_PAIRS} as pairs")

    def keep(anchor: int, held: dict, pairs: list) -> np.ndarray:
        bits_, rows = held[anchor]
        for x, y in pairs:
            outer, joined = natural_join(held[x], held[y])
            common = [b for b in bits_ if b in set(outer)]
            if common:
                allowed = np.unique(project(joined, [outer.index(b) for b in common]))
                rows = rows[np.isin(project(rows, [bits_.index(b) for b in common]), allowed)]
        return rows

    return _filtered(system, own.unionByName(others), keep, "triangle consistency")


def to_fixed_point(step: Callable[[System], tuple[System, dict[str, int]]], system: System, rounds: int | None = None) -> tuple[System, list[dict[str, int]]]:
    """A filter repeated until it removes no row, or rounds times."""
    log: list[dict[str, int]] = []
    while rounds is None or len(log) < rounds:
        system, stats = step(system)
        log.append(stats)
        if not stats["removed_rows"]:
            break
    return system, log
