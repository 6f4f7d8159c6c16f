"""Functional dependencies between bits, and what follows from known bits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskspark.functions.mask import bit_at, positions_of, project, put
from maskspark.operators.metrics import best_by
from maskspark.storage import cut, numbered
from maskspark.system import System


def _subsets(arity: Column) -> Column:
    return F.sequence(F.lit(0).cast("long"), put(F.lit(1), arity) - 1)


def determining_sets(system: System, empty: bool = False, full: bool = False) -> DataFrame:
    """table_id, target, bits (determining set), full_domain, arity, row_count: the minimal sets of
    each table and target. All masks of all relations are tested in one aggregate. full: only sets
    of which every assignment occurs count, so a minimal one may hold a set that determines the target too."""
    sized = system.sized.where("arity > 0 and row_count > 0")
    cell = sized.select("table_id", "bits", "arity", "row_count", F.explode(F.sequence(F.lit(0), F.col("arity") - 1)).alias("pos"))
    test = cell.select("*", F.explode(_subsets(F.col("arity"))).alias("mask")).where(F.col("mask").bitwiseAND(put(F.lit(1), F.col("pos"))) == 0)
    if not empty:
        test = test.where("mask <> 0")
    keyed = test.join(system.rows, "table_id").select("table_id", "pos", "mask", F.col("row").bitwiseAND(F.col("mask")).alias("key"), bit_at(F.col("row"), F.col("pos")).alias("value"))
    each = keyed.groupBy("table_id", "pos", "mask", "key").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    holds = each.groupBy("table_id", "pos", "mask").agg(F.max((F.col("low") != F.col("high")).cast("int")).alias("broken"), F.count(F.lit(1)).alias("keys")).where("broken = 0")
    if full:
        holds = holds.where(F.col("keys") == put(F.lit(1), F.bit_count("mask")))
    mine = holds.groupBy("table_id", "pos").agg(F.collect_list("mask").alias("all"))  # at most 2^arity masks
    least = mine.select("table_id", "pos", F.explode(F.filter("all", lambda m: ~F.exists("all", lambda o: (o != m) & (o.bitwiseAND(m) == o)))).alias("mask"))
    found = least.join(holds, ["table_id", "pos", "mask"]).join(sized, "table_id")
    inside = F.filter("bits", lambda _, i: bit_at(F.col("mask"), i) == 1)
    return found.select("table_id", F.col("bits")[F.col("pos")].alias("target"), inside.alias("bits"), (F.col("keys") == put(F.lit(1), F.size(inside))).alias("full_domain"), "arity", "row_count")


def best_rules(system: System, empty: bool = False, full: bool = False) -> DataFrame:
    """One rule for each target and determining set: full domains first, then few bits, few rows, least table."""
    rules = determining_sets(system, empty, full)
    return best_by(rules, F.desc("full_domain"), "arity", "row_count", "table_id", per=["target", "bits"]).select("target", "bits", "full_domain", "table_id", "arity", "row_count")


def all_dependencies(system: System) -> DataFrame:
    """table_id, from_bits, to_bits, full_domain: every dependency Y <- X over non-empty disjoint X, Y of a table."""
    sized = system.sized.where("arity >= 2 and row_count > 0")
    union = sized.select("table_id", "bits", F.explode(_subsets(F.col("arity"))).alias("all")).where(F.bit_count("all") >= 2)
    part = union.select("*", F.explode(F.filter(_subsets(F.size("bits")), lambda m: (m.bitwiseAND(F.col("all")) == m) & (m != 0) & (m != F.col("all")))).alias("x"))
    keyed = part.join(system.rows, "table_id").select("table_id", "all", "x", F.col("row").bitwiseAND(F.col("x")).alias("key"), F.col("row").bitwiseAND(F.col("all")).alias("whole")).distinct()
    counts = keyed.groupBy("table_id", "all", "x").agg(F.count(F.lit(1)).alias("wholes"), F.countDistinct("key").alias("keys")).where("wholes = keys")
    named = lambda m: F.filter("bits", lambda _, i: bit_at(m, i) == 1)
    found = counts.join(sized.select("table_id", "bits"), "table_id")
    return found.select("table_id", named(F.col("x")).alias("from_bits"), named(F.col("all").bitwiseAND(F.bitwise_not("x"))).alias("to_bits"), (F.col("keys") == put(F.lit(1), F.bit_count("x"))).alias("full_domain"))


def dependency_relations(system: System, rules: DataFrame) -> System:
    """The projected table of each rule, one for each rule: ids are hashes of the rule."""
    named = rules.select(F.xxhash64("table_id", F.size("from_bits"), "from_bits", "to_bits").alias("new"), "table_id", F.array_sort(F.array_union("from_bits", "to_bits")).alias("new_bits")).join(system.relations, "table_id")
    rows = named.select("new", "table_id", positions_of(F.col("new_bits"), F.col("bits")).alias("at")).join(system.rows, "table_id").select(F.col("new").alias("table_id"), project(F.col("row"), F.col("at")).alias("row")).distinct()
    return System(named.select(F.col("new").alias("table_id"), F.col("new_bits").alias("bits")), rows)


def constant_bits(system: System) -> DataFrame:
    """bit, value of bits with one value in a table."""
    from maskspark.operators.reductions import forced_bits

    return forced_bits(system).select("bit", "value")


def closure(system: System, origins: list[int], most: int | None = None, full: bool = False, empty: bool = False) -> tuple[DataFrame, DataFrame]:
    """What follows from the origins: (bit, generation, bits, generations, full_domain, table_id, arity,
    row_count), and the bits that never follow. A bit comes in the generation after the last bit of
    some determining set; of the rules ready then, its witness has the fewest bits, then a full
    domain, least arity, rows, table and bits. Each round looks only at the rules that the newest
    bits are in: a rule counts the bits that it still lacks, and is ready at none."""
    spark = system.relations.sparkSession
    rules = cut(numbered(best_rules(system, empty, full), "target", "bits", name="rule"), "rules")
    needs = cut(rules.select("rule", F.explode("bits").alias("bit")), "needs")
    new = spark.createDataFrame([(b,) for b in sorted(set(origins))], "bit long")
    reached = [rules.limit(0).select(F.col("target").alias("bit"), F.lit(0).alias("generation"), "bits", "full_domain", "table_id", "arity", "row_count")]
    reached.append(new.select("bit", F.lit(0).alias("generation"), *(F.lit(None).cast(reached[0].schema[c].dataType).alias(c) for c in reached[0].columns[2:])))
    waiting = rules.select("rule", "target", F.size("bits").alias("lacks"))
    generation = 0
    while most is None or generation < most:
        generation += 1
        met = needs.join(new, "bit").groupBy("rule").agg(F.count(F.lit(1)).alias("met"))
        left = waiting.join(new.withColumnRenamed("bit", "target"), "target", "left_anti").join(met, "rule", "left")
        waiting = cut(left.select("rule", "target", (F.col("lacks") - F.coalesce("met", F.lit(0))).cast("int").alias("lacks")), "waiting")
        ready = waiting.where("lacks = 0").select("rule").join(rules, "rule")
        first = best_by(ready, F.size("bits"), F.desc("full_domain"), "arity", "row_count", "table_id", "bits", per=["target"])
        found = cut(first.select(F.col("target").alias("bit"), F.lit(generation).alias("generation"), "bits", "full_domain", "table_id", "arity", "row_count"), "reached")
        if found.isEmpty():
            break
        reached.append(found)
        new = found.select("bit")
    known = cut(reduce(DataFrame.unionByName, reached), "known")
    each = known.select(F.col("bit").alias("of"), F.posexplode("bits").alias("pos", "bit")).join(known.select("bit", "generation"), "bit")
    when = each.groupBy("of").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "generation"))), lambda x: x["generation"]).alias("generations"))
    empty_ = F.when(F.col("bits").isNotNull(), F.array().cast("array<int>"))
    out = known.join(when, F.col("bit") == F.col("of"), "left").select("bit", "generation", "bits", F.coalesce("generations", empty_).alias("generations"), "full_domain", "table_id", "arity", "row_count")
    return out, system.schema.select("bit").distinct().join(known.select("bit"), "bit", "left_anti")


def generations(system: System, origins: list[int], most: int | None = None) -> tuple[list[list[int]], list[int], bool]:
    """The same as lists for a report: the bits of each round; the bits that never follow; whether it
    ended by itself. Bounded runs keep empty rounds while bits are missing."""
    found, missing = closure(system, origins, most)
    rounds: dict[int, list[int]] = {0: []}
    for r in found.select("bit", "generation").collect():
        rounds.setdefault(r.generation, []).append(r.bit)
    never = sorted(r.bit for r in missing.collect())
    last = max(rounds)
    total = most if most is not None and never else last
    return [sorted(rounds.get(g, [])) for g in range(total + 1)], never, most is None or not never
