"""Natural joins of relations, one pair or all pairs at once, and their cardinalities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskspark.functions.mask import contains_all, is_full, positions_of, project, project_to, scatter, scatter_to
from maskspark.operators import limits
from maskspark.storage import cut, scratch, stored
from maskspark.system import System


def shared_pairs(system: System, least: int = 1, right: int | None = None) -> DataFrame:
    """l_table_id < r_table_id with at least `least` shared bits: also l_bits, r_bits, shared, union
    (sorted). Pairs that need two bits meet on pairs of bits, so a bit of many relations makes no pair by itself.
    right: only pairs of that relation with those of smaller ids."""
    key = system.schema.select("table_id", "bit")
    if least > 1:
        other = key.withColumnRenamed("bit", "high")
        key = key.join(other, "table_id").where("bit < high").select("table_id", "bit", "high")
    on = [c for c in key.columns if c != "table_id"]
    a, b = (key.select(F.col("table_id").alias(f"{s}_table_id"), *on) for s in "lr")
    if right is not None:
        b = b.where(F.col("r_table_id") == right)
    met = a.join(b, on).where("l_table_id < r_table_id")
    bits = F.collect_set("bit") if least == 1 else F.array_union(F.collect_set("bit"), F.collect_set("high"))
    ids = met.groupBy("l_table_id", "r_table_id").agg(F.array_sort(bits).alias("shared")).where(F.size("shared") >= least)
    for s in "lr":
        ids = ids.join(system.relations.select(F.col("table_id").alias(f"{s}_table_id"), F.col("bits").alias(f"{s}_bits")), f"{s}_table_id")
    return ids.withColumn("union", F.array_sort(F.array_union("l_bits", "r_bits")))


def _keyed(pairs: DataFrame, system: System, side: str) -> DataFrame:
    """The pairs' rows of one side with the mask over the shared bits."""
    rows = system.rows.select(F.col("table_id").alias(f"{side}_table_id"), F.col("row").alias(f"{side}_row"))
    named = pairs.select("l_table_id", "r_table_id", positions_of(F.col("shared"), F.col(f"{side}_bits")).alias("at"), positions_of(F.col(f"{side}_bits"), F.col("union")).alias("to"))
    return named.join(rows, f"{side}_table_id").select("l_table_id", "r_table_id", project(F.col(f"{side}_row"), F.col("at")).alias("key"), scatter(F.col(f"{side}_row"), F.col("to")).alias(f"{side}_mask"))


def join_pairs(pairs: DataFrame, system: System) -> DataFrame:
    """(l_table_id, r_table_id, row): the natural joins of all pairs, over their unions. One shuffle joins every pair; no pair is a Cartesian product beyond its own shared bits."""
    l, r = _keyed(pairs, system, "l"), _keyed(pairs, system, "r")
    return l.join(r, ["l_table_id", "r_table_id", "key"]).select("l_table_id", "r_table_id", F.col("l_mask").bitwiseOR(F.col("r_mask")).alias("row"))


def shared_row_counts(system: System, least: int = 1, pairs: DataFrame | None = None) -> DataFrame:
    """l_table_id, r_table_id, join_rows: exact join sizes from counts by shared assignment, without joining rows; of the given pairs, else of all."""
    pairs = shared_pairs(system, least) if pairs is None else pairs
    counted = [_keyed(pairs, system, s).groupBy("l_table_id", "r_table_id", "key").agg(F.count(F.lit(1)).alias(f"n_{s}")) for s in "lr"]
    sums = counted[0].join(counted[1], ["l_table_id", "r_table_id", "key"]).groupBy("l_table_id", "r_table_id").agg(F.sum(F.col("n_l") * F.col("n_r")).alias("join_rows"))
    return pairs.select("l_table_id", "r_table_id").join(sums, ["l_table_id", "r_table_id"], "left").na.fill(0, ["join_rows"])


def join_two(left: System, right: System) -> System:
    """The natural join of two one-table systems; disjoint bits give all combinations, equal bits the intersection."""
    lt, rt = left.canonical(), right.canonical()
    lb, rb = lt.relations.first().bits, rt.relations.first().bits
    limits.check_arity(len(set(lb) | set(rb)))
    spark = left.relations.sparkSession
    both = sorted(set(lb) | set(rb))
    pair = spark.createDataFrame([(0, 1, [b for b in lb if b in set(rb)], list(lb), list(rb), both)], "l_table_id long, r_table_id long, shared array<long>, l_bits array<long>, r_bits array<long>, union array<long>")
    two = System(pair.select("l_table_id"), lt.rows.select(F.lit(0).cast("long").alias("table_id"), "row").union(rt.rows.select(F.lit(1).cast("long"), "row")))
    rows = join_pairs(pair, two).select(F.lit(0).cast("long").alias("table_id"), "row").distinct()
    return System(spark.createDataFrame([(0, both)], "table_id long, bits array<long>"), rows)


def join_all(system: System, order: DataFrame | None = None) -> System:
    """The natural join of every table, smallest first (or in the given order), but always one that
    shares a bit with what is joined so far while there is one; after an empty step the rest is not
    joined: no rows over all bits. Rows are dealt out by table once, so each step reads its own table only."""
    rest = [(r.table_id, list(r.bits)) for r in (order or system.sized.orderBy("row_count", "arity", "bits", "table_id")).select("table_id", "bits").collect()]
    if not rest:
        raise ValueError("no relations to join")
    union = sorted({b for _, bits in rest for b in bits})
    limits.check_arity(len(union))
    spark = system.relations.sparkSession
    path = scratch(spark, "by-table")
    system.rows.repartition("table_id").write.partitionBy("table_id").parquet(path)

    def own(i: int, bits: list[int]) -> DataFrame:
        """A table's rows over its ascending bits."""
        return stored(spark, f"{path}/table_id={i}", "row long").select(project_to(F.col("row"), [bits.index(b) for b in sorted(bits)]).alias("row")).distinct()

    first, bits = rest.pop(0)
    rows, bits = own(first, bits), sorted(bits)
    while rest:
        if rows.isEmpty():
            rows, bits = rows.limit(0), union
            break
        i, new = rest.pop(next((k for k, (_, x) in enumerate(rest) if set(x) & set(bits)), 0))
        right, new = own(i, new), sorted(new)
        shared, both = [b for b in new if b in set(bits)], sorted({*bits, *new})
        key = lambda x: [x.index(b) for b in shared]
        l = rows.select(project_to(F.col("row"), key(bits)).alias("key"), scatter_to(F.col("row"), [both.index(b) for b in bits]).alias("l"))
        r = right.select(project_to(F.col("row"), key(new)).alias("key"), scatter_to(F.col("row"), [both.index(b) for b in new]).alias("r"))
        # a table without bits of its own only filters
        joined = l.join(r, "key", "left_semi").select(F.col("l").alias("row")) if both == bits else l.join(r, "key").select(F.col("l").bitwiseOR(F.col("r")).alias("row"))
        rows, bits = cut(joined, "joined"), both
    zero = F.lit(0).cast("long").alias("table_id")
    return System(spark.createDataFrame([(0, bits)], "table_id long, bits array<long>"), rows.select(zero, "row"))


def semijoin_into(system: System, pairs: DataFrame) -> DataFrame:
    """rows of each table `sup_id` of pairs(sub_id, sup_id, at) whose projection is a row of `sub_id` for every pair; relations in no pair are absent."""
    subs = system.rows.select(F.col("table_id").alias("sub_id"), F.col("row").alias("key"))
    need = pairs.groupBy("sup_id").agg(F.count(F.lit(1)).alias("need"))
    rows = system.rows.withColumnRenamed("table_id", "sup_id").join(pairs, "sup_id").select("sup_id", "row", "sub_id", project(F.col("row"), F.col("at")).alias("key"))
    met = rows.join(subs, ["sub_id", "key"], "left_semi").groupBy("sup_id", "row").agg(F.count(F.lit(1)).alias("met"))
    return met.join(need, "sup_id").where("met = need").select(F.col("sup_id").alias("table_id"), "row")


def containments(system: System) -> DataFrame:
    """sub_id, sup_id, at: strict subset schemas, found over the subset's rarest bit only."""
    common = system.schema.groupBy("bit").agg(F.count(F.lit(1)).alias("n"))
    anchors = system.schema.join(common, "bit").groupBy("table_id").agg(F.min(F.struct("n", "bit"))["bit"].alias("bit")).join(system.relations, "table_id").select(F.col("table_id").alias("sub_id"), F.col("bits").alias("sub_bits"), "bit")
    sups = system.schema.join(system.relations, "table_id").select(F.col("table_id").alias("sup_id"), F.col("bits").alias("sup_bits"), "bit")
    inside = anchors.join(sups, "bit").where((F.size("sub_bits") < F.size("sup_bits")) & contains_all(F.col("sup_bits"), F.col("sub_bits")))
    return inside.select("sub_id", "sup_id", positions_of(F.col("sub_bits"), F.col("sup_bits")).alias("at"))


def pairwise_merge(system: System, cap: int = 16, changed: DataFrame | None = None, keep_sources: bool = False) -> tuple[System, dict[str, int]]:
    """Every pair with two shared bits and a union of at most cap bits is joined; joins with rows
    that are no tautology enter, equal schemas intersect, and their sources leave (unless kept).
    changed: ids of relations of which one must be in a pair (semi-naive rounds)."""
    pairs = shared_pairs(system, 2)
    if changed is not None:
        ids = changed.select("table_id").distinct()
        hit = pairs.join(ids.toDF("l_table_id"), "l_table_id", "left_semi").unionByName(pairs.join(ids.toDF("r_table_id"), "r_table_id", "left_semi")).distinct()
        pairs = hit
    pairs = cut(pairs, "pairs")
    fits = pairs.where(F.size("union") <= cap)
    rows = cut(join_pairs(fits, system).distinct(), "pair-rows")  # the one large join is worked out once
    sized = fits.select("l_table_id", "r_table_id", "union").join(rows.groupBy("l_table_id", "r_table_id").agg(F.count(F.lit(1)).alias("n")), ["l_table_id", "r_table_id"], "left")
    sized = cut(sized, "pair-sizes")
    good = sized.where((F.coalesce("n", F.lit(0)) > 0) & ~is_full(F.coalesce("n", F.lit(0).cast("long")), F.size("union")))
    numbered = good.withColumn("table_id", F.xxhash64("l_table_id", "r_table_id").bitwiseOR(F.lit(-(2**62)).cast("long")))  # negative: apart from ids in use
    merged = System(numbered.select("table_id", F.col("union").alias("bits")), rows.join(numbered, ["l_table_id", "r_table_id"]).select("table_id", "row"))
    used = good.select(F.explode(F.array("l_table_id", "r_table_id")).alias("table_id")).distinct()
    rest = system if keep_sources else system.except_(used)
    out = System(rest.relations.unionByName(merged.relations), rest.rows.unionByName(merged.rows)).canonical().saved()
    if keep_sources:
        out.must_hold("pairwise merge")
    c = sized.agg(F.count(F.lit(1)).alias("candidates"), F.coalesce(F.sum(F.isnull("n").cast("long")), F.lit(0)).alias("empty")).first()
    return out, {"pairs": pairs.count(), "candidates": c.candidates, "empty": c.empty, "merged": good.count(), "dropped_sources": 0 if keep_sources else used.count()}


def compatible_rows(system: System, least: int = 1) -> DataFrame:
    """l_table_id, r_table_id, key, l_rows, r_rows: for each pair and shared assignment the row masks of both sides."""
    pairs = shared_pairs(system, least)
    sides = []
    for s in "lr":
        named = pairs.select("l_table_id", "r_table_id", positions_of(F.col("shared"), F.col(f"{s}_bits")).alias("at"))
        rows = system.rows.select(F.col("table_id").alias(f"{s}_table_id"), "row")
        sides.append(named.join(rows, f"{s}_table_id").groupBy("l_table_id", "r_table_id", project(F.col("row"), F.col("at")).alias("key")).agg(F.array_sort(F.collect_list("row")).alias(f"{s}_rows")))
    return sides[0].join(sides[1], ["l_table_id", "r_table_id", "key"])
