"""Iterated merges and eliminations over whole systems."""

from __future__ import annotations

from pyspark.sql import Row
from pyspark.sql import functions as F

from maskspark.functions.mask import project_each
from maskspark.operators import joins
from maskspark.operators import reductions as r
from maskspark.operators.decomposition import progressive_roundtrip, selective_roundtrip
from maskspark.operators.ranking import CandidateQueue, best_partner, min_related_bit, next_central_bit
from maskspark.storage import cut
from maskspark.system import System


def _incident(system: System, bit: int):
    return system.schema.where(F.col("bit") == bit).select("table_id").distinct()


def _with(system: System, new: System) -> System:
    """system and one new table, under an id in use nowhere."""
    top = system.relations.agg(F.coalesce(F.max("table_id"), F.lit(0))).first()[0] + 1
    return System(system.relations.unionByName(new.relations.select(F.lit(top).cast("long").alias("table_id"), "bits")), system.rows.unionByName(new.rows.select(F.lit(top).cast("long").alias("table_id"), "row")))


def merge_incident(system: System, bit: int) -> System:
    """The join of all relations that hold the bit: one table."""
    return joins.join_all(system.only(_incident(system, bit)))


def eliminate_bit(system: System, bit: int) -> System:
    """Exact elimination: the incident relations' join without the bit replaces them, and absorbs the relations over its subsets."""
    system = system.canonical().saved()
    ids = _incident(system, bit)
    joined = merge_incident(system, bit)
    bits = set(joined.relations.first().bits)
    spark = system.relations.sparkSession
    rest = F.array(*(F.lit(b).cast("long") for b in sorted(bits - {bit})))
    small = cut(system.relations.where((F.size(F.array_except("bits", rest)) == 0) & (F.size("bits") < len(bits) - 1)).select("table_id"), "inside")
    extra = system.only(small)
    new = joined.keep_bits(spark.createDataFrame([(bit,)], "bit long"), keep=False)
    if not small.isEmpty():
        both = _with(System(extra.relations, extra.rows), new)
        new = r.subset_absorption(both)[0]
        new = new.only(new.sized.orderBy(F.desc("arity")).limit(1))
    rest = system.except_(ids).except_(small)
    return _with(rest, new.canonical()).canonical().saved().must_hold("bit elimination")


def eliminate_bit_by_cluster(system: System, bit: int) -> System:
    """Each incident table keeps the rows that the incident join supports, then loses the bit; the relations stay apart (their join may allow more)."""
    system = system.canonical().saved()
    ids = _incident(system, bit)
    joined = merge_incident(system, bit).must_hold("cluster")
    members = system.only(ids)
    place = {b: i for i, b in enumerate(joined.relations.first().bits)}
    targets = [(t.table_id, [place[b] for b in t.bits]) for t in members.relations.collect()]  # the relations of one bit
    supported = joined.rows.select(F.explode(project_each(F.col("row"), targets)).alias("x")).select("x.*").distinct()
    spark = system.relations.sparkSession
    cut_ = System(members.relations, supported).keep_bits(spark.createDataFrame([(bit,)], "bit long"), keep=False)
    rest = system.except_(ids)
    return System(rest.relations.unionByName(cut_.relations), rest.rows.unionByName(cut_.rows)).canonical().saved().must_hold("cluster elimination")


def elimination_cycles(system: System, cycles: int = 1000, cap: int = 32, fewest: bool = True, protected: set[int] = frozenset()) -> tuple[System, list[int]]:
    """Bits eliminated one by one in central order; also the order."""
    done: list[int] = []
    for _ in range(cycles):
        bit = next_central_bit(system, {*done, *protected}, cap, fewest)
        if bit is None:
            break
        system = eliminate_bit(system, bit)
        done.append(bit)
    return system, done


def merge_min_related(system: System) -> System:
    """The incident relations of the least related bit, replaced by their join."""
    bit = min_related_bit(system)
    if bit is None:
        return system
    joined = merge_incident(system, bit)
    return _with(system.except_(_incident(system, bit)), joined).canonical().saved()


def _ids(system: System, *ids: int):
    return system.relations.sparkSession.createDataFrame([(i,) for i in ids], "table_id long")


def greedy_rank_chain(system: System, target: int = 16, most: int | None = None) -> tuple[System, list[Row]]:
    """The pair of least rank is merged, again and again, until a merge has exactly `target` bits or no
    pair overlaps; also each step's pair, new relation and what is left. Relations are numbered in canonical order, new ones after them."""
    queue, log = CandidateQueue(system), []
    while (most is None or len(log) < most) and (best := queue.pop()):
        new, rows = queue.merge(best)
        log.append(Row(step=len(log) + 1, left=best.l_table_id, right=best.r_table_id, new=new, shared_bits=len(best.shared), union_arity=best.union_arity, row_count=rows, relations=queue.left))
        if best.union_arity == target:
            break
    return queue.system.saved(), log


def greedy_rank_cycles(system: System, target: int = 16, most: int = 100) -> tuple[System, int]:
    """Greedy merges that skip empty joins and unions beyond target, each stage followed by the reduction steps; until both change nothing."""
    system = system.canonical().saved()
    for done in range(most):
        before = system.fingerprint()
        queue = CandidateQueue(system)
        while best := queue.pop((F.col("join_rows") > 0) & (F.col("union_arity") <= target)):
            queue.merge(best)
        system = queue.system.canonical().saved()
        while True:
            start = system.counts()
            system = r.subset_absorption(system)[0]
            system = r.force_step(system)[0]
            while (step := r.rewrite_step(system))[3]["replaced_bits"]:
                system = step[0]
            system = r.node_filter(system)[0].saved()
            if system.counts() == start:
                break
        if system.fingerprint() == before:
            return system, done
    return system, most


def rank_chain(system: System, most: int = 24) -> list[System]:
    """From the table of least rank, the best partner joined at each step while the union fits: the relations along the way."""
    system = system.canonical().saved()
    base = system.sized.where("arity > 0")
    if base.isEmpty():
        return []
    from maskspark.operators.metrics import table_ranks

    first = table_ranks(system).where("arity > 0").orderBy("rank", "row_count", "arity", "table_id").first()
    current, out = first.table_id, []
    while True:
        partner = best_partner(system, current).where(F.col("union_arity") <= most).limit(1).collect()
        if not partner:
            return out
        one = joins.join_two(system.only(_ids(system, current)), system.only(_ids(system, partner[0].table_id)))
        system = _with(system.except_(_ids(system, current, partner[0].table_id)), one).saved()
        current = system.relations.agg(F.max("table_id")).first()[0]
        out.append(system.only(_ids(system, current)))


def incident_decompositions(system: System, least: int = 16, most: int = 18, limit: int = 40) -> list[dict]:
    """For the first bits whose incident join has least..most bits: the join, and whether small projections join back to it."""
    from maskspark.operators.metrics import incident_union_arity

    system = system.canonical().saved()
    bits = incident_union_arity(system).where(F.col("union_arity").between(least, most)).orderBy("bit").limit(limit).collect()
    out = []
    for b in bits:
        joined = merge_incident(system, b.bit).saved()
        found = selective_roundtrip(joined)
        out.append({"bit": b.bit, "relations": b.relations, "arity": b.union_arity, "rows": joined.rows.count(), "roundtrip": progressive_roundtrip(joined, 3)[-1]["exact"], "selected": None if found is None else found.relations.count()})
    return out
