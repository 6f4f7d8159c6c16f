"""Splitting relations into smaller ones that join back exactly, and checking that they do."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskspark.functions.kernel import latent_split, loose_parts
from maskspark.functions.mask import bit_at, is_full, positions_of, project, project_each, put
from maskspark.operators.joins import join_all, join_pairs
from maskspark.storage import beside, cut, numbered
from maskspark.system import System

_PAIRS = "table_id long, row_count long, left long, right long, left_rows long, right_rows long"


def _loose_positions(packed: DataFrame) -> DataFrame:
    """table_id, row_count, arity, shared, parts: for each set of positions (a mask) of small
    relations (rows in one value), the other positions in parts (masks) that no dependent two positions connect, where
    there are two parts or more. Two positions depend on each other, once the shared ones are known, if some
    assignment of the shared positions occurs with a set of values of the two that is no product of two sets.
    Relations of one arity are cubes of booleans, worked on together, as many as fit a bounded array."""

    def run(batches):
        for pdf in batches:
            for arity, same in pdf.groupby(pdf["bits"].map(len)):
                step = max(1, (1 << 20) >> int(arity))
                for at in range(0, len(same), step):
                    some = same.iloc[at : at + step]
                    cubes = np.zeros((len(some), 1 << arity), bool)
                    for i, rows in enumerate(some["rows"]):
                        cubes[i, np.asarray(rows, np.int64)] = True
                    ids, counts = some["table_id"].to_numpy(), some["rows"].map(len).to_numpy()
                    for shared, parts in loose_parts(cubes, int(arity)):
                        keep = [i for i, p in enumerate(parts) if len(p) > 1]
                        if keep:
                            yield pd.DataFrame({"table_id": ids[keep], "row_count": counts[keep], "arity": arity, "shared": shared, "parts": [parts[i] for i in keep]})

    return packed.select("table_id", "bits", "rows").mapInPandas(run, "table_id long, row_count long, arity int, shared long, parts array<long>")


def projection_splits(system: System, least: int = 3, most: int = 15) -> DataFrame:
    """table_id, row_count, left, right (position masks), left_rows, right_rows: for each relation of
    least..most bits with rows, the best pair of smaller projections that join back to it exactly,
    where there is one: least largest arity, then fewest rows, least total arity, most shared bits,
    first masks. A relation never has more rows than such a join, so a pair is lossless just if the
    join is as large; its size follows from the counts of both projections by shared assignment.
    Largest arities are tried from half the bits upwards, and only relations without a split go on.
    A split also splits each two bits of different sides, so its sides are unions of what dependent
    bits connect; only such pairs are counted, of which a relation of k bits without dependent bits has up to 3^k."""
    spark = system.relations.sparkSession
    packed = system.packed().where(F.size("bits").between(least, most) & (F.size("rows") > 0))
    loose = cut(_loose_positions(packed), "loose")
    arities = sorted(r.arity for r in loose.select("arity").distinct().collect())
    if not arities:
        return spark.createDataFrame([], _PAIRS)
    choice = F.explode(F.sequence(F.lit(1), put(F.lit(1), F.size("parts") - 1).cast("int") - 1)).alias("choice")  # the last part is on the other side
    one = F.aggregate(F.transform("parts", lambda p, i: p * bit_at(F.col("choice").cast("long"), i)), F.col("shared"), lambda x, y: x.bitwiseOR(y))
    other = F.aggregate(F.transform("parts", lambda p, i: p * (1 - bit_at(F.col("choice").cast("long"), i))), F.col("shared"), lambda x, y: x.bitwiseOR(y))
    found = []
    for largest in range((arities[0] + 1) // 2, arities[-1]):
        fits = loose.where(((F.col("arity") + 1) / 2 <= largest + 0.5) & (F.col("arity") > largest))
        both = fits.select("table_id", "row_count", "shared", "parts", choice).select("table_id", "row_count", one.alias("one"), other.alias("other"))
        pairs = both.where(F.greatest(F.bit_count("one"), F.bit_count("other")) == largest).select("table_id", "row_count", F.least("one", "other").alias("left"), F.greatest("one", "other").alias("right"))
        each = pairs.join(system.rows.hint("merge"), "table_id")
        parts = [F.col("row").bitwiseAND(F.col(c)) for c in ("left", "right")]
        counts = each.groupBy("table_id", "row_count", "left", "right", parts[0].bitwiseAND(F.col("right")).alias("key")).agg(*(F.size(F.collect_set(p)).cast("long").alias(n) for p, n in zip(parts, "lr", strict=True)))
        sizes = counts.groupBy("table_id", "row_count", "left", "right").agg(F.sum(F.col("l") * F.col("r")).alias("join_rows"), F.sum("l").alias("left_rows"), F.sum("r").alias("right_rows"))
        score = F.struct(
            (F.col("left_rows") + F.col("right_rows")).alias("rows"),
            (F.bit_count("left") + F.bit_count("right")).alias("arity"),
            (-F.bit_count(F.col("left").bitwiseAND(F.col("right")))).alias("shared"),
            "left", "right", "left_rows", "right_rows",
        )
        best = sizes.where("join_rows = row_count").groupBy("table_id", "row_count").agg(F.min(score).alias("x"))
        best = cut(best.select("table_id", "row_count", *(f"x.{c}" for c in ("left", "right", "left_rows", "right_rows"))), "splits")
        found.append(best)
        loose = loose.join(beside(best.select("table_id")), "table_id", "left_anti")
    return reduce(DataFrame.unionByName, found)


def named_by(mask: Column, bits: Column | str) -> Column:
    """Those of bits whose position is in the mask."""
    return F.filter(bits, lambda _, i: bit_at(mask, i) == 1)


def projection_factors(system: System, found: DataFrame) -> System:
    """Both factors of each split that projection_splits() found: of relation t, 2t is the left one and 2t + 1 the right one."""
    sides = F.explode(F.array(*(F.struct((F.col("table_id") * 2 + i).alias("factor"), F.col(c).alias("mask")) for i, c in enumerate(("left", "right")))))
    parts = found.select("table_id", sides.alias("x")).join(system.relations, "table_id").select("table_id", "x.factor", "bits", named_by(F.col("x.mask"), "bits").alias("own"))
    rows = parts.select("table_id", "factor", positions_of(F.col("own"), F.col("bits")).alias("at")).join(system.rows, "table_id").select(F.col("factor").alias("table_id"), project(F.col("row"), F.col("at")).alias("row")).distinct()
    return System(parts.select(F.col("factor").alias("table_id"), F.col("own").alias("bits")), rows)


def lost_or_added(system: System, factors: System) -> DataFrame:
    """table_id, row: rows by which the factors' joins differ from the relations that they were made of; none if they are exact."""
    own = factors.relations.select(F.expr("table_id div 2").alias("table_id"), (F.col("table_id") % 2).alias("side"), "bits")
    pair = own.where("side = 0").select("table_id", F.col("bits").alias("l_bits")).join(own.where("side = 1").select("table_id", F.col("bits").alias("r_bits")), "table_id").join(system.relations, "table_id")
    pairs = pair.select((F.col("table_id") * 2).alias("l_table_id"), (F.col("table_id") * 2 + 1).alias("r_table_id"), F.array_intersect("l_bits", "r_bits").alias("shared"), "l_bits", "r_bits", F.col("bits").alias("union"))
    joined = join_pairs(pairs, factors).select(F.expr("l_table_id div 2").alias("table_id"), "row").distinct()
    rows = system.rows.join(pair, "table_id", "left_semi")
    return joined.subtract(rows).unionByName(rows.subtract(joined))


_LATENT = "table_id long, left_bits array<long>, right_bits array<long>, latent_bits int, left_rows array<long>, right_rows array<long>"


def latent_splits(system: System, least: int = 4, most: int = 15) -> DataFrame:
    """table_id, left_bits, right_bits, latent_bits, left_rows, right_rows of each relation that two sides
    joined by few new bits express in less arity: rows of a side are its own bits and, above them, the
    number of a biclique of values that go together. The search is within one small relation; each is one row of its task."""

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                bits, rows = list(map(int, r.bits)), np.asarray(r.rows, np.int64)
                if hidden := latent_split(bits, rows):
                    left, right, cover = hidden
                    width = max(0, (len(cover) - 1).bit_length())
                    sides = [sorted({pair[k] | state << len(own) for state, pairs in enumerate(cover) for pair in pairs}) for k, own in enumerate((left, right))]
                    out.append((r.table_id, left, right, width, *sides))
            yield pd.DataFrame(out, columns=["table_id", "left_bits", "right_bits", "latent_bits", "left_rows", "right_rows"])

    packed = system.packed().where(F.size("bits").between(least, most) & (F.size("rows") > 0))
    return packed.select("table_id", "bits", "rows").mapInPandas(run, _LATENT)


def latent_factors(system: System, found: DataFrame) -> System:
    """Both factors of each latent split: of relation t, 2t is the left one and 2t + 1 the right one. The
    new bits follow the system's largest; each split has its own."""
    top = system.schema.agg(F.coalesce(F.max("bit"), F.lit(-1))).first()[0] + 1
    starts = numbered(found.select("table_id", F.explode(F.sequence(F.lit(1), F.greatest("latent_bits", F.lit(1)))).alias("k")), "table_id", "k")
    first = starts.groupBy("table_id").agg((F.min("number") + top).alias("start"))
    new = F.when(F.col("latent_bits") > 0, F.transform(F.sequence(F.lit(0), F.col("latent_bits") - 1), lambda i: F.col("start") + i)).otherwise(F.array().cast("array<long>"))
    sides = F.explode(F.array(*(F.struct((F.col("table_id") * 2 + i).alias("table_id"), F.concat(f"{c}_bits", new).alias("bits"), F.col(f"{c}_rows").alias("rows")) for i, c in enumerate(("left", "right")))))
    parts = cut(found.join(first, "table_id").select(sides.alias("x")).select("x.*"), "latent")
    return System.unpacked(parts)


def _rest(system: System, found: DataFrame) -> System:
    """The relations that are not in found, of which there may be as many as relations."""
    gone = beside(found.select("table_id"))
    return System(system.relations.join(gone, "table_id", "left_anti"), system.rows.join(gone, "table_id", "left_anti"))


def _shapes(system: System, least: int, most: int) -> tuple[DataFrame, System]:
    """table_id, bits, arity, shape of each relation of least..most bits with rows; and the shapes, over positions
    instead of bits: relations of one arity with the same rows have one, which has the least of their ids."""
    packed = cut(system.packed().where(F.size("bits").between(least, most) & (F.size("rows") > 0)).select("table_id", "bits", F.size("bits").alias("arity"), "rows"), "packed")
    shapes = cut(packed.groupBy("arity", "rows").agg(F.min("table_id").alias("shape")), "shapes")
    of = cut(packed.join(beside(shapes), ["arity", "rows"]).select("table_id", "bits", "arity", "shape"), "of")
    bits = F.sequence(F.lit(0).cast("long"), F.col("arity").cast("long") - 1)
    return of, System.unpacked(shapes.select(F.col("shape").alias("table_id"), bits.alias("bits"), "rows")).saved()


def splits(system: System, least: int = 3, most: int = 15, canonical: bool = True) -> DataFrame:
    """The split of each relation of least..most bits: a lossless projection, else one by latent bits,
    else `none`. Relations of one arity with the same rows split alike, and are worked on once. Projections are
    found for all of them at once; of the rest, each is one row of its task."""
    system = (system.canonical() if canonical else system).saved()
    of, shapes = _shapes(system, least, most)
    found = cut(projection_splits(shapes, least, most), "splits")
    hidden = cut(latent_splits(_rest(shapes, found), least, most), "latent")
    projected = found.select(F.col("table_id").alias("shape"), "left", "right")
    latent = hidden.select(F.col("table_id").alias("shape"), "left_bits", "right_bits", "latent_bits")
    each = of.join(beside(projected), "shape", "left").join(beside(latent), "shape", "left")
    named = lambda mask, at: F.when(mask.isNotNull(), named_by(mask, "bits")).otherwise(F.coalesce(F.transform(at, lambda p: F.element_at("bits", p.cast("int") + 1)), F.array().cast("array<long>")))
    kind = F.when(F.col("left").isNotNull(), "projection").when(F.col("latent_bits").isNotNull(), "latent").otherwise("none")
    new = F.coalesce("latent_bits", F.lit(0))
    sides = each.select("table_id", "arity", kind.alias("kind"), named(F.col("left"), F.col("left_bits")).alias("left_bits"), named(F.col("right"), F.col("right_bits")).alias("right_bits"), new.alias("latent_bits"))
    wide = F.when(F.col("kind") == "none", F.col("arity")).otherwise(F.greatest(F.size("left_bits"), F.size("right_bits")) + F.col("latent_bits"))
    return sides.select("table_id", "kind", "left_bits", "right_bits", "latent_bits", wide.alias("max_arity"))


def split_coverage(system: System, least: int = 3, most: int = 15) -> DataFrame:
    """kind, arity, relations, rows_before, rows_after: how many relations split in which way, and the
    rows that their factors need; `skipped` are relations outside least..most bits or without rows."""
    system = system.canonical().saved()
    found = cut(projection_splits(system, least, most), "splits")
    hidden = cut(latent_splits(_rest(system, found), least, most), "latent")
    after = found.select("table_id", F.lit("projection").alias("kind"), (F.col("left_rows") + F.col("right_rows")).alias("rows_after"))
    after = after.unionByName(hidden.select("table_id", F.lit("latent").alias("kind"), (F.size("left_rows") + F.size("right_rows")).cast("long").alias("rows_after")))
    tried = F.col("arity").between(least, most) & (F.col("row_count") > 0)
    each = system.sized.join(after.hint("merge"), "table_id", "left").select(F.coalesce("kind", F.when(tried, "none").otherwise("skipped")).alias("kind"), "arity", "row_count", F.coalesce("rows_after", "row_count").alias("rows_after"))
    return each.groupBy("kind", "arity").agg(F.count(F.lit(1)).alias("relations"), F.sum("row_count").alias("rows_before"), F.sum("rows_after").alias("rows_after"))


def subtables(system: System, k: int) -> System:
    """Every projection of every table to k of its bits; equal ones of one table once."""
    cell = system.relations.select("table_id", "bits", F.explode("bits").alias("bit")).select("table_id", "bits", F.array("bit").alias("chosen"))
    for _ in range(k - 1):
        nxt = F.explode(F.filter("bits", lambda b: b > F.element_at("chosen", -1)))
        cell = cell.select("table_id", "bits", "chosen", nxt.alias("bit")).select("table_id", "bits", F.array_append("chosen", F.col("bit")).alias("chosen"))
    named = cell.select(F.xxhash64("table_id", "chosen").alias("new"), "table_id", "chosen", positions_of(F.col("chosen"), F.col("bits")).alias("at"))
    rows = system.rows.join(beside(named, named), "table_id").select(F.col("new").alias("table_id"), project(F.col("row"), F.col("at")).alias("row")).distinct()
    return System(named.select(F.col("new").alias("table_id"), F.col("chosen").alias("bits")), rows)


def non_tautologies(system: System) -> System:
    return system.except_(system.sized.where(is_full(F.col("row_count"), F.col("arity"))))


def reconstruct(factors: System) -> System | None:
    """The join of all factors, the widest first; None without factors."""
    if factors.relations.isEmpty():
        return None
    return join_all(factors, factors.sized.orderBy(F.desc("arity"), "row_count", "bits", "table_id"))


def difference(source: System, other: System | None) -> dict[str, object]:
    """How a reconstruction differs from its one-table source: bits it lacks, rows it adds or lacks (over the common bits)."""
    want = source.canonical()
    bits = set(want.relations.first().bits)
    if other is None:
        return {"missing_bits": sorted(bits), "extra_rows": None, "missing_rows": None, "exact": False}
    got = other.canonical()
    have = set(got.relations.first().bits)
    spark = source.relations.sparkSession
    common = spark.createDataFrame([(b,) for b in sorted(bits & have)], "bit long")
    a, b = want.keep_bits(common).rows.select("row"), got.keep_bits(common).rows.select("row")
    extra, missing = b.subtract(a).count(), a.subtract(b).count()
    return {"missing_bits": sorted(bits - have), "extra_rows": extra, "missing_rows": missing, "exact": not (bits - have) and not extra and not missing}


def progressive_roundtrip(source: System, most: int = 4) -> list[dict[str, object]]:
    """Pools of 2-bit, then also 3-bit, ... informative projections, until one joins back exactly."""
    source = source.canonical().saved()
    pool, out = None, []
    for k in range(2, most + 1):
        new = non_tautologies(subtables(source, k)).saved()
        pool = new if pool is None else System(pool.relations.unionByName(new.relations), pool.rows.unionByName(new.rows))
        found = difference(source, reconstruct(pool.canonical().saved()))
        out.append({"sizes": list(range(2, k + 1)), "factors": pool.relations.count(), **found})
        if found["exact"]:
            break
    return out


def selective_roundtrip(source: System, most: int = 4) -> System | None:
    """A small pool that joins back exactly: projections are added greedily, each the one that
    rejects most of the rows still too many (or brings most missing bits), smaller ones first."""
    return selective_report(source, most)[0]


@dataclass
class Selection:
    """How a pool was selected: informative projections by size, and each choice made."""

    pool: dict[int, int]
    #: bits, missing_bits and extra_rows before the choice, candidates that would help, and the gain of the one taken.
    choices: list[dict[str, object]]


def selective_report(source: System, most: int = 4) -> tuple[System | None, Selection]:
    """selective_roundtrip() with its statistics."""
    source = source.canonical().saved()
    spark = source.relations.sparkSession
    bits = list(source.relations.first().bits)
    if source.sized.where(is_full(F.col("row_count"), F.col("arity"))).count():
        return None, Selection({}, [])
    pools = [non_tautologies(subtables(source, k)) for k in range(2, min(most, len(bits)) + 1)]
    pool = System(_union([p.relations for p in pools]), _union([p.rows for p in pools])).canonical().saved()
    report = Selection({r.arity: r["count"] for r in pool.sized.groupBy("arity").count().orderBy("arity").collect()}, [])
    chosen: list[int] = []
    while True:
        held = reconstruct(pool.only(spark.createDataFrame([(c,) for c in chosen], "table_id long"))) if chosen else None
        gap = difference(source, held)
        if gap["exact"]:
            return pool.only(spark.createDataFrame([(c,) for c in chosen], "table_id long")), report
        missing = gap["missing_bits"]
        rest = pool.except_(spark.createDataFrame([(c,) for c in chosen], "table_id long"))
        if missing:
            gain = rest.schema.where(F.col("bit").isin(missing)).groupBy("table_id").agg(F.count(F.lit(1)).alias("gain"))
        else:
            extra = held.rows.select("row").subtract(source.rows.select("row"))
            place = {b: i for i, b in enumerate(held.relations.first().bits)}
            targets = [(t.table_id, [place[b] for b in t.bits]) for t in rest.relations.collect()]  # projections of one table
            seen = extra.select(F.explode(project_each(F.col("row"), targets)).alias("x")).select("x.*")
            gain = seen.join(rest.rows, ["table_id", "row"], "left_anti").groupBy("table_id").agg(F.count(F.lit(1)).alias("gain"))
        gain = cut(gain, "gain")
        best = gain.join(rest.sized, "table_id").orderBy(F.desc("gain"), "arity", "row_count", "bits").limit(1).collect()
        if not best:
            return None, report
        report.choices.append({"bits": list(best[0].bits), "missing_bits": len(missing), "extra_rows": gap["extra_rows"], "candidates": gain.count(), "gain": best[0].gain})
        chosen.append(best[0].table_id)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def verify_projection(source: System, projected: System) -> dict[str, object]:
    """Whether a one-table system is the source's exact projection: rows missing and extra, and whether it says anything."""
    bits = projected.relations.select(F.explode("bits").alias("bit"))
    want, have = source.canonical().keep_bits(bits).rows.select("row"), projected.canonical().rows.select("row")
    missing, extra = want.subtract(have).count(), have.subtract(want).count()
    return {"missing_rows": missing, "extra_rows": extra, "exact": not missing and not extra, "tautology": not projected.tautologies().isEmpty()}
