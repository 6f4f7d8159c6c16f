"""Systems whose rows are wider than one mask: bit i is bit i % 64 of word i // 64 of an array of words.

relations(table_id, bits) and rows(table_id, words): each row has as many 64-bit words (two's
complement) as its bits need, one at least; unused high bits are 0.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskspark.functions.mask import bit_at, is_full, positions_of, put
from maskspark.sources import container
from maskspark.storage import beside, cut
from maskspark.system import System

WORD = 64
RELATIONS = "table_id long, bits array<long>"
ROWS = "table_id long, words array<long>"


def word_count(arity: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(arity / WORD)).cast("int")


def bit_of(words: Column, position: Column) -> Column:
    """0 or 1: the row's bit at a position."""
    return bit_at(F.element_at(words, F.floor(position / WORD).cast("int") + 1), position % WORD)


def project(words: Column, positions: Column) -> Column:
    """The row over the bits at the given positions, in their order."""
    one = lambda w: F.aggregate(
        F.transform(F.slice(positions, w * WORD + 1, WORD), lambda p, i: put(bit_of(words, p), i)), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)
    )
    return F.transform(F.sequence(F.lit(0), word_count(F.size(positions)) - 1), one)


def fitted(words: Column, arity: Column) -> Column:
    """words, cut or filled with zeros to what the arity needs; an error where a bit beyond it is set."""
    n = word_count(arity)
    full = F.slice(F.concat(words, F.array_repeat(F.lit(0).cast("long"), n)), F.lit(1), n)
    last = arity - (n - 1) * WORD  # bits of the last word, 0 .. 64
    high = F.when(last >= WORD, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", F.element_at(full, n), F.least(last, F.lit(WORD - 1)).cast("int")))
    beyond = F.exists(F.slice(words, n + 1, F.greatest(F.size(words) - n, F.lit(0))), lambda x: x != 0)
    return F.when((high == 0) & ~beyond, full).otherwise(F.raise_error(F.lit("a row has a bit beyond its table's arity")).cast("array<long>"))


def packed(bits: list[Column]) -> Column:
    """The row with these values (booleans) as its bits; null is false."""
    words = []
    for a in range(0, max(1, len(bits)), WORD):
        word = F.lit(0).cast("long")
        for i, b in enumerate(bits[a : a + WORD]):
            word = word.bitwiseOR(F.when(b, F.lit(1 << i if i < WORD - 1 else -(1 << i))).otherwise(F.lit(0)).cast("long"))
        words.append(word)
    return F.array(*words)


@dataclass(frozen=True)
class WideSystem:
    relations: DataFrame
    rows: DataFrame

    @staticmethod
    def of(spark: SparkSession, relations: list[tuple[list[int], list[int]]]) -> WideSystem:
        """From (bits, rows) with rows as integers."""
        signed = lambda x: x - (1 << WORD) if x >> (WORD - 1) else x
        split = lambda row, n: [signed(row >> (WORD * k) & ((1 << WORD) - 1)) for k in range(max(1, -(-n // WORD)))]
        return WideSystem(
            spark.createDataFrame([(i, list(b)) for i, (b, _) in enumerate(relations)], RELATIONS),
            spark.createDataFrame([(i, split(r, len(b))) for i, (b, rows) in enumerate(relations) for r in rows], ROWS),
        )

    @staticmethod
    def widened(system: System) -> WideSystem:
        return WideSystem(system.relations, system.rows.select("table_id", F.array("row").alias("words")))

    def local(self) -> list[tuple[list[int], list[int]]]:
        """(bits, rows) with rows as integers, in canonical order; for small systems and tests."""
        held = {r.table_id: (list(r.bits), []) for r in self.relations.collect()}
        for r in self.rows.collect():
            held[r.table_id][1].append(sum((w & ((1 << WORD) - 1)) << (WORD * k) for k, w in enumerate(r.words)))
        return sorted(((b, sorted(rows)) for b, rows in held.values()), key=lambda t: (len(t[0]), t[0], t[1]))

    @cached_property
    def sized(self) -> DataFrame:
        """table_id, bits, arity, row_count (distinct rows)."""
        n = self.rows.distinct().groupBy("table_id").agg(F.count(F.lit(1)).alias("row_count"))
        return self.relations.join(n.hint("merge"), "table_id", "left").select("table_id", "bits", F.size("bits").alias("arity"), F.coalesce("row_count", F.lit(0).cast("long")).alias("row_count"))

    def saved(self) -> WideSystem:
        return WideSystem(cut(self.relations, "wide-relations"), cut(self.rows, "wide-rows"))

    def canonical(self) -> WideSystem:
        """Bits ascending, rows distinct, equal schemas joined by intersection under their least id."""
        order = F.array_sort("bits")
        moved = self.relations.select("table_id", order.alias("sorted"), positions_of(order, F.col("bits")).alias("at"))
        relations = moved.groupBy(F.col("sorted").alias("bits")).agg(F.min("table_id").alias("first"), F.count(F.lit(1)).alias("n"))
        rows = self.rows.join(beside(moved, self.relations), "table_id").select("table_id", F.col("sorted").alias("bits"), project(F.col("words"), F.col("at")).alias("words")).distinct()
        held = rows.groupBy("bits", "words").agg(F.count(F.lit(1)).alias("held"))
        kept = held.join(relations, "bits").where("held = n").select(F.col("first").alias("table_id"), "words")
        return WideSystem(relations.select(F.col("first").alias("table_id"), "bits"), kept)

    def keep_bits(self, bits: DataFrame, keep: bool = True) -> WideSystem:
        """Each table projected to its bits that are (or, keep=False, are not) in bits(bit), in their order; rows distinct."""
        named = self.relations.select("table_id", F.posexplode("bits").alias("pos", "bit")).join(beside(bits.select("bit").distinct().withColumn("hit", F.lit(True)), bits), "bit", "left")
        parts = named.where("hit" if keep else "hit is null").groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("pos", "bit"))).alias("p"))
        new = self.relations.select("table_id").join(parts.hint("merge"), "table_id", "left").select(
            "table_id",
            F.coalesce(F.transform("p", lambda x: x["bit"]), F.array().cast("array<long>")).alias("bits"),
            F.coalesce(F.transform("p", lambda x: x["pos"]), F.array().cast("array<int>")).alias("at"),
        )
        rows = self.rows.join(beside(new, self.relations), "table_id").select("table_id", project(F.col("words"), F.col("at")).alias("words")).distinct()
        return WideSystem(new.select("table_id", "bits"), rows)

    def without(self, ids: DataFrame) -> WideSystem:
        drop = ids.select("table_id")
        return WideSystem(self.relations.join(beside(drop), "table_id", "left_anti"), self.rows.join(beside(drop), "table_id", "left_anti"))

    def narrow(self) -> System:
        """The same as a system of masks; an error if a table has more than 63 bits."""
        fits = F.when(F.size("bits") < WORD, F.col("bits")).otherwise(F.raise_error(F.lit("a table has more than 63 bits")).cast("array<long>"))
        return System(self.relations.select("table_id", fits.alias("bits")), self.rows.select("table_id", F.col("words")[0].alias("row")))


def tautology_filter(system: WideSystem) -> tuple[WideSystem, DataFrame]:
    """The system without relations that allow every assignment; and arity, relations, row_total of
    what was removed and kept. 2^63 rows are never met, so a table of 63 bits or more is none."""
    sized = cut(system.sized.select("*", is_full(F.col("row_count"), F.col("arity")).alias("removed")), "sized")
    stats = sized.groupBy("removed", "arity").agg(F.count(F.lit(1)).alias("relations"), F.sum("row_count").alias("row_total"))
    return system.without(sized.where("removed")), stats


def verify_projections(source: WideSystem, projected: WideSystem) -> DataFrame:
    """table_id, exact_rows, projected_rows, missing, extra, matches, tautology: whether each relation of
    projected is exactly the projection of the source's relation of the same id to its bits, which
    must be the source's own order of them. Rows are compared by one full join of all relations."""
    pairs = projected.relations.join(source.relations.select("table_id", F.col("bits").alias("whole")).hint("merge"), "table_id")
    ordered = F.filter("whole", lambda b: F.array_contains("bits", b)) == F.col("bits")
    checked = pairs.select("table_id", F.when(ordered, F.col("bits")).otherwise(F.raise_error(F.lit("the projection's bits are not the source's")).cast("array<long>")).alias("bits"), positions_of(F.col("bits"), F.col("whole")).alias("at"))
    want = source.rows.join(beside(checked, projected.relations), "table_id").select("table_id", project(F.col("words"), F.col("at")).alias("words")).distinct().withColumn("wanted", F.lit(1))
    have = projected.rows.select("table_id", "words").distinct().withColumn("found", F.lit(1))
    each = want.join(have, ["table_id", "words"], "full").groupBy("table_id").agg(F.count("wanted").alias("exact_rows"), F.count("found").alias("projected_rows"), F.count_if(F.col("found").isNull()).alias("missing"), F.count_if(F.col("wanted").isNull()).alias("extra"))
    whole = checked.select("table_id", F.size("bits").alias("arity")).join(each.hint("merge"), "table_id", "left").na.fill(0)
    return whole.select("table_id", "exact_rows", "projected_rows", "missing", "extra", ((F.col("missing") == 0) & (F.col("extra") == 0)).alias("matches"), is_full(F.col("exact_rows"), F.col("arity")).alias("tautology"))


def read_containers(spark: SparkSession, path: str) -> WideSystem:
    """The relations of the containers under path, of any row words; ids in file order."""
    t = container.placed(container.read_stream(spark, path).where("name is null").drop("name"))
    high = F.when(F.col("kind") == 4, F.col("rows_hi"))
    words = F.transform(F.arrays_zip("rows", F.coalesce(high, F.array_repeat(F.lit(0).cast("long"), F.size("rows"))).alias("rows_hi")), lambda x: F.array(x["rows"], x["rows_hi"]))
    rows = t.select("table_id", F.size("bits").alias("arity"), F.explode(words).alias("words"))
    return WideSystem(t.where("part = 0").select("table_id", "bits"), rows.select("table_id", fitted(F.col("words"), F.col("arity")).alias("words")))


def write_containers(system: WideSystem, path: str, overwrite: bool = True) -> None:
    """A folder of containers in canonical order, each table in the smallest words that hold it; an error for more than 128 bits."""
    spark = system.relations.sparkSession
    spark.dataSource.register(container.ContainerSource)
    word = lambda i: F.coalesce(F.try_element_at("words", F.lit(i)), F.lit(0).cast("long"))
    # rows in ascending order of their unsigned values: the sign bits are turned around
    turned = lambda c: c.bitwiseXOR(F.lit(-(1 << 63)))
    held = system.rows.groupBy("table_id").agg(F.array_sort(F.collect_set(F.struct(turned(word(2)).alias("high"), turned(word(1)).alias("low")))).alias("both"))
    fits = F.when(F.size("bits") <= 128, F.col("bits")).otherwise(F.raise_error(F.lit("a table has more than 128 bits")).cast("array<long>"))
    packed = system.relations.select("table_id", fits.alias("bits")).join(held.hint("merge"), "table_id", "left").withColumn("both", F.coalesce("both", F.array().cast("array<struct<high:long,low:long>>")))
    ordered = packed.repartitionByRange(F.size("bits"), "bits", "table_id").sortWithinPartitions(F.size("bits"), "bits", "table_id")
    records = ordered.select("bits", F.transform("both", lambda x: turned(x["low"])).alias("rows"), F.transform("both", lambda x: turned(x["high"])).alias("rows_hi"))
    records.write.format(container.ContainerSource.name()).mode("overwrite" if overwrite else "append").save(path)


def read_json(spark: SparkSession, path: str) -> WideSystem:
    """A JSON array (or lines) of {rows, bits} whose rows are unsigned integers of up to 64 bits."""
    df = spark.read.schema("rows array<decimal(20,0)>, bits array<long>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    df = cut(df.withColumn("table_id", F.monotonically_increasing_id()), "json")
    half, turn = F.lit(str(1 << 63)).cast("decimal(20,0)"), F.lit(str(1 << 64)).cast("decimal(20,0)")
    signed = lambda r: F.array(F.when(r < half, r).otherwise(r - turn).cast("long"))
    rows = df.select("table_id", F.size("bits").alias("arity"), F.explode(F.transform("rows", signed)).alias("words"))
    return WideSystem(df.select("table_id", "bits"), rows.select("table_id", fitted(F.col("words"), F.col("arity")).alias("words")))


def write_json(system: WideSystem, path: str) -> None:
    """One JSON object for each table of up to 64 bits, written in parallel; rows are unsigned."""
    turn = F.lit(str(1 << 64)).cast("decimal(20,0)")
    unsigned = F.when(F.col("words")[0] >= 0, F.col("words")[0].cast("decimal(20,0)")).otherwise(F.col("words")[0].cast("decimal(20,0)") + turn)
    fits = F.when(F.size("bits") <= WORD, F.col("bits")).otherwise(F.raise_error(F.lit("a table has more than 64 bits")).cast("array<long>"))
    rows = system.rows.select("table_id", unsigned.cast("decimal(20,0)").alias("row")).groupBy("table_id").agg(F.array_sort(F.collect_set("row")).alias("rows"))
    packed = system.relations.select("table_id", fits.alias("bits")).join(rows.hint("merge"), "table_id", "left")
    packed.select(F.coalesce("rows", F.array().cast("array<decimal(20,0)>")).alias("rows"), "bits").write.mode("overwrite").json(path)


def texts(system: WideSystem) -> DataFrame:
    """table_id, row: each row as its bits in order, as a text of 0 and 1."""
    both = system.rows.join(beside(system.relations), "table_id")
    digits = F.transform(F.sequence(F.lit(0), F.size("bits") - 1), lambda i: bit_of(F.col("words"), i).cast("string"))
    return both.select("table_id", F.when(F.size("bits") == 0, "").otherwise(F.array_join(digits, "")).alias("row"))
