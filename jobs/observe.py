"""Incremental job: which constraints hold between predicates on documents, in each group so far.

    python -m jobs.observe --documents PATH --out PATH [--config PATH]

Reads only the files of the documents folder that earlier runs have not read (a file stream with a
checkpoint, to the end of what is there), counts the observed rows of each relation, adds them to
the state, and works out anew the constraints of those parts that the new rows touch: bits with
one value (forced), and pairs of bits that are always equal or opposite.

Under the out folder:

* checkpoint/   the stream's own record of the files it has read;
* deltas/       batch=, part=: observed rows of each micro-batch; a batch that is run again overwrites its own;
* state/        part=: all observed rows so far, with the last batch that they hold (the high-water mark of the part);
* constraints/  part=: what holds, with the same mark.

Parts are hashes of groups. State and constraints are replaced part by part (dynamic partition
overwrite). A run that dies is made good by the next one: a part whose state is behind the deltas,
or whose constraints are behind its state, is done again, from rows that are all still there.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskspark.operators.observations import observe, system_of, width
from maskspark.operators.reductions import forced_bits, pair_relations
from maskspark.storage import cut, scratch, stored

log = logging.getLogger("jobs.observe")

_OBSERVED = "group string, relation int, row long, n long"
DELTAS = f"{_OBSERVED}, batch long, part int"
STATE = f"{_OBSERVED}, upto long, part int"
_FACT = "group string, kind string, relation int, left_bit long, right_bit long, value int, n long"
CONSTRAINTS = f"{_FACT}, upto long, part int"


def default_config() -> dict:
    return json.loads(Path(__file__).with_name("observe.json").read_text())


def _relations(config: dict) -> list[list[int]]:
    return [list(map(int, bits)) for bits in config["relations"]]


def _replace(df: DataFrame, path: str, *parts: str) -> None:
    """Overwrites just the partitions that df holds."""
    df.repartition(*parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def _pattern(path: str) -> str:
    """The path as a pattern that matches only itself: a file stream then takes one file as well as a folder."""
    path = path.rstrip("/")
    return path if set(path) & set("*?[]{}") else f"{path[:-1]}[{path[-1]}]"


def read_new(spark: SparkSession, documents: str, out: str, config: dict) -> None:
    """Observes every file that the checkpoint does not know, in batches."""
    predicates = {int(b): p for b, p in config["predicates"].items()}

    def keep(batch: DataFrame, number: int) -> None:
        part = F.pmod(F.xxhash64("group"), F.lit(config["parts"])).cast("int")
        found = cut(observe(batch, predicates, _relations(config), config["group"]).withColumn("batch", F.lit(number).cast("long")).withColumn("part", part), "observed")
        _replace(found, f"{out}/deltas", "batch", "part")
        read = found.where("relation = 0").agg(F.sum("n"), F.countDistinct("part")).first()
        log.info("batch %d: read %s documents, wrote rows of %s parts to %s/deltas", number, read[0] or 0, read[1], out)

    stream = spark.readStream.schema(spark.read.parquet(documents).schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(_pattern(documents))
    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def _behind(newer: DataFrame, mark: str, older: DataFrame) -> list[int]:
    """Parts in which newer's mark is above older's; there are no more than the config's parts."""
    a, b = newer.groupBy("part").agg(F.max(mark).alias("new")), older.groupBy("part").agg(F.max("upto").alias("old"))
    return sorted(r.part for r in a.join(b, "part", "left").where("old is null or new > old").select("part").collect())


def fold(spark: SparkSession, out: str) -> list[int]:
    """Adds deltas beyond each part's mark to its state; the parts that changed."""
    deltas, state = stored(spark, f"{out}/deltas", DELTAS), stored(spark, f"{out}/state", STATE)
    parts = _behind(deltas, "batch", state)
    if parts:
        state = state.where(F.col("part").isin(parts))
        marks = state.groupBy("part").agg(F.max("upto").alias("seen"))
        new = deltas.where(F.col("part").isin(parts)).join(F.broadcast(marks), "part", "left").where("seen is null or batch > seen")
        both = state.unionByName(new.withColumnRenamed("batch", "upto").drop("seen"))
        total = both.groupBy("group", "relation", "row", "part").agg(F.sum("n").alias("n"), F.max("upto").alias("upto"))
        _replace(cut(total, "state"), f"{out}/state", "part")  # written apart first: its own folder is read
    log.info("folded new rows into %d parts of %s/state", len(parts), out)
    return parts


def constraints(observed: DataFrame, relations: list[list[int]]) -> DataFrame:
    """group, kind, relation, left_bit, right_bit, value, n of all that holds in observed(group, relation, row, n):
    size: n assignments of the relation occur; forced: the bit has the value in n relations;
    pair: the bits are equal (value 0) or opposite (1) in n relations."""
    system, groups = system_of(cut(observed, "observed"), relations)
    system, groups = system.saved(), cut(groups, "groups")
    wide, many, none = F.lit(width(relations)), F.lit(len(relations)), F.lit(None)
    bit = lambda c: F.pmod(F.col(c), wide)
    of = lambda c: F.expr(f"{c} div {width(relations)}").alias("number")
    sizes = system.sized.select(F.expr(f"table_id div {len(relations)}").alias("number"), F.lit("size").alias("kind"), F.pmod("table_id", many).cast("int").alias("relation"), none.cast("long").alias("left_bit"), none.cast("long").alias("right_bit"), none.cast("int").alias("value"), F.col("row_count").alias("n"))
    forced = forced_bits(system).select(of("bit"), F.lit("forced"), none.cast("int"), bit("bit"), none.cast("long"), "value", "occurrences")
    pairs = pair_relations(system).select(of("left"), F.lit("pair"), none.cast("int"), bit("left"), bit("right"), F.col("inverted").cast("int"), "support")
    return sizes.union(forced).union(pairs).join(groups, "number").select(*(c.split()[0] for c in _FACT.split(", ")))


def refresh(spark: SparkSession, out: str, config: dict) -> list[int]:
    """Works out the constraints of the parts whose state has moved on; those parts."""
    state, held = stored(spark, f"{out}/state", STATE), stored(spark, f"{out}/constraints", CONSTRAINTS)
    parts = _behind(state, "upto", held)
    if parts:
        state = state.where(F.col("part").isin(parts))
        marks = F.broadcast(state.groupBy("part").agg(F.max("upto").alias("upto")))
        found = constraints(state.select("group", "relation", "row", "n"), _relations(config))
        part = F.pmod(F.xxhash64("group"), F.lit(config["parts"])).cast("int")
        _replace(found.withColumn("part", part).join(marks, "part"), f"{out}/constraints", "part")
    log.info("wrote the constraints of %d parts to %s/constraints", len(parts), out)
    return parts


def run(spark: SparkSession, documents: str, out: str, config: dict) -> DataFrame:
    """One run over what is new; the constraints of all groups as they stand after it."""
    out = out.rstrip("/")
    log.info("reading new files of %s", documents)
    read_new(spark, documents, out, config)
    fold(spark, out)
    refresh(spark, out, config)
    return stored(spark, f"{out}/constraints", CONSTRAINTS).drop("upto", "part")


def job1_observed_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs into one new folder; the second finds nothing new."""
    out = scratch(spark, "job1")
    for _ in range(2):
        found = run(spark, f"{sf_dir.rstrip('/')}/documents.parquet", out, default_config())
    return found


def sql(config: dict | None = None) -> str:
    """The same in DuckDB's SQL."""
    config = config or default_config()
    relations = _relations(config)
    bits = ", ".join(f"cast(coalesce({p}, false) as int) as b{b}" for b, p in config["predicates"].items())
    sizes = " union all ".join(f"select g, 'size' as kind, {i} as relation, cast(null as bigint) as left_bit, cast(null as bigint) as right_bit, cast(null as int) as value, count(*) as n from (select distinct g, {', '.join(f'b{b}' for b in own)} from d) group by g" for i, own in enumerate(relations))
    used = sorted({b for own in relations for b in own})
    forced = " union all ".join(f"select g, 'forced', null, {b}, null, min(b{b}), {sum(b in own for own in relations)} from d group by g having min(b{b}) = max(b{b})" for b in used)
    pairs = sorted({(a, b) for own in relations for a in own for b in own if a < b})
    pair = " union all ".join(
        f"select g, 'pair', null, {a}, {b}, min(abs(b{a} - b{b})), {sum(a in own and b in own for own in relations)} from d group by g having min(abs(b{a} - b{b})) = max(abs(b{a} - b{b}))" for a, b in pairs
    )
    return f"with d as (select distinct {config['group']} as g, {bits} from documents) select g as \"group\", kind, relation, left_bit, right_bit, value, n from ({sizes} union all {forced} union all {pair})"


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Adds new documents to the constraints observed so far.")
    p.add_argument("--documents", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--config")
    a = p.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("observe").getOrCreate()
    try:
        config = json.loads(spark.read.text(a.config, wholetext=True).first()[0]) if a.config else default_config()
        run(spark, a.documents, a.out, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
