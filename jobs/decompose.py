"""Batch job: split the relations observed between predicates on documents and their labels into smaller ones, without loss.

    python -m jobs.decompose --documents PATH --labels PATH --out PATH [--config PATH]

Reads all documents and their labels, observes the relations of each group, and looks for the best
pair of projections of each relation that join back to it exactly. Before anything is written, the
factors found are joined and compared with the relations; a difference is an error.

Writes, overwriting what an earlier run left under the out folder:

* splits/   part=: for each group and relation its arity, rows, and the bits and rows of both factors (null where none exist);
* factors/  part=: the rows of both factors, or of the whole relation where it has no split.

The result depends on the input alone, so a run may be repeated at any time.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskspark.operators.decomposition import lost_or_added, named_by, projection_factors, projection_splits
from maskspark.operators.observations import observe, system_of, width
from maskspark.storage import cut, scratch

log = logging.getLogger("jobs.decompose")


def default_config() -> dict:
    return json.loads(Path(__file__).with_name("decompose.json").read_text())


def labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """documents with quality and toxic: null without a label, else 1 if one of its labels says so."""
    flags = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("label_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return documents.drop("quality", "toxic").join(flags, F.col("doc_id") == F.col("label_id"), "left")


def run(spark: SparkSession, documents: str, labels: str, out: str, config: dict) -> DataFrame:
    """The factors of all relations, read back after they were written."""
    out = out.rstrip("/")
    relations = [list(map(int, bits)) for bits in config["relations"]]
    docs, marks = spark.read.parquet(documents), spark.read.parquet(labels)
    observed = cut(observe(labelled(docs, marks), {int(b): p for b, p in config["predicates"].items()}, relations, config["group"]), "observed")
    read = observed.where("relation = 0").agg(F.sum("n"), F.countDistinct("group")).first()
    log.info("read %s documents of %d groups from %s, labels from %s", read[0] or 0, read[1], documents, labels)

    system, groups = system_of(observed, relations)
    system, groups = system.saved(), cut(groups, "groups")
    found = cut(projection_splits(system, config["least_arity"], config["most_arity"]), "splits")
    factors = projection_factors(system, found).saved()
    if not lost_or_added(system, factors).isEmpty():
        raise ArithmeticError("the factors do not join back to their relations")

    many, wide = len(relations), width(relations)
    text = lambda bits: F.array_join(F.transform(bits, lambda b: F.pmod(b, F.lit(wide)).cast("string")), ",")
    part = F.pmod(F.xxhash64("group"), F.lit(config["parts"])).cast("int").alias("part")
    key = (F.expr(f"table_id div {many}").alias("number"), F.pmod("table_id", F.lit(many)).cast("int").alias("relation"))
    report = system.sized.join(found.drop("row_count"), "table_id", "left").select(
        *key, text("bits").alias("bits"), "row_count", text(named_by(F.col("left"), "bits")).alias("left_bits"), text(named_by(F.col("right"), "bits")).alias("right_bits"), "left_rows", "right_rows"
    )
    whole = system.relations.join(found, "table_id", "left_anti").select("table_id", F.lit("whole").alias("factor"), "bits").join(system.rows, "table_id")
    split = factors.relations.join(factors.rows, "table_id").select(F.expr("table_id div 2").alias("table_id"), F.when(F.col("table_id") % 2 == 0, "left").otherwise("right").alias("factor"), "bits", "row")
    rows = whole.unionByName(split).select(*key, "factor", text("bits").alias("bits"), "row")
    for name, frame in (("splits", report), ("factors", rows)):
        frame.join(groups, "number").drop("number").withColumn("part", part).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{out}/{name}")
    log.info("wrote %d relations, %d of them split, to %s/splits and their rows to %s/factors", system.relations.count(), found.count(), out, out)
    return spark.read.schema("relation int, factor string, bits string, row long, `group` string, part int").parquet(f"{out}/factors").drop("part")


def job2_relation_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs into one new folder; the second replaces what the first wrote."""
    out, at = scratch(spark, "job2"), sf_dir.rstrip("/")
    for _ in range(2):
        found = run(spark, f"{at}/documents.parquet", f"{at}/labels.parquet", out, default_config())
    return found


def sql(config: dict | None = None) -> str:
    """The same in DuckDB's SQL: every pair of masks of every relation is tried."""
    config = config or default_config()
    relations = [list(map(int, bits)) for bits in config["relations"]]
    bits = ", ".join(f"cast(coalesce({p}, false) as int) as b{b}" for b, p in config["predicates"].items())
    rows = " union all ".join(f"select distinct g, {i} as relation, {len(own)} as arity, cast({' + '.join(f'b{b} * {1 << k}' for k, b in enumerate(own))} as bigint) as \"row\" from d" for i, own in enumerate(relations))
    widest = max(map(len, relations))
    packed = " + ".join(f"((m >> {i}) & 1) * ((\"row\" >> {i}) & 1) * (1 << bit_count(m & {(1 << i) - 1}))" for i in range(widest))
    named = " ".join(f"when relation = {i} then concat_ws(',', {', '.join(f'case when (m >> {k}) & 1 = 1 then {b} end' for k, b in enumerate(own))})" for i, own in enumerate(relations))
    return f"""
        with d as (
            select distinct {config['group']} as g, {bits} from documents
            left join (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by doc_id) using (doc_id)
        ),
        r as ({rows}),
        size as (select g, relation, arity, count(*) as n from r group by all),
        mask as (select cast(unnest(range(1, {1 << widest})) as bigint) as m),
        pair as (
            select k as arity, a.m as l, b.m as r from mask a, mask b, (select distinct arity as k from r)
            where a.m < b.m and b.m < (1 << k) - 1 and (a.m | b.m) = (1 << k) - 1 and k between {config['least_arity']} and {config['most_arity']}
        ),
        met as (
            select g, relation, pair.l, pair.r, count(distinct "row" & pair.l) as nl, count(distinct "row" & pair.r) as nr
            from r join pair using (arity) group by g, relation, pair.l, pair.r, "row" & pair.l & pair.r
        ),
        exact as (
            select met.g as g, relation, l, r, sum(nl) + sum(nr) as total from met join size using (relation)
            where met.g is not distinct from size.g group by met.g, relation, l, r, n having sum(nl * nr) = n
        ),
        best as (
            select * from exact qualify row_number() over (
                partition by g, relation order by greatest(bit_count(l), bit_count(r)), total, bit_count(l) + bit_count(r), -bit_count(l & r), l, r) = 1
        ),
        chosen as (
            select g, relation, 'left' as factor, l as m from best union all select g, relation, 'right', r from best
            union all select g, relation, 'whole', cast((1 << arity) - 1 as bigint) from size
            where not exists (select 1 from best where best.relation = size.relation and best.g is not distinct from size.g)
        )
        select distinct chosen.g as "group", relation, factor, case {named} end as bits, cast({packed} as bigint) as "row"
        from chosen join r using (relation) where chosen.g is not distinct from r.g"""


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Splits observed relations into smaller ones without loss.")
    p.add_argument("--documents", required=True)
    p.add_argument("--labels", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--config")
    a = p.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("decompose").getOrCreate()
    try:
        config = json.loads(spark.read.text(a.config, wholetext=True).first()[0]) if a.config else default_config()
        run(spark, a.documents, a.labels, a.out, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
