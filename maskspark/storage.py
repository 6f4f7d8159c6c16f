"""Cutting lineage through the shared folder that the cluster names; numbers without one task for all rows."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Where cut plans go when the session names no shared folder (tests).
LOCAL_SCRATCH = "file:///tmp/checkpoints/maskspark"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path of its own below the shared folder. A cluster must name one: a folder of one machine would not do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set")
    base = (base or LOCAL_SCRATCH).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df, written once as Parquet and read again; survives the loss of any executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Relations that a join broadcasts at most; more are dealt out.
BROADCAST = 10_000


def beside(df: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """df, which has one row for each relation, as the side of a join that is broadcast if there are few (by
    counted, where that is cheaper to count) and else dealt out by key as the other side is. Spark would go by the
    size of the files, of which repeated schemas take a hundredth of their memory, and gather any number on the driver."""
    few = (df if counted is None else counted).limit(BROADCAST + 1).count() <= BROADCAST
    return F.broadcast(df) if few else df.hint("merge")


def numbered(df: DataFrame, *order: str | Column, name: str = "number") -> DataFrame:
    """df with dense numbers from 0 in the given order, counted over ranges. Rows that tie in the whole order get any of their numbers."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = cut(df.repartitionByRange(*keys).withColumn("part_", F.spark_partition_id()), "order")
    before, total = {}, 0
    for part, n in sorted((r.part_, r["count"]) for r in dealt.groupBy("part_").count().collect()):  # one row for each range
        before[part], total = total, total + n
    start = F.element_at(F.create_map(*(F.lit(x) for pair in before.items() for x in pair)), F.col("part_")) if before else F.lit(0)
    within = F.row_number().over(Window.partitionBy("part_").orderBy(*keys)) - 1
    return dealt.withColumn(name, (within + start).cast("long")).drop("part_")


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What is stored under path; nothing where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
