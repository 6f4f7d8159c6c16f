"""Relations that arrive over time, folded into one system by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from maskspark.system import RELATIONS, ROWS, System


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (bits, rows) from JSON lines dropped into a folder."""
    return spark.readStream.schema("bits array<long>, rows array<long>").json(path)


def fold(stream: DataFrame, start: System, keep: Callable[[System], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch joins the system (equal schemas intersect) and keep() gets the result. The
    folded system of each batch is written under checkpoint, named by the batch's number, so a
    restarted query goes on from the batch before; a replayed batch is folded again onto the same one."""
    from pyspark.sql import functions as F

    spark = stream.sparkSession
    path = lambda n, part: f"{checkpoint.rstrip('/')}/folded/{n}/{part}"

    def before(n: int) -> System:
        if n <= 0:
            return start
        return System(spark.read.schema(RELATIONS).parquet(path(n - 1, "relations")), spark.read.schema(ROWS).parquet(path(n - 1, "rows")))

    def step(batch: DataFrame, n: int) -> None:
        new = System.unpacked(batch.select(F.xxhash64(F.size("bits"), "bits", "rows").alias("table_id"), "bits", "rows").distinct())
        held = before(n)
        out = System(held.relations.unionByName(new.relations), held.rows.unionByName(new.rows)).canonical()
        out.relations.write.mode("overwrite").parquet(path(n, "relations"))
        out.rows.write.mode("overwrite").parquet(path(n, "rows"))
        keep(before(n + 1))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()
