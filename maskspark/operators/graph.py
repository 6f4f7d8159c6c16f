"""The overlap graph of relations: an edge for each pair with a shared bit, and its blocks of compatible rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskspark.operators.joins import compatible_rows, shared_pairs
from maskspark.system import System


def overlap_edges(system: System) -> DataFrame:
    """l_table_id, r_table_id, shared_bits, blocks, row_pairs; edges without a compatible pair stay, with 0."""
    blocks = compatible_rows(system).groupBy("l_table_id", "r_table_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.size("l_rows").cast("long") * F.size("r_rows")).alias("row_pairs"))
    edges = shared_pairs(system).select("l_table_id", "r_table_id", F.size("shared").alias("shared_bits"))
    return edges.join(blocks, ["l_table_id", "r_table_id"], "left").na.fill(0, ["blocks", "row_pairs"])


def graph_stats(system: System) -> DataFrame:
    e = overlap_edges(system)
    return e.agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.sum("blocks"), F.lit(0)).alias("blocks"), F.coalesce(F.sum("row_pairs"), F.lit(0)).alias("row_pairs"), F.coalesce(F.sum((F.col("blocks") == 0).cast("long")), F.lit(0)).alias("incompatible_edges"))
