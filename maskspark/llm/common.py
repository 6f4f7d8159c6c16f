"""Helpers shared by the text operators: sources, scratch files, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where scratch files go when the session names no shared folder (tests).
LOCAL_SCRATCH = "file:///tmp/checkpoints/maskspark"
#: Rows of one Arrow batch; documents are long, so batches hold few of them.
ROWS_PER_BATCH = 1000
#: Bytes of text handled at once inside a Python worker.
BYTES_PER_PIECE = 4 << 20

#: White space between words (fixed values): space and the code points 9 to 13.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one only where none is set."""
    return (spark.conf.get("spark.checkpoint.dir", None) or LOCAL_SCRATCH).rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets the cluster delete shuffle files of plans that nothing refers to any longer."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo modulus; null ids give null."""
    return F.crc32(F.col(column).cast("string")) % modulus


def least_hashed(rows: DataFrame, kind: str, bound: int) -> DataFrame:
    """Of each kind at most `bound` rows, those of least hash of doc_id, as many whole classes of
    hashes as fit: a threshold for each kind, found from counts alone, so no task gathers a kind.
    Rows that repeat an id stay or go together. Rows without kind or id go."""
    # Sixteen classes for each power of two: a threshold loses about a sixteenth of the bound.
    level = F.floor(F.log2(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 62)).cast("double") + 1) * 16).cast("int")
    named = rows.where(F.col(kind).isNotNull() & F.col("doc_id").isNotNull())
    limits: dict[object, int] = {}
    held: dict[object, int] = {}
    for r in named.groupBy(F.col(kind).alias("kind"), level.alias("level")).count().orderBy("kind", "level").collect():  # 1,000 rows for each kind at most
        held[r.kind] = held.get(r.kind, 0) + r["count"]
        if held[r.kind] <= bound:
            limits[r.kind] = r.level
    if not limits:
        return named.limit(0)
    chosen = F.lit(False)
    by_level: dict[int, list[object]] = {}
    for k, most in limits.items():
        by_level.setdefault(most, []).append(k)
    for most, kinds in sorted(by_level.items()):
        chosen = chosen | (F.col(kind).isin(kinds) & (level <= most))
    return named.where(chosen)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def share(spark: SparkSession, value: object) -> Callable[[], object]:
    """value for all executors, which need not have this package; the caller proves that its size is bounded."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(held.value)


def pieces(batch: pa.RecordBatch, column: str, limit: int = BYTES_PER_PIECE) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each piece holds about limit bytes of column (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)


def per_worker(key: tuple, make: Callable[[], object]) -> object:
    """What make() gives, kept in the Python worker for its later tasks until one with another key."""
    held = _held()
    if key not in held:
        held.clear()
        gc.disable()  # millions of small objects without cycles would be walked again and again
        held[key] = make()
    held["used"] = True
    return held[key]


def per_process(key: str, make: Callable[[], object]) -> object:
    """What make() gives, kept for good in this Python process: for small arrays that a rule builds."""
    kept = sys.modules.setdefault("_text_operators_held", types.ModuleType("_text_operators_held")).__dict__.setdefault("kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def forget() -> None:
    """Frees what per_worker() keeps for other operators."""
    _held().clear()
    gc.enable()
    gc.collect()


def _held() -> dict:
    return sys.modules.setdefault("_text_operators_held", types.ModuleType("_text_operators_held")).__dict__.setdefault("held", {})


def map_pieces(df: DataFrame, column: str, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]], limit: int = BYTES_PER_PIECE) -> DataFrame:
    """mapInArrow over pieces of about limit bytes of text. make() runs once for each task and
    returns the function from a piece to the columns of its rows, in the order of schema."""
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _held()
        held.pop("used", None)
        step = make()
        if held and "used" not in held:
            forget()
        for batch in batches:
            for piece in pieces(batch, column, limit):
                out = step(piece)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if not isinstance(out[f.name], (pa.Array, pa.ChunkedArray)) else out[f.name] for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def trim() -> None:
    """Gives memory that this Python process has freed back to the system, which counts it until then."""
    pa.default_memory_pool().release_unused()
    free = per_process("malloc_trim", lambda: getattr(ctypes.CDLL(None), "malloc_trim", None))  # of glibc
    if free:
        free(0)


def texts(piece: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a piece; null counts as empty."""
    return [x or "" for x in piece[column].to_pylist()]
