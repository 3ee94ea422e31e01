"""Small helpers that the text operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of one Arrow batch sent to a Python worker, whatever the length of its texts.
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where none is named, a session on one machine (tests) sets a temporary folder once; on a cluster that raises.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="roadspark-"))
        at = spark.sparkContext.getCheckpointDir()
    return at


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage with files that every executor can read, so it survives lost executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes, so that long texts don't fill a worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def released() -> None:
    """Give the memory that is free in this Python worker back to the system, which Arrow's pool and the C library keep.

    A worker waits for its next task beside the executor, where all that it holds counts.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def with_fields(df: DataFrame, *fields: T.StructField) -> T.StructType:
    """The schema of ``df`` with ``fields`` at its end; a column of the same name is replaced."""
    names = {f.name for f in fields}
    return T.StructType([f for f in df.schema.fields if f.name not in names] + list(fields))


def extended(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """``batch`` with the columns of ``new`` at its end; columns of the same name are replaced."""
    kept = [n for n in batch.schema.names if n not in new]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in kept] + list(new.values()), names=kept + list(new))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Two columns ``k_id``, ``k_text`` that tell rows apart by id and whole text; equal rows share them."""
    return [F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("k_id"), F.xxhash64(id_col, text_col).alias("k_text")]


def _placed(df: DataFrame, order: list[str], what: str, deal: list[Column] | None = None, keep: list[Column] | None = None) -> DataFrame:
    """Stored ``df`` with ``place``, which orders its rows by ``order``; its upper bits name the range, the lower 33 count from 0 in it."""
    placed = df.repartitionByRange(*(deal or [F.col(c) for c in order])).sortWithinPartitions(*order)
    return stored(placed.select(*(keep or df.columns), F.monotonically_increasing_id().alias("place")), what)


def ranged_numbers(df: DataFrame, order: list[str], name: str, what: str) -> DataFrame:
    """Stored ``df`` with dense numbers from 0 in ``order``: the rows of the ranges before, then the place in the range."""
    placed = _placed(df, order, what)
    at = F.shiftright("place", 33).alias("_range")
    counts = placed.groupBy(at).agg(F.count("*").alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.withColumn("_range", at).join(before, "_range").withColumn(name, F.col("_before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).select(*df.columns, name)


def ranged_sums(df: DataFrame, order: list[str], within: list[str], sums: dict[str, str], what: str, deal: list[Column] | None = None, keep: list[Column] | None = None) -> DataFrame:
    """Stored ``df`` with ``place`` (the order of its rows) and running sums before each row in its group.

    ``sums`` maps columns to the names of their sums over the rows of the same ``within`` that stand before; ``within`` begins
    ``order``.  Rows are dealt out by ranges of ``order`` (or of ``deal``, coarser columns in the same order), summed inside a range, and
    the few rows (one for each group and range) that carry sums over are summed again, so a group of any size spreads over tasks.
    Null groups are groups.  ``keep`` says what is kept of the rows once they are in order, all columns if it isn't given.
    """
    placed = _placed(df, order, what, deal, keep)
    names = placed.columns
    placed = placed.withColumn("_range", F.shiftright("place", 33))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumns({f"_in_{c}": F.coalesce(F.sum(c).over(before.partitionBy(*within, "_range").orderBy("place")), F.lit(0)) for c in sums})
    carried = placed.groupBy(*within, "_range").agg(*(F.sum(c).alias(f"_all_{c}") for c in sums))
    carried = carried.select(*(F.col(c).alias(f"_g_{c}") for c in within), F.col("_range").alias("_r"), *(F.coalesce(F.sum(f"_all_{c}").over(before.partitionBy(*within).orderBy("_range")), F.lit(0)).alias(f"_before_{c}") for c in sums))
    same = [inside["_range"] == carried["_r"], *(inside[c].eqNullSafe(carried[f"_g_{c}"]) for c in within)]
    return inside.join(carried, same).select(*names, *((F.col(f"_in_{c}") + F.col(f"_before_{c}")).alias(n) for c, n in sums.items()))
