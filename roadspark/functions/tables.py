"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    Where none is set, a temporary one serves a session on one machine; on a cluster that raises.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="roadspark-"))
        at = spark.sparkContext.getCheckpointDir()
    return at


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back; this cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def running(df: DataFrame, within: list[str], part: str, order: list[str], sums: dict[str, str]) -> DataFrame:
    """``df`` with running sums before each row of its group: ``sums`` maps columns to the names of their sums.

    A group is dealt out in parts, whose numbers rise in the order of its rows; a part is summed by ``order`` inside, and one row for each part
    carries the sums over.
    """
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    inside = df.withColumns({f"_in_{c}": F.coalesce(F.sum(c).over(before.partitionBy(*within, part).orderBy(*order)), F.lit(0)) for c in sums})
    carried = df.groupBy(*within, part).agg(*(F.sum(c).alias(f"_all_{c}") for c in sums))
    carried = carried.select(*within, part, *(F.coalesce(F.sum(f"_all_{c}").over(before.partitionBy(*within).orderBy(part)), F.lit(0)).alias(f"_before_{c}") for c in sums))
    return inside.join(carried, [*within, part]).select(*df.columns, *((F.col(f"_in_{c}") + F.col(f"_before_{c}")).cast("long").alias(n) for c, n in sums.items()))
