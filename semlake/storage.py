"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Tables that were written and not dropped, by the folder's session; the last ones go when Python ends.
_held: dict[str, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder of our own, which only a local master may have."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        made = tempfile.mkdtemp(prefix="semlake-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.sparkContext.setCheckpointDir("file://" + made)
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there and lost executors only reread. The
    table goes with ``drop_table``, else when the driver's Python ends: a result may be read until then."""
    path = f"{shared_dir(df.sparkSession)}/semlake-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._semlake_path = path
    if not _held:
        atexit.register(drop_all)
    _held[path] = df.sparkSession
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def drop_table(df: DataFrame) -> None:
    """Delete a table written by table() that no later step reads."""
    _held.pop(df._semlake_path, None)
    _delete(df.sparkSession, df._semlake_path)


def drop_all(spark: SparkSession | None = None) -> None:
    """Delete all tables that are left, or those of one session; for between queries whose results have been read."""
    for path, own in list(_held.items()):
        if spark is None or own is spark:
            _held.pop(path)
            try:
                _delete(own, path)
            except Exception:  # noqa: BLE001, S112  the session has ended
                continue


def numbered(df: DataFrame, order: list[str], name: str, first: int = 1) -> DataFrame:
    """df with consecutive numbers in the given order: rows are dealt to sorted ranges, and only the ranges' counts, one
    row each, come together."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = table(df.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    out = ranged.withColumn("__nth", nth).join(F.broadcast(base), "__range")
    return out.withColumn(name, F.col("__nth") + F.col("__before") + F.lit(first - 1)).drop("__range", "__nth", "__before")


def numbered_within(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """df with the numbers 1, 2, ... of each group's rows in the given order. Rows are dealt to ranges sorted by group and
    order, so that no task sorts a large group as a whole; a range continues one group at most, so what is broadcast is a
    row for each range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = table(df.repartitionByRange(parts, group, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(group, "__range").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(group, "__range", F.sum("__n").over(earlier).alias("__before")).where("__before > 0")
    nth = F.row_number().over(Window.partitionBy("__range", group).orderBy(*order))
    out = ranged.withColumn("__nth", nth).join(F.broadcast(base), [group, "__range"], "left")
    return out.withColumn(name, (F.col("__nth") + F.coalesce("__before", F.lit(0))).cast("long")).drop("__range", "__nth", "__before")
