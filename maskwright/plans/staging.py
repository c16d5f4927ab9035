"""Numbering and graph helpers that hold at any size: no window over a whole table, no rows on the driver."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share; a single-machine session that names none gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="maskwright-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly, for work that costs far more than a shuffle of its rows: a Parquet file is read by as many tasks as
    it has row groups, and a small table has one."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def settle(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends there, and later plans read only the columns
    they need."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/maskwright/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(keys: DataFrame, group: str, order: list[str], name: str = "seq", buckets: int = 1024) -> DataFrame:
    """``keys`` with 1, 2, ... within each ``group`` in the order of ``order``.

    One task per group would be one task for most rows. Instead the rows are sorted by range: Spark samples the order and cuts
    it into partitions of about as many rows, whatever its distribution and types; each partition counts its rows by group, and
    a row's number is its turn in its partition after the counts of the partitions before. There are at most ``buckets``
    partitions, and of the counts (a row for each group and partition that has rows) none is collected.
    """
    parts = max(1, min(buckets, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    # written once: a partition's number and its rows must not be drawn again by another evaluation
    ranged = settle(keys.repartitionByRange(parts, group, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("_group"), F.col("_range").alias("_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range", group).orderBy(*order))
    met = ranged.withColumn("_row", inside).join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_part")))
    return met.withColumn(name, (F.col("_start") + F.col("_row")).cast("long")).drop("_start", "_row", "_range", "_group", "_part")


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of (a, b): the least node it is connected with. Least labels, with shortcuts, until nothing moves."""
    both = settle(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    labels = settle(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")))
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("root").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("u")).select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        further = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        moved = settle(lower.join(further, "root", "left").select("node", "was", F.coalesce("next", "root").alias("root")))
        labels = moved.select("node", "root")
        if moved.filter("was != root").isEmpty():
            return labels
