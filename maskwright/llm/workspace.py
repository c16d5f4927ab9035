"""Where operators keep intermediate tables: the shared folder the cluster names in ``spark.checkpoint.dir``.

A staged table is written once and read back, so a lost executor costs at most the tasks it was running: nothing
downstream recomputes what the table holds, and no block lives on one machine alone.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only a single-machine session that names none gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    master = spark.sparkContext.master
    if not (master.startswith("local[") or master == "local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="maskwright-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/maskwright/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def small_batches(spark: SparkSession, most: int = 4 << 20) -> Iterator[None]:
    """Arrow batches of at most about ``most`` bytes for what is run inside: a batch stands several times in an executor's memory,
    and ten thousand long texts are a large one."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the table read back; its folder is ``staged_path``."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def drop_staged(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    path = getattr(df, "staged_path", None)
    if path:
        spark = df.sparkSession
        hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_broadcast(df: DataFrame, row_limit: int, byte_limit: int = 64 << 20) -> tuple[DataFrame, bool]:
    """A broadcast hint if ``df`` has been measured to hold at most ``row_limit`` rows and ``byte_limit`` bytes (as JSON); else
    ``df`` as it is (shuffled joins)."""
    size = F.octet_length(F.to_json(F.struct(*df.columns)))
    n, held = df.limit(row_limit + 1).agg(F.count("*"), F.sum(size)).first()
    small = n <= row_limit and (held or 0) <= byte_limit
    return (F.broadcast(df), True) if small else (df, False)


def hot_join(many: DataFrame, few: DataFrame, key: str, n: str, by: list[str], how: str = "inner", least: int = 1_000, most_hot: int = 100_000) -> DataFrame:
    """``many.join(few, key, how)`` in which a frequent key is dealt among many tasks.

    ``few`` has one row for each key, with the number ``n`` of its rows in ``many`` (dropped). A key of more than ``least`` rows,
    or of a ``most_hot``-th of all rows where that is more, is hot: its rows are dealt by a hash of the columns ``by`` into
    cells of about as many rows, and its row in ``few`` is repeated for each cell. There are at most ``most_hot`` hot keys,
    whatever the input, and they alone are broadcast.
    """
    total = few.agg(F.sum(n)).first()[0] or 0
    from_ = max(least, total // most_hot)
    cells = F.ceil(F.col(n) / from_).cast("int")
    hot = F.broadcast(few.filter(F.col(n) > from_).select(F.col(key).alias("_key"), cells.alias("_cells")))
    cell = F.coalesce(F.pmod(F.xxhash64(*by), F.col("_cells")).cast("int"), F.lit(0))
    left = many.join(hot, F.col(key) == F.col("_key"), "left").withColumn("_cell", cell).drop("_key", "_cells")
    right = few.withColumn("_cell", F.explode(F.sequence(F.lit(0), F.when(F.col(n) > from_, cells - 1).otherwise(0)))).drop(n)
    return left.join(right, [key, "_cell"], how).drop("_cell")


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with 0, 1, ... in the order of ``order`` over the whole table: sorted by ranges that Spark samples, each counted and
    numbered by itself. One row for each range is all that meets in one task."""
    ranges = partitions(df.sparkSession)
    dealt = stage(df.repartitionByRange(ranges, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    turn = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_turn", turn).join(F.broadcast(starts), "_part").withColumn(name, (F.col("_start") + F.col("_turn") - 1).cast("long")).drop("_part", "_turn", "_start")
