"""Shared plumbing of the training-data operators: tables, cut points, distributed prefix sums."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words everywhere in this subpackage: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir. Where that is unset, a temporary one on a single machine (tests), else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        named = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Frees a query's shuffle files as soon as it ends, rather than when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(df: DataFrame, compression: str = "zstd", level: int = 3) -> DataFrame:
    """df written once to the shared folder and read back: lineage ends here, sizes are known to the planner. Shuffle files of the write go with it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).option("parquet.compression.codec.zstd.level", level).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables made by `table`. Only for those that no later plan reads: what is computed from them has been written itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Hands memory that this process has freed back to the machine, where the C library can (glibc keeps it otherwise)."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def unit_hash(*cols) -> F.Column:
    """A reproducible uniform number in (0, 1) from the md5 of the given columns; 52 bits."""
    digest = F.md5(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def small_join(left: DataFrame, right: DataFrame, on, how: str = "inner", rows: int = 100_000) -> DataFrame:
    """left join right, with right broadcast only if a count shows that it has at most `rows` rows (else the planner's choice)."""
    if right.limit(rows + 1).count() <= rows:
        right = F.broadcast(right)
    return left.join(right, on, how)


def prefix_sums(df: DataFrame, group: str, key: str, unit: str, value: str, ties: list[str]) -> DataFrame:
    """df with `before`: the sum of `value` over the rows of the same group that precede in order of (key, ties).

    `unit` is any column in [0, 1) that never decreases as `key` grows. A group of n rows is dealt into about
    sqrt(n) ranges of `unit`; ranges are summed first and only their sums (one row each) are accumulated per
    group, so that no task ever holds a group. Nulls in `group` form a group of their own.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(F.col(group).alias("_g"), F.ceil(F.sqrt("_n")).cast("long").alias("_parts"))
    dealt = small_join(df, sizes, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    dealt = dealt.withColumn("_part", F.least(F.floor(F.col(unit) * F.col("_parts")), F.col("_parts") - 1)).drop("_parts")
    sums = dealt.groupBy(group, "_part").agg(F.sum(value).alias("_sum"))
    upto = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), "_sum")
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(upto), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(group, "_part").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p"))
    return dealt.join(sums, same).withColumn("before", F.col("_base") + F.col("_in")).drop("_g", "_p", "_part", "_base", "_in")


