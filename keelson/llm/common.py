"""What the operators share: scratch tables in the cluster's shared folder, and digests."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one in local mode, in
    which driver and executors are one process; an error on a cluster, where each machine would
    write to its own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is unset: set it to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="keelson-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch tables that no later plan reads."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Scratch tables made since the start of each open `cleared` call.
MADE: list[list[str]] = []
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a row group, of which each task's scan and writer hold one, outside of what Spark accounts for and spills.
ROW_GROUP = 8 << 20
BLOCK, BATCH, BATCH_ROWS = "parquet.block.size", "spark.sql.parquet.columnarReaderBatchSize", 128
#: Scans take a row group in buffers of at most a quarter MiB, and Python gets a thousand texts at once: arrays of many MiB each
#: do not fit a small heap while other tasks are in native compression, which holds up its collection.
PIECES = {"parquet.hadoop.vectored.io.enabled": "false", "parquet.read.allocation.size": str(1 << 18), "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def small_pieces(spark: SparkSession) -> None:
    """From now on the session writes Parquet in row groups of ROW_GROUP bytes, reads it BATCH_ROWS rows at a
    time and takes both in PIECES, unless it has other sizes set: a lazy result is read and written by its caller, in
    the caller's session."""
    if spark.conf.get(BLOCK, None) is None and spark._jsc.hadoopConfiguration().get(BLOCK) is None:
        spark.conf.set(BLOCK, str(ROW_GROUP))
    if not spark._jsparkSession.sessionState().conf().contains(BATCH):
        spark.conf.set(BATCH, str(BATCH_ROWS))
    for key, value in PIECES.items():
        if not spark._jsparkSession.sessionState().conf().contains(key) and spark._jsc.hadoopConfiguration().get(key) is None:
            spark.conf.set(key, value)


def write(df: DataFrame, path: str, by: list[str] = ()) -> None:
    """Writes a scratch table; the shuffle files behind it go as soon as it is there."""
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        df.write.option(BLOCK, ROW_GROUP).partitionBy(*by).parquet(path)
    finally:
        conf.set(CLEANUP, before)
    if MADE:
        MADE[-1].append(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: its lineage ends there,
    and the loss of an executor costs no recomputation beyond it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    write(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def cleared(make, name: str) -> DataFrame:
    """`written` of what make() returns, without the scratch tables that it left behind."""
    MADE.append([])
    try:
        out = written(make(), name)
        made = MADE.pop()
    except BaseException:
        MADE.pop()
        raise
    remove(out.sparkSession, *[p for p in made if p != out.scratch_path])
    if MADE:
        MADE[-1].append(out.scratch_path)
    return out


def salted_join(many: DataFrame, one: DataFrame, key: str, by: str, salts: int = 8) -> DataFrame:
    """many joined with one, whose rows `key` tells apart, where a few keys may be those of many rows
    of `many`: these are dealt over `salts` tasks by their column `by`."""
    left = many.withColumn("salt_", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    right = one.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "salt_"]).drop("salt_")


def give_back() -> None:
    """Returns what a Python worker has freed to the machine: workers are kept from task to task
    and from stage to stage, and so would their largest size be."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return  # another C library


def tidy(run):
    """A mapInArrow function that gives back what it used when its task ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def hot_join(many: DataFrame, one: DataFrame, key: str, size: str, total: int, share: int = 1000) -> DataFrame:
    """many joined with one, which has a row a key and tells by `size` how many rows of `many` have
    it, of `total`. Keys with over 1 / share of all rows, of which there are fewer than `share`,
    are broadcast; their rows are not moved."""
    hot = F.col(size) * share > total
    rest = many.join(F.broadcast(one.where(hot).select(key)), key, "left_anti").join(one.where(~hot), key)
    return many.join(F.broadcast(one.where(hot)), key).unionByName(rest)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that the table does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def held_out(column: str, mod: int, at: int = 2):
    """Whether crc32 of the id as text, modulo mod, is `at`."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % mod == at, F.lit(False))
