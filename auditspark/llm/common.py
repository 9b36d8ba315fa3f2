"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A dimension table of at most so many rows (of a few numbers each) may be broadcast.
BROADCAST_ROWS = 100_000

#: Bytes of a row group of a written step: a writer holds one, and a reader's batch of wide rows is never larger.
ROW_GROUP = 16 << 20

#: How rows of some hundred kilobytes or more are written: sizes are looked at after each row (else a page and a row group have 100 at
#: least, however wide), row groups are of 4 MB, no value is tried as an entry of a dictionary, and no least and greatest values are
#: noted (a writer holds those of all row groups, whole rows, until its file ends).
WIDE = {
    "parquet.block.size": 4 << 20,
    "parquet.block.size.row.check.min": 1,
    "parquet.page.size.row.check.min": 1,
    "parquet.enable.dictionary": False,
    "parquet.column.statistics.enabled": False,
    "parquet.size.statistics.enabled": False,
}

#: Bytes of a batch of rows on its way to Python (Spark's 64 MB is a whole split of texts): JVM and worker hold a batch or two each.
BATCH = 4 << 20

#: ASCII white space, as a regular expression class, and its complement: a word.
WORD = r"[^\x20\x09-\x0D]+"

_folders: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``, or, where it is unset in local mode, a new one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="auditspark-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def small_batches(df: DataFrame) -> None:
    """Rows go to Python in batches of about BATCH bytes (or one longer row) from now on, unless the session sets a size itself."""
    conf, size = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(size, None) is None:
        conf.set(size, str(BATCH))


def cut(df: DataFrame, what: str = "step", **options: object) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors cost nothing before it.

    All of an application lies in one folder, which goes when the driver's Python ends; discard() is for what is large.
    options are the Parquet writer's, WIDE for wide rows.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/auditspark-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_remove, spark, folder)
    path = f"{folder}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).options(**options).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.cut_path = path
    return back


def discard(*frames: DataFrame) -> None:
    """Delete what cut() wrote, once nothing reads it any more."""
    for df in frames:
        _remove(df.sparkSession, df.cut_path)


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None:  # else the session is stopped, and the folder is left to whoever owns it
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are within BROADCAST_ROWS, else df for a shuffled join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def hash_bucket(col: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")
