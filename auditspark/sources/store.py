"""Keyed tables of latest values as plain Parquet: a write appends a version, a read takes the last one of each key.

Appending is safe against lost tasks and never rewrites what is there; compact() rewrites a table when versions pile up.
A SlicedStore keeps its tables in folders by a hash of the key, so that a lookup lists and reads one folder's files.
"""

from __future__ import annotations

import atexit
import collections
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(versions: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """Of each key the values of the last version, created at the first. Pre-aggregated before the shuffle."""
    rest = [x for x in versions.columns if x not in (key, version)]
    picked = versions.groupBy(key).agg(F.max(F.struct(version, *rest)).alias("r"), F.min(version).alias("created"))
    return picked.select(key, *[F.col(f"r.{x}").alias(x) for x in rest], F.col("created"), F.col(f"r.{version}").alias("updated"))


class Store:
    """Tables under one folder, each with the columns key, version and its own."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str]):
        self.spark, self.root, self.schemas = spark, root, schemas

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def upsert(self, table: str, rows: DataFrame, version) -> None:
        rows.withColumn("version", F.lit(version).cast("timestamp")).write.mode("append").parquet(self._path(table))

    def versions(self, table: str) -> DataFrame:
        schema = f"{self.schemas[table]}, version timestamp"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(table))
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(self._path(table)) if there else self.spark.createDataFrame([], schema)

    def read(self, table: str, key: str = "id") -> DataFrame:
        return latest(self.versions(table), key)

    def get(self, table: str, value, key: str = "id") -> DataFrame:
        """One key's row; the filter reaches the files."""
        return latest(self.versions(table).filter(F.col(key) == value), key)

    def compact(self, table: str, to: str, key: str = "id") -> DataFrame:
        self.read(table, key).write.parquet(to)
        return self.spark.read.parquet(to)


class SlicedStore(Store):
    """Tables of (key, own columns, created, version), in `slices` folders by a hash of the key.

    An upsert reduces its rows to one a key before it shuffles them to their slices, and appends one file to each. fold()
    rewrites the slices of more than one file by dynamic partition overwrite, which Spark stages and then moves: lost executors
    cost nothing, but a driver that stops while slices are moved leaves those it hasn't moved in the staging folder. Writers
    of one table must not fold at the same time. A null key is a key. Equal upserts may be repeated: nothing changes.
    """

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str], slices: int = 64, key: str = "id"):
        super().__init__(spark, root, schemas)
        self.slices, self.key = slices, key

    def _slice(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.slices)).cast("int")

    def upsert(self, table: str, rows: DataFrame, version) -> None:
        """Append rows at a version: a value, or a column of rows for versions of their own. Other columns are left out."""
        own = self.spark.createDataFrame([], self.schemas[table]).columns
        kept = rows.select(*own, (version if isinstance(version, Column) else F.lit(version)).cast("timestamp").alias("version"))
        self._write(table, latest(kept, self.key).withColumnRenamed("updated", "version"), "append")

    def _write(self, table: str, rows: DataFrame, mode: str) -> None:
        placed = rows.withColumn("slice", self._slice(F.col(self.key))).repartition(self.slices, "slice")
        placed.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("slice").parquet(self._path(table))

    def versions(self, table: str) -> DataFrame:
        schema = f"{self.schemas[table]}, created timestamp, version timestamp, slice int"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(table))
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(self._path(table)) if there else self.spark.createDataFrame([], schema)

    def _folded(self, versions: DataFrame) -> DataFrame:
        first = versions.drop("slice")
        own = [x for x in first.columns if x not in (self.key, "created", "version")]
        picked = first.groupBy(self.key).agg(F.max(F.struct("version", *own)).alias("r"), F.min("created").alias("created"))
        return picked.select(self.key, *[F.col(f"r.{x}").alias(x) for x in own], "created", F.col("r.version").alias("updated"))

    def read(self, table: str, key: str | None = None) -> DataFrame:
        return self._folded(self.versions(table))

    def get(self, table: str, value, key: str | None = None) -> DataFrame:
        """The row of one key, or none; only the files of its slice are read."""
        versions = self.versions(table)
        value = F.lit(value).cast(dict(versions.dtypes)[self.key])
        return self._folded(versions.filter((F.col("slice") == self._slice(value)) & F.col(self.key).eqNullSafe(value)))

    def get_many(self, table: str, keys: DataFrame) -> DataFrame:
        """The rows of keys, a table with the key's column; only slices that hold one are read, if they aren't all. What
        reaches the driver is one number for each of these slices."""
        versions = self.versions(table)
        asked = keys.select(F.col(self.key).cast(dict(versions.dtypes)[self.key]).alias(self.key)).distinct()
        hit = [r[0] for r in asked.select(self._slice(F.col(self.key))).distinct().collect()]
        found = versions.filter(F.col("slice").isin(hit)) if len(hit) < self.slices else versions
        return self._folded(found.alias("v").join(asked.alias("a"), F.col(f"v.{self.key}").eqNullSafe(F.col(f"a.{self.key}")), "left_semi"))

    def fold(self, table: str) -> int:
        """Rewrite slices of more than one file to one row a key; how many slices these were."""
        versions = self.versions(table)
        files = collections.Counter(int(m[1]) for f in versions.inputFiles() if (m := re.search(r"/slice=(\d+)/", f)))
        many = sorted(s for s, n in files.items() if n > 1)
        if many:
            folded = self._folded(versions.filter(F.col("slice").isin(many))).withColumnRenamed("updated", "version")
            self._write(table, folded, "overwrite")
        return len(many)


def scratch_folder(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; a local one only where that is unset and Spark local.
    It goes when the driver's Python ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="auditspark-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    path = f"{root}/auditspark-{spark.sparkContext.applicationId}-{what}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None:
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def resolve(ids: DataFrame, submissions: DataFrame, source: DataFrame, progress: DataFrame, runs: DataFrame) -> DataFrame:
    """Each of ids (id, each once) with its claim: a submission counts before a source claim of that id, an id of neither has
    no origin. submissions and source have the same columns, an id at most once in each; step is 0 and verdict null where
    progress (id, step) and runs (id, verdict) have none. An id is looked for in tables that were pruned by get_many()."""
    own = [x for x in submissions.columns if x != "id"]
    ranked = lambda df, rank: df.select("id", F.struct(F.lit(rank).alias("rank"), F.struct(*own).alias("row")).alias("r"))
    both = ranked(submissions, 0).unionByName(ranked(source, 1)).join(ids.select("id"), "id", "left_semi")
    first = both.groupBy("id").agg(F.min_by("r", F.col("r.rank")).alias("r"))
    out = ids.select("id").join(first, "id", "left").join(progress.select("id", "step"), "id", "left").join(runs.select("id", "verdict"), "id", "left")
    origin = F.when(F.col("r.rank") == 0, "submitted").when(F.col("r.rank") == 1, "erp")
    return out.select("id", origin.alias("origin"), *[F.col(f"r.row.{x}").alias(x) for x in own], F.coalesce("step", F.lit(0)).alias("step"), "verdict")


def listing(submissions: DataFrame, source: DataFrame, progress: DataFrame, runs: DataFrame) -> DataFrame:
    """Submissions, newest first, then source claims, each with step (0 if none) and verdict. A submission hides a source
    claim of its id. Columns: id, created (null for source claims)."""
    mine = submissions.select("id", "created", F.lit("submitted").alias("origin"))
    theirs = source.join(submissions.select("id"), "id", "left_anti").select("id", F.lit(None).cast(dict(mine.dtypes)["created"]).alias("created"), F.lit("erp").alias("origin"))
    both = mine.unionByName(theirs).join(progress.select("id", "step"), "id", "left").join(runs.select("id", "verdict"), "id", "left")
    return both.withColumn("step", F.coalesce("step", F.lit(0))).orderBy(F.col("origin").desc(), F.col("created").desc(), F.col("id").desc())


def next_id(ids: DataFrame, prefix: str = "VRM-9", floor: int = 900_000) -> DataFrame:
    """One row: the next id of the series, from the largest that has its form."""
    number = F.regexp_extract("id", r"^VRM-(9[0-9]{5})$", 1)
    top = ids.filter(F.col("id").startswith(prefix) & (number != "")).agg(F.coalesce(F.max(number.cast("int")), F.lit(floor)).alias("n"))
    return top.select(F.concat(F.lit("VRM-"), (F.col("n") + 1).cast("string")).alias("next_id"))


def replace_files(files: DataFrame, new: DataFrame) -> DataFrame:
    """files and new (id, slot, path): a new file replaces its slot's; a certificate and a delivery note replace one another."""
    group = F.when(F.col("slot").isin("coc", "delivery_note"), "acceptance").otherwise(F.col("slot"))
    gone = new.select("id", group.alias("g")).distinct()
    kept = files.withColumn("g", group).join(gone, ["id", "g"], "left_anti").drop("g")
    return kept.unionByName(new)


def patch(rows: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """rows with the values of changes that aren't null."""
    names = [x for x in changes.columns if x != key]
    new = changes.select(key, *[F.col(x).alias(f"_new_{x}") for x in names])
    out = rows.join(new, key, "left")
    return out.select(*[F.coalesce(f"_new_{x}", x).alias(x) if x in names else F.col(x) for x in rows.columns])


def export_manifest(files: DataFrame, order=("invoice", "contract_boq", "coc", "delivery_note", "other")) -> DataFrame:
    """files (id, pos, doc_type, name): the names in an archive, in order; contract files are shared and keep their names, and
    a name that is taken gets the number of names before it."""
    from pyspark.sql import Window

    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("doc_type")), F.lit(0)), F.lit(9))
    named = files.withColumn("rank", rank).withColumn("entry", F.when(F.col("doc_type") == "contract_boq", F.col("name")).otherwise(F.concat_ws("_", "id", "name")))
    by = Window.partitionBy("id", "entry").orderBy("rank", "pos")
    stem, suffix = F.regexp_extract("entry", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("entry", r"^(.*?)(\.[^.]*)?$", 2)
    again = F.row_number().over(by)
    out = named.withColumn("nth", again).withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy("rank", "pos")))
    return out.select("id", "at", "doc_type", "name", F.when(F.col("nth") == 1, F.col("entry")).otherwise(F.concat(stem, F.lit("_"), (F.col("at") - 1).cast("string"), suffix)).alias("entry"))
