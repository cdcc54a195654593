"""The folder that all machines of a cluster share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the checkpoint folder that the context has. Where neither is set, a new folder on this
    machine, but on a local master alone: elsewhere executors could not reach it, so that is an error."""
    context = spark.sparkContext
    own = context._jsc.sc().getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None and own.isDefined():
        return own.get()
    if found is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="terrafold-")
    if own.isEmpty():
        context.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing is at yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Delete what is at a path that new_path gave, through the file system that holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path, on the file system that holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def state(spark: SparkSession, *paths: str) -> str:
    """A digest of what lies at the paths: names, sizes and times of change."""
    facts = []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        total = fs.getContentSummary(at)
        facts.append(f"{path} {total.getLength()} {total.getFileCount()} {fs.getFileStatus(at).getModificationTime()}")
    return hashlib.sha256("\n".join(facts).encode()).hexdigest()[:24]


#: Where the tables of an application are.
_MADE: dict[tuple[str, str], str] = {}


def bucketed(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """df as a table of that name in the shared folder, in buckets by keys, sorted in each; a table of the name that this
    application has already is taken as it is, unless its files are gone. Tables in as many buckets by the same keys are
    joined by them, and grouped by them, without a shuffle. Rows are dealt by the keys first, so a bucket is one file."""
    spark = df.sparkSession
    own = spark.sparkContext.applicationId, name
    if own not in _MADE or not exists(spark, f"{_MADE[own]}/_SUCCESS"):
        n, path = int(spark.conf.get("spark.sql.shuffle.partitions")), new_path(spark, name)
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")
        df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
        _MADE[own] = path
    return spark.table(name)
