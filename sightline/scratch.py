"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most so many rows, and of so many bytes where it is stored, is small enough to broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20
#: What rounds or batches send through the driver adds up, so a table that each of them makes may have fewer rows.
REPEATED_ROWS = 20_000
#: How a table of known size is cut into files.
PART_ROWS, LEAST_PARTS = 200_000, 8
_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in
    sessions without it on one machine (tests) a temporary folder. On a cluster
    a folder of one machine would split the data, so its absence is an error there."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _ROOTS:
            _ROOTS[app] = tempfile.mkdtemp(prefix="sightline-")
        base = _ROOTS[app]
    return f"{base.rstrip('/')}/sightline"


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def scratch(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it again.

    rows, where known, says how many rows df has at most; a small table is then
    written in few files, PART_ROWS rows to each, whatever the number of
    shuffle partitions, though never by fewer than LEAST_PARTS tasks.

    This cuts the lineage: a lost executor costs the tasks that ran on it, not
    the steps before. A table read again also carries no partitioning, so a
    join on it gets exchanges that adaptive execution can split when skewed.
    """
    path = shared_path(df.sparkSession, label)
    if rows is not None:
        df = df.coalesce(max(LEAST_PARTS, -(-rows // PART_ROWS)))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int, *columns: str, each: int = PART_ROWS) -> DataFrame:
    """df dealt out by the columns to so many tasks that one has some each of its rows, however many rows there are.

    A number of partitions that the session fixes, or that adaptive execution
    finds from compressed bytes, makes what a task holds grow with the input.
    """
    return df.repartition(max(1, -(-rows // each)), *columns)


def discard_scratch(spark: SparkSession) -> None:
    """Delete every scratch table and file; call it when results are stored."""
    root = spark._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


def stored_bytes(table: DataFrame, unknown: int = 1 << 62) -> int:
    """How many bytes the files or local rows have that table is made from; only sizes are looked up.

    A source that cannot tell its size counts as unknown.
    """
    leaves = table._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(unknown if size >= 1 << 62 else size for size in sizes)


def lookup(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """small with a broadcast hint if it is a scratch table of at most limit rows and BROADCAST_BYTES bytes."""
    return F.broadcast(small) if stored_bytes(small) <= BROADCAST_BYTES and small.count() <= limit else small


def met(small: DataFrame, limit: int | None = None) -> DataFrame:
    """small for a join that every round or batch makes: broadcast as by lookup up to limit (REPEATED_ROWS) rows,
    else always shuffled; Spark alone would broadcast a table whose files are small, however many rows they hold."""
    limit = REPEATED_ROWS if limit is None else limit
    return F.broadcast(small) if stored_bytes(small) <= BROADCAST_BYTES and small.count() <= limit else small.hint("merge")
