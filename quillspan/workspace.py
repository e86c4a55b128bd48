"""Where jobs keep intermediate tables, and helpers that cut lineage through them.

Executors can be lost at any time, so a cut always goes to the folder that
``spark.checkpoint.dir`` names (shared by driver and executors).  Only a local
master may fall back to a folder of this machine.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LOCAL_FALLBACK = "file:///tmp/checkpoints/quillspan"
_written: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder of this session; local masters get a default one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return LOCAL_FALLBACK


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def cleanup(spark: SparkSession) -> int:
    """Delete what this process has written to the shared folder; for when results have been read or written. Returns the number of folders."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    while _written:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        done += bool(path.getFileSystem(conf).delete(path, True))
    return done


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, which cuts its lineage."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, label: str, n: int | None = None, lying: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder as a table in ``n`` hash buckets of ``column``, one for each shuffle partition unless given.

    Joins on ``column`` read it where it lies: only the other side moves.  Rows
    that come from such buckets are written as they are (``lying``).  The table
    is known to this session alone; cleanup() deletes its files.
    """
    spark = df.sparkSession
    n = n or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = fresh_path(spark, label)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    written = df.write.bucketBy(n, column) if lying else df.repartition(n, column).write.bucketBy(n, column).sortBy(column)
    written.option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; works with any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


BATCH_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a batch of rows that goes to Python. Spark's own 64 MB hold 10,000 texts, which JVM and worker have several times over.
BATCH_BYTES = 2 << 20


def in_batches(df: DataFrame, work, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow(work, schema)`` over batches of about ``BATCH_BYTES`` (a larger row is a batch of its own).

    The bound is a setting of the session and stays there, as plans read it when
    they run; one that the session has set itself holds.
    """
    conf = df.sparkSession.conf
    if BATCH_BOUND not in conf.getAll:
        conf.set(BATCH_BOUND, str(BATCH_BYTES))
    return df.mapInArrow(work, schema)


#: Rows of keys that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def few(keys: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``keys``, a written table of narrow rows, with a broadcast hint where its count allows it."""
    return F.broadcast(keys) if keys.count() <= rows else keys


def spread(df: DataFrame) -> DataFrame:
    """A scan in fewer partitions than there are cores is dealt over them; a larger one stays as it is. For heavy work per row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
