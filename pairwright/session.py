"""Session helpers: shipping the package to the executors, reading shared folders."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for the UDFs."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="pairwright-")) / "pairwright.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


_OWN: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names.

    Only where none is named and everything runs in this process, as in tests, one of our
    own; on a cluster each executor would write to its own disk, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = tempfile.mkdtemp(prefix="pairwright-checkpoint-")
    return _OWN[context.applicationId]


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is None:  # the session has ended
        return
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def scratch_path(spark: SparkSession) -> str:
    """A new place in the shared checkpoint folder, deleted when the driver's process ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/pairwright-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def checkpointed(frame: DataFrame) -> DataFrame:
    """Cut the lineage of ``frame`` by writing it to the shared checkpoint folder.

    A parquet table rather than an RDD checkpoint: later reads prune columns,
    push filters down, and know the table's size when they choose a join. It is
    deleted when the driver's process ends.
    """
    spark = frame.sparkSession
    path = scratch_path(spark)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def bucketed(frame: DataFrame, buckets: int, *keys: str) -> DataFrame:
    """Like ``checkpointed``, in buckets: joins by the keys read it without a shuffle.

    ``frame`` should lie by the keys in so many partitions; then each task writes one bucket.
    """
    spark = frame.sparkSession
    path = scratch_path(spark)
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    frame.write.bucketBy(buckets, *keys).option("path", path).saveAsTable(name)
    atexit.register(_forget, spark, name)
    return spark.table(name)


def _forget(spark: SparkSession, name: str) -> None:
    if spark.sparkContext._jsc is not None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
