"""Reading the corpus, shared tables and small helpers for the operators here."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What SQL calls a word here: a run without ASCII white space.
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` as long and the whole text, empty where it is null."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text")).alias("text")
    )


def text_of(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Only where the session names none and everything runs in this process, as in
    tests, a folder of our own; on a cluster that would lose rows, so it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    application = spark.sparkContext.applicationId
    if application not in _OWN:
        _OWN[application] = tempfile.mkdtemp(prefix="llm-shared-")
    return _OWN[application]


def stored(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written as a Parquet table in the shared folder, and read again.

    Cuts the lineage: a lost executor costs the tasks it was running, not the
    steps before. The table goes when the driver's process ends.
    """
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(frame.schema).parquet(path)


def stored_by(frame: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """Like ``stored``, bucketed: joins and groups by ``column`` read it without a shuffle."""
    spark = frame.sparkSession
    table_name = f"llm_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table_name}"
    frame.write.bucketBy(buckets, column).option("path", path).saveAsTable(table_name)
    atexit.register(_drop, spark, table_name, path)
    return spark.table(table_name)


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is None:  # the session has ended
        return
    jvm = context._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def _drop(spark: SparkSession, name: str, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        _remove(spark, path)


def by_bytes(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, each of about ``limit`` bytes of the text column or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        yield batch.slice(start)


def quiet_tokenizers() -> None:
    """One task, one core: the library must not start threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
