"""Token counts: how many tokens every whole text has, without keeping the tokens."""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.common import by_bytes, table, text_of
from pairwright.llm.tokenization import length_coder

BATCH_BYTES = 1 << 20
LIMIT = 1024


def token_counts(
    docs: DataFrame, *, path: str | None = None, text: str = "text", into: str = "n_tokens",
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """``docs`` without the text, and the number of tokens of each text in ``into``.

    One pass without a shuffle. The Arrow function cuts what it gets into batches of
    about ``batch_bytes`` of text, cuts texts at safe boundaries, and hands the library
    the distinct units of a batch it hasn't met; only lengths come back, so a text of
    any size needs no more than its units' lengths.

    Null and empty texts have 0 tokens; special strings inside texts are one token, as
    the library has it by default; repeated rows are counted each. Other columns stay,
    also null ones; a column that is already called ``into`` is replaced.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    rest = [c for c in docs.columns if c not in (text, into)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = length_coder(path)
        for batch in by_bytes(batches, text, batch_bytes):
            lengths = [sum(found) for found in coder(batch.column(text).to_pylist())]
            columns = [batch.column(c) for c in rest] + [pa.array(lengths, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*rest, into])

    source = docs.select(*[F.col(f"`{c}`") for c in rest], text_of(F.col(text)).alias(text))
    schema = source.select(*[F.col(f"`{c}`") for c in rest]).schema.add(into, "long")
    return source.mapInArrow(count, schema)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.octet_length(text_of(F.col("text"))).cast("long").alias("n_bytes"),
        "text",
    )
    return token_counts(docs).withColumn("over_limit", F.col("n_tokens") > LIMIT)
