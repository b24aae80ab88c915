"""Byte-level BPE encoding and decoding over the distinct words of the whole corpus."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright.llm.common import stored_by, table
from pairwright.llm.dictionary import (
    answered, blocks, buckets_for, rows_of, unzip_numbers, unzip_words,
    zip_numbers,
)

_ANSWERS = "block string, numbers binary, lengths binary, values binary"


def vocabulary_file() -> str:
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        pairs = (line.split() for line in file if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


@lru_cache(maxsize=2)
def _word_encoder(path: str, pattern: str):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})
    return own.encode_ordinary


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The token-byte table; an id without a token has no bytes."""
    held = ranks(path)
    out = [b""] * (max(held.values(), default=-1) + 1)
    for token, rank in held.items():
        out[rank] = token
    return out


@lru_cache(maxsize=2)
def _words(pattern: str):
    return regex.compile(pattern).findall


def encode(
    docs: DataFrame, *, path: str | None = None, pattern: str | None = None,
    text: str = "text", into: str = "ids",
) -> DataFrame:
    """``docs`` without the text, and its token ids in ``into`` (array of int).

    Pre-tokens are exploded block by block, with their positions kept as the block's word
    order; distinct ones meet in hash buckets, where each is encoded once; the ids return
    to the blocks that asked, and the block reassembles its texts by position. A frequent
    word is one entry per block, so no bucket grows with its occurrences.

    Null and empty texts have no ids; repeated rows are encoded each; other columns stay
    as they are, null or not. A column already called ``into`` is replaced. The blocks
    are stored in the shared folder, as every job here reads the same ones.
    """
    path = path or vocabulary_file()
    pattern = pattern or public_tokenizers.PATTERN
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != into])
    buckets = buckets_for(docs)
    cut = stored_by(
        blocks(docs, lambda t: _words(pattern)(t), buckets=buckets, text=text),
        "words", "block", buckets,
    )

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, known = _word_encoder(path, pattern), {}
        for batch in batches:
            lengths, values = [], []
            for data in batch.column("words").to_pylist():
                ids = []
                for word in unzip_words(data):
                    found = known.get(word)
                    if found is None:
                        found = known[word] = encoder(word.decode())
                    ids.append(found)
                lengths.append(zip_numbers(np.array([len(i) for i in ids])))
                values.append(zip_numbers(np.array([x for i in ids for x in i])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("numbers"), pa.array(lengths, pa.binary()), pa.array(values, pa.binary())],
                ["block", "numbers", "lengths", "values"],
            )

    packs = cut.where("bucket >= 0").select("block", "bucket", "words", "numbers")
    answers = packs.repartition("bucket").drop("bucket").mapInArrow(code, _ANSWERS)
    kept = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*kept, T.StructField(into, T.ArrayType(T.IntegerType()))])
    names = [f.name for f in kept]

    def reassemble(order: pa.Table, found: pa.Table) -> pa.Table:
        length, value = answered(
            zip(*(found.column(c).to_pylist() for c in ("numbers", "lengths", "values")))
        )
        starts = np.cumsum(length) - length
        out = []
        for words, rows in zip(order.column("order").to_pylist(), order.column("rows").to_pylist()):
            number, held = unzip_numbers(words), rows_of(rows)
            stops = np.cumsum(held.column("_words").to_numpy())
            parts = []
            for a, b in zip([0, *stops[:-1]], stops):
                mine = number[a:b]
                many = length[mine]
                ends = np.cumsum(many)
                total = int(ends[-1]) if len(ends) else 0
                at = np.arange(total) + np.repeat(starts[mine] - (ends - many), many)
                parts.append(value[at].astype(np.int32))
            offsets = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int32), *parts])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            columns = [held.column(n) for n in names]
            out.append(pa.table([*columns, ids], names=[*names, into]))
        return pa.concat_tables(out)

    return (
        cut.where("bucket < 0").select("block", "order", "rows").groupBy("block")
        .cogroup(answers.groupBy("block")).applyInArrow(reassemble, schema)
    )


def decode(encoded: DataFrame, *, path: str | None = None, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that its ids stand for in ``into`` (binary).

    Looks every id up in the token-byte table, whose size the vocabulary fixes. Null ids
    arrays decode to no bytes.
    """
    path = path or vocabulary_file()
    names = [c for c in encoded.columns if c != into]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = token_bytes(path).__getitem__
        for batch in batches:
            # row by row: lists of whole batches would take many times their size
            rows = (i.values for i in batch.column(ids))
            found = [b"" if r is None else b"".join(map(token, r.to_pylist())) for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*names, into])

    source = encoded.select(*[F.col(f"`{c}`") for c in names])
    return source.mapInArrow(look_up, T.StructType([*source.schema.fields, T.StructField(into, T.BinaryType())]))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return decode(encode(docs)).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
