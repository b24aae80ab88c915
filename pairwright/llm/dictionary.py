"""The corpus as numbers of distinct words, block by block.

A *block* is a run of rows of a task, of about as many bytes of text as asked for. It
keeps the order of its words as numbers into its own list of distinct words; the distinct
words travel in *packs*, one for each hash bucket, so that a bucket can look at every
distinct word of the corpus once and answer each block. What is shuffled is the distinct
words of every block, not its running words.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import by_bytes, text_of

BLOCK_BYTES = 16 << 20
LEAST_BUCKETS = 64

BLOCKS = (
    "block string, bucket int, words binary, numbers binary, counts binary, order binary, rows binary"
)


def zip_numbers(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, byte plane after byte plane, which compresses well."""
    planes = np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(planes.tobytes(), 7)


def unzip_numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def zip_words(words: list[bytes]) -> bytes:
    lengths = np.array([len(w) for w in words], "<u4").tobytes()
    return zstandard.compress(len(words).to_bytes(4, "little") + lengths + b"".join(words), 9)


def unzip_words(data: bytes) -> list[bytes]:
    data = zstandard.decompress(data)
    n = int.from_bytes(data[:4], "little")
    ends = (4 + 4 * n + np.cumsum(np.frombuffer(data, "<u4", n, 4), dtype=np.int64)).tolist()
    return [data[a:b] for a, b in zip([4 + 4 * n, *ends[:-1]], ends)]


class Numbered(dict):
    """Numbers for keys in the order in which they are first met."""

    def __missing__(self, key: object) -> int:
        number = self[key] = len(self)
        return number


def buckets_for(docs: DataFrame) -> int:
    """As many buckets as the session shuffles into, so that they grow with the data."""
    return max(LEAST_BUCKETS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def blocks(
    docs: DataFrame, split: Callable[[str], list], *, buckets: int, text: str = "text",
    counted: str | None = None, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Blocks of ``docs``: a row with the word order and the other columns (bucket -1),
    and a pack of distinct words for each bucket.

    ``split`` gives a text's words, as bytes or text. ``counted`` names a boolean column:
    packs then hold how often their words occur in its true rows. The names of blocks are
    drawn at random, so the result has to be stored before it is read by several jobs.
    """
    rest = [c for c in docs.columns if c != text]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text, block_bytes):
            number = Numbered()
            orders = [
                np.fromiter(map(number.__getitem__, words), np.uint32, len(words))
                for words in map(split, batch.column(text).to_pylist())
            ]
            words = [w if isinstance(w, bytes) else w.encode() for w in number]
            counts = np.zeros(len(words), np.int64)
            if counted is not None:
                learned = [o for o, yes in zip(orders, batch.column(counted).to_pylist()) if yes]
                if learned:
                    counts = np.bincount(np.concatenate(learned), minlength=len(words))
            name = uuid.uuid4().hex
            rows = batch.select(rest).append_column(
                "_words", pa.array([len(o) for o in orders], pa.int64())
            ) if rest else pa.record_batch({"_words": pa.array([len(o) for o in orders], pa.int64())})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as writer:
                writer.write_batch(rows)
            order = zip_numbers(np.concatenate(orders) if orders else np.zeros(0, np.uint32))
            out = [(name, -1, None, None, None, order, zstandard.compress(sink.getvalue().to_pybytes()))]
            place = np.array([crc32(w) % buckets for w in words], np.int64)
            by_bucket = np.argsort(place, kind="stable")
            cuts = np.searchsorted(place[by_bucket], np.arange(buckets + 1))
            for bucket in range(buckets):
                mine = by_bucket[cuts[bucket] : cuts[bucket + 1]]
                if len(mine):
                    out.append((
                        name, bucket, zip_words([words[i] for i in mine.tolist()]),
                        zip_numbers(mine), zip_numbers(counts[mine]), None, None,
                    ))
            kinds = [pa.string(), pa.int32(), *[pa.binary()] * 5]
            names = ["block", "bucket", "words", "numbers", "counts", "order", "rows"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out), kinds)], names
            )

    source = docs.select(*[F.col(f"`{c}`") for c in rest], text_of(F.col(text)).alias(text))
    return source.mapInArrow(numbered, BLOCKS)


def rows_of(data: bytes) -> pa.Table:
    """The other columns of a block's rows, and ``_words``, how many words each has."""
    with pa.ipc.open_stream(zstandard.decompress(data)) as reader:
        return reader.read_all()


def answered(packs: Iterable[tuple[bytes, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """For every number of a block, how many values it was answered with, and all values.

    ``packs`` are (numbers, lengths, values), each zipped; the values come back in the
    order of the numbers.
    """
    numbers, lengths, values = [], [], []
    for n, k, v in packs:
        numbers.append(unzip_numbers(n))
        lengths.append(unzip_numbers(k))
        values.append(unzip_numbers(v))
    if not numbers:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    number, length = np.concatenate(numbers), np.concatenate(lengths).astype(np.int64)
    value = np.concatenate(values)
    starts = np.cumsum(length) - length
    order = np.argsort(number, kind="stable")
    length, starts = length[order], starts[order]
    ends = np.cumsum(length)
    at = np.arange(len(value)) + np.repeat(starts - (ends - length), length)
    return length, value[at]
