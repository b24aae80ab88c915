"""Best-fit packing of token pieces into sequences by minimum bin slack."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright.llm.common import by_bytes, stored, table, texts
from pairwright.llm.tokenization import id_coder

CAPACITY = 2048
#: The id behind every document.
END = 0
#: Pieces packed together; a group has that many on average at any size of the input.
GROUP_PIECES = 4096
BATCH_BYTES = 1 << 20

_PIECES = "doc_id long, piece int, start long, length long, ids binary"


def token_pieces(
    docs: DataFrame, *, path: str | None = None, capacity: int = CAPACITY, end: int = END
) -> DataFrame:
    """Each document's ids and the end, cut into pieces: doc_id, piece, start, length, ids.

    Only documents of more than ``capacity`` ids are cut; the first piece takes the
    remainder, all others are full. ``ids`` are little-endian unsigned 32-bit numbers.
    An empty or null text is the one id ``end``. Repeated rows each have pieces; null
    ids stay null.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    tail = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = id_coder(path)
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            rows: list[tuple] = []
            for doc, found in zip(
                batch.column("doc_id").to_pylist(), coder(batch.column("text").to_pylist())
            ):
                ids = b"".join(found) + tail
                n = len(ids) // 4
                starts = [0] if n <= capacity else [*range(n % capacity or capacity, n, capacity)]
                if starts[0]:
                    starts.insert(0, 0)
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                    rows.append((doc, k, a, b - a, ids[4 * a : 4 * b]))
            columns = list(zip(*rows))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["doc_id", "piece", "start", "length", "ids"],
            )

    return texts(docs).mapInArrow(cut, _PIECES)


def fullest(room: int, held: np.ndarray) -> list[int]:
    """Lengths from stock with the greatest sum of at most ``room``.

    ``held[n]`` counts the items of length n that are left. Bit s of the reachable set
    says that some items have the sum s; lengths join from the longest on, and the
    search ends once ``room`` itself is reached.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    lengths = np.flatnonzero(held[1 : room + 1]) + 1
    for length in lengths[::-1].tolist():
        for _ in range(min(int(held[length]), room // length)):
            wider = reach | ((reach << length) & mask)
            if wider == reach:
                break
            steps.append((length, reach))
            reach = wider
        if reach >> room:
            break
    best, chosen = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        if not before >> best & 1:
            chosen.append(length)
            best -= length
    return chosen


def minimum_bin_slack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of every item; each bin is the fullest its longest item allows."""
    stock: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i, length in enumerate(lengths.tolist()):
        stock[length].append(i)
    held = np.array([len(s) for s in stock])
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    number, longest = 0, capacity
    while True:
        while longest and not held[longest]:
            longest -= 1
        if not longest:
            return bins, offsets
        held[longest] -= 1
        chosen = [longest]
        if longest < capacity:
            chosen += fullest(capacity - longest, held)
        at = 0
        for k, length in enumerate(chosen):
            if k:
                held[length] -= 1
            i = stock[length].pop()
            bins[i], offsets[i] = number, at
            at += length
        number += 1


def assign_sequences(
    pieces: DataFrame, *, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES
) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: where each piece lies.

    Pieces are dealt by a hash of id and piece over as many groups as give
    ``group_pieces`` each, and every group is packed by itself, so no task sees more
    than a group and a hot document or source spreads. ``pieces`` is read twice and
    should be a stored table. Equal lengths and repeated rows are ordinary items, an
    empty table gives an empty one; every other column stays as it is.
    """
    groups = max(1, round(pieces.count() / group_pieces))
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    dealt = pieces.select(
        *[F.col(f"`{c}`") for c in names],
        F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).alias("sequence_id"),
    )
    schema = T.StructType([*dealt.schema.fields, T.StructField("offset", T.LongType())])

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets = minimum_bin_slack(group["length"].to_numpy(), capacity)
        number = group["sequence_id"].to_numpy() * (1 << 32) + bins
        at = group.schema.get_field_index("sequence_id")
        return group.set_column(at, "sequence_id", pa.array(number)).append_column(
            "offset", pa.array(offsets)
        )

    return dealt.groupBy("sequence_id").applyInArrow(pack, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed token sequences themselves: sequence_id, n_tokens, ids.

    A sequence has at most ``capacity`` pieces, which bounds the group.
    """
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (
        packed.groupBy("sequence_id")
        .agg(F.sum("length").alias("n_tokens"), ordered.alias("parts"))
        .select(
            "sequence_id", "n_tokens",
            F.aggregate(
                "parts", F.lit(b"").cast("binary"), lambda done, p: F.concat(done, p["ids"])
            ).alias("ids"),
        )
    )


def packed_documents(docs: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with the crc32 of their ids and their place, for a whole table."""
    pieces = token_pieces(docs, capacity=capacity).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")
    )
    return assign_sequences(stored(pieces, "pieces"), capacity=capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))
