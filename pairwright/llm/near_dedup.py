"""Near-duplicates: MinHash signatures joined under Hamming distance through chunk indexes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.common import by_bytes, stored, table, text_of

WORDS = 5
#: Two documents are linked from so many hundredths of similarity on.
SIMILARITY = 75
_BATCH = 4 << 20
_RUN = 4 << 20


@dataclass(frozen=True)
class Scheme:
    """Signatures of ``chunks * width`` b-bit values, b = 16, cut into chunks.

    Pairs at a Hamming distance of at most ``chunks * (errors + 1) - 1`` have a chunk with
    at most ``errors`` different values, by the pigeonhole principle; a key for every way
    of leaving ``errors`` values of a chunk out finds all of them. A pair of similarity
    0.75 is missed only if every chunk has more errors: (1 - .75**5 - 5 * .25 * .75**4) ** 16,
    which is 1e-7, for the values below.
    """

    chunks: int = 16
    width: int = 5
    errors: int = 1
    #: Signatures that agree less than this can't be of similar documents (five sigma).
    least_agreement: float = 0.5

    @property
    def values(self) -> int:
        return self.chunks * self.width

    @property
    def kept(self) -> list[tuple[int, ...]]:
        return list(combinations(range(self.width), self.width - self.errors))


SCHEME = Scheme()

_RNG = np.random.Generator(np.random.PCG64(5))
_BYTE = _RNG.integers(0, 1 << 64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            grown = np.full(max(n, 2 * len(_POWERS[k])), base, np.uint64)
            grown[0] = 1
            _POWERS[k] = np.multiply.accumulate(grown)
    return _POWERS


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _run_shingles(words: list[bytes], width: int) -> np.ndarray:
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[:-1]][: len(words) - width + 1]
    ends = ends[width - 1 :]
    return _mixed((sums[ends] - sums[starts]) * inverse[starts])


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def shingles(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of the distinct runs of five words; of all words where there are fewer.

    Hashes are sums over bytes, independent of place, so any run of words can be taken
    alone; long texts go run by run.
    """
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= WORDS:
        return _run_shingles(words, len(words))
    found, start = [], 0
    while start + WORDS <= len(words):
        stop, size = start, 0
        while stop < len(words) and (size < _RUN or stop < start + WORDS):
            size += len(words[stop]) + 1
            stop += 1
        found.append(np.unique(_run_shingles(words[start:stop], WORDS)))
        start = stop - WORDS + 1
    return np.unique(np.concatenate(found)) if len(found) > 1 else found[0]


_MULTIPLIERS = _RNG.integers(0, 1 << 63, 4096, np.uint64) * np.uint64(2) + np.uint64(1)


def signature(hashes: np.ndarray, values: int) -> np.ndarray:
    """b-bit MinHash values (b = 16) of a set of at least one hash."""
    least = np.full(values, np.iinfo(np.uint64).max, np.uint64)
    factor = _MULTIPLIERS[:values, None]
    for i in range(0, len(hashes), 2048):
        np.minimum(least, (factor * hashes[None, i : i + 2048]).min(1), out=least)
    return ((least >> np.uint64(7)) & np.uint64(0xFFFF)).astype("<u2")


def keys_of(signatures: np.ndarray, scheme: Scheme) -> np.ndarray:
    """For each signature a 64-bit key for every chunk and every way to leave values out."""
    wide = signatures.astype(np.uint64).reshape(len(signatures), scheme.chunks, scheme.width)
    out = []
    for slot, kept in enumerate(scheme.kept):
        key = np.zeros(wide.shape[:2], np.uint64)
        for k in kept:
            key = _mixed(key * _BASE + wide[:, :, k] + np.uint64(1))
        place = np.arange(scheme.chunks, dtype=np.uint64) * np.uint64(len(scheme.kept)) + np.uint64(slot)
        out.append(_mixed(key ^ (place * _INVERSE)))
    return np.stack(out, 2).reshape(len(signatures), -1).view(np.int64)


_SIGNED = "doc_id long, digest binary, n_shingles long, signature binary"


def signed(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """doc_id, digest of the word sequence, size of the shingle set, and signature."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", _BATCH):
            digests, sizes, signatures = [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                hashes = shingles(words)
                digests.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                sizes.append(len(hashes))
                signatures.append(signature(hashes, scheme.values).tobytes() if words else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(digests, pa.binary()),
                    pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary()),
                ],
                ["doc_id", "digest", "n_shingles", "signature"],
            )

    source = docs.select("doc_id", text_of(F.col("text")).alias("text"))
    return source.mapInArrow(sign, _SIGNED)


def _keys(nodes: DataFrame, scheme: Scheme) -> DataFrame:
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("node").to_numpy(zero_copy_only=False)
            data = b"".join(batch.column("signature").to_pylist())
            key = keys_of(np.frombuffer(data, "<u2").reshape(len(ids), -1), scheme)
            for i in range(0, len(ids), 1024):
                part = key[i : i + 1024]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.ravel()), pa.array(np.repeat(ids[i : i + 1024], key.shape[1]))],
                    ["key", "node"],
                )

    return nodes.select("node", "signature").mapInArrow(explode, "key long, node long")


def _linked(candidates: DataFrame, node_texts: DataFrame) -> DataFrame:
    """The candidate pairs (a, b) that are similar enough on their full shingle sets."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            first, second = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = []
            for a, left, right in zip(first, batch.column("ta"), batch.column("tb")):
                if last[0] != a:
                    last = (a, shingles(words_of(left.as_py())))
                other = shingles(words_of(right.as_py()))
                both = len(np.intersect1d(last[1], other, assume_unique=True))
                keep.append(100 * both >= SIMILARITY * (len(last[1]) + len(other) - both))
            yield pa.RecordBatch.from_arrays(
                [pa.array(first, pa.int64()), pa.array(second, pa.int64())], ["a", "b"]
            ).filter(pa.array(keep, pa.bool_()))

    texts = node_texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    others = node_texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    pairs = candidates.join(texts, "b").join(others, "a").select("a", "b", "ta", "tb")
    return pairs.mapInArrow(confirm, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the smallest node reachable over the edges (a, b).

    Every round takes the least label of the neighbours and then the label of the label,
    so chains shrink to their halves. Each round is a stored table.
    """
    both = stored(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))),
        "edges",
    )
    labels = stored(
        both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("comp"))
        .select(F.col("a").alias("node"), "comp"),
        "labels",
    )
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy("a").agg(F.min("comp").alias("near"))
        )
        better = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.least("comp", "near").alias("next"), "comp"
        )
        hop = labels.select(F.col("node").alias("next"), F.col("comp").alias("further"))
        moved = stored(
            better.join(hop, "next", "left").select(
                "node", F.least(F.coalesce("further", "next"), "next").alias("next"), "comp"
            ),
            "labels",
        )
        labels = moved.select("node", F.col("next").alias("comp"))
        if moved.where("next <> comp").limit(1).count() == 0:
            return labels


#: Keys of more nodes than this are dense: their nodes are compared family by family.
DENSE = 64
_BLOCK = 512


def _by_group(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of sorted batches, cut so that no group of equal ``names`` is parted."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.concat_tables([*([held] if held else []), pa.Table.from_batches([batch])])
        last = tuple(held[c][-1] for c in names)
        n = held.num_rows
        while n and tuple(held[c][n - 1] for c in names) == last:
            n -= 1
        if n:
            yield held.slice(0, n)
            held = held.slice(n)
    if held is not None:
        yield held


def _bounds(*columns: np.ndarray) -> list[tuple[int, int]]:
    new = np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(columns[0])]
    return list(zip(cuts[:-1], cuts[1:]))


def _pairs(left: list[np.ndarray], right: list[np.ndarray]) -> pa.RecordBatch:
    one = np.concatenate([np.zeros(0, np.int64), *left])
    other = np.concatenate([np.zeros(0, np.int64), *right])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.minimum(one, other)), pa.array(np.maximum(one, other))], ["a", "b"]
    )


def _sparse_candidates(keys: DataFrame, nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """Pairs that share a key of few nodes and may be similar, each once (a < b).

    A pair belongs to the first key that both nodes have; where that one is dense, they
    are of one family.
    """
    ways = len(scheme.kept)

    def compare(key: int, node: np.ndarray, value: np.ndarray) -> tuple[list, list]:
        own = keys_of(value, scheme)
        at = int(np.flatnonzero(own[0] == key)[0])
        left, right = [], []
        for i in range(len(node) - 1):
            differ = value[i] != value[i + 1 :]
            mine = 1 - differ.mean(1) >= scheme.least_agreement
            errors = differ.reshape(len(differ), scheme.chunks, scheme.width).sum(2)
            mine &= ~(errors[:, : at // ways] <= scheme.errors).any(1)
            mine &= (own[i, : at + 1] == own[i + 1 :, : at + 1]).argmax(1) == at
            hits = node[i + 1 :][mine]
            left.append(np.full(len(hits), node[i]))
            right.append(hits)
        return left, right

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _by_group(batches, ("key",)):
            node, key = group["node"].to_numpy(), group["key"].to_numpy()
            data = b"".join(group["signature"].to_pylist())
            value = np.frombuffer(data, "<u2").reshape(len(node), scheme.values)
            left, right = [], []
            for i, j in _bounds(key):
                if j - i > 1:
                    a, b = compare(key[i], node[i:j], value[i:j])
                    left += a
                    right += b
            yield _pairs(left, right)

    rows = keys.join(nodes.select("node", "signature"), "node").select("key", "node", "signature")
    dealt = rows.repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(stream, "a long, b long")


def spanning_links(sets: list[np.ndarray], side: np.ndarray | None) -> list[tuple[int, int]]:
    """Similar pairs of the sets that connect all that similar pairs connect.

    Intersections of one set with all later ones are counted at once over an inverted
    index. ``side``: if given, only pairs of different sides are looked at.
    """
    sizes = np.array([len(x) for x in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(codes, kind="stable")
    owners = owner[order]
    first = np.searchsorted(codes[order], np.arange(codes.max() + 2))
    ends = np.cumsum(sizes)
    label = np.arange(len(sets))
    links = []
    for i in range(len(sets) - 1):
        mine = codes[ends[i] - sizes[i] : ends[i]]
        many = first[mine + 1] - first[mine]
        stops = np.cumsum(many)
        at = np.arange(stops[-1]) + np.repeat(first[mine] - (stops - many), many)
        both = np.bincount(owners[at], minlength=len(sets))
        close = 100 * both >= SIMILARITY * (sizes[i] + sizes - both)
        close[: i + 1] = False
        if side is not None:
            close &= side != side[i]
        for j in np.flatnonzero(close & (label != label[i])).tolist():
            if label[j] != label[i]:
                links.append((i, j))
                label[label == label[j]] = label[i]
    return links


def _family_links(dense: DataFrame, texts: DataFrame) -> DataFrame:
    """Links within families: nodes that dense keys connect, compared on their full sets.

    A family is cut into blocks of about ``_BLOCK`` nodes and every two blocks meet in a
    group of their own; a group names only links that connect what it had not connected.
    """
    hubs = dense.groupBy("key").agg(F.min("node").alias("a"))
    edges = dense.join(hubs, "key").select("a", F.col("node").alias("b")).where("a <> b").distinct()
    member = stored(components(edges).withColumnRenamed("comp", "family"), "families")
    sized = member.groupBy("family").agg(F.ceil(F.count("*") / _BLOCK).cast("int").alias("parts"))
    rows = member.join(sized, "family").withColumn(
        "part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    )
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select(
        "family", "node", "part", F.least("part", "other").alias("low"),
        F.greatest("part", "other").alias("high"),
    ).join(texts, "node")
    names = ("family", "low", "high")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _by_group(batches, names):
            node, part = group["node"].to_numpy(), group["part"].to_numpy()
            family, low, high = (group[c].to_numpy() for c in names)
            left, right = [], []
            for i, j in _bounds(family, low, high):
                sets = [shingles(words_of(t.as_py())) for t in group["text"].slice(i, j - i)]
                side = part[i:j] if low[i] != high[i] else None
                pairs = spanning_links(sets, side) if j - i > 1 else []
                left.append(node[[i + a for a, _ in pairs]].astype(np.int64))
                right.append(node[[i + b for _, b in pairs]].astype(np.int64))
            yield _pairs(left, right)

    dealt = rows.repartition(*names).sortWithinPartitions(*names)
    return dealt.mapInArrow(stream, "a long, b long").where("a <> b")


def _node_texts(plain: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and text of the wanted nodes: the text of their smallest id with their words.

    An id may have other texts, so the words' digest decides, not the id.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", _BATCH):
            found = [xxhash.xxh3_128_digest(b" ".join(words_of(t.as_py()))) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column("text")], ["digest", "text"])

    rows = plain.where("text IS NOT NULL").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    named = rows.select("text").mapInArrow(digest, "digest binary, text string")
    return named.join(wanted.select("digest", "node"), "digest").select("node", "text").distinct()


def _same_ids(members: DataFrame) -> DataFrame:
    """Edges between the nodes of an id that has several."""
    several = (
        members.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("last"))
        .where("a <> last").select("doc_id", "a")
    )
    return members.join(several, "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, scheme: Scheme = SCHEME, dense: int = DENSE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``.

    1. Equal word sequences are one node, numbered in the order of their smallest ids, so
       that an original comes before its copies and is their hub; only nodes go on.
    2. Every node has a key for each chunk of its signature and each way of leaving
       values out; nodes that share a key are candidates.
    3. Pairs of a key of at most ``dense`` nodes are compared one by one, each pair once.
    4. Keys of more nodes, as thousands of near copies have, connect their nodes to
       families. A family is compared in blocks, whose tasks keep only links that
       connect: the output grows with the members, not with their pairs.
    5. Components of the links are named by the smallest id of their documents.

    Links count only on full sets, and no pair that the index finds is left out. Rows
    without words link with nothing and are their own component; rows with a null id
    have none (component null, kept). Rows of one id are one document: the links of all
    its texts count. Empty tables give empty ones; columns other than doc_id and text are
    ignored.
    """
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    rows = stored(signed(plain, scheme), "signatures")
    known = rows.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    nodes = stored(
        known.groupBy("digest")
        .agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature"))
        .orderBy("doc_id", "digest").withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    keys = _keys(nodes, scheme)
    counted = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(keys.join(counted, "key"), "keys")
    candidates = _sparse_candidates(shared.where(F.col("n") <= dense), nodes, scheme)
    candidates = stored(candidates.where("a <> b").distinct(), "candidates")
    crowded = shared.where(F.col("n") > dense).select("key", "node")
    named = (
        candidates.select(F.explode(F.array("a", "b")).alias("node"))
        .union(crowded.select("node")).distinct()
    )
    wanted = nodes.select("digest", "node", "doc_id").join(named, "node")
    texts = stored(_node_texts(plain, wanted), "node-texts")
    members = known.select("doc_id", "digest").join(nodes.select("digest", "node"), "digest").select("doc_id", "node")
    linked = _linked(candidates, texts).union(_family_links(crowded, texts)).union(_same_ids(members))
    component = components(stored(linked, "links"))
    least = (
        nodes.select("node", "doc_id").join(component, "node")
        .groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    )
    owner = nodes.select("digest", "node", F.col("doc_id").alias("own")).join(component, "node", "left").join(least, "comp", "left")
    return (
        rows.select("doc_id", "digest", "n_shingles").join(owner.select("digest", "own", "component_id"), "digest", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "own", "doc_id").alias("component_id"))
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of every group: of the rows whose document stands for it.

    Where that document has several rows, the one of the least text stays. Rows with a
    null id stay all, as nothing is known of their group.
    """
    kept = near_duplicates(docs).where("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("kept_rows"))
    kept = stored(kept.withColumnRenamed("doc_id", "kept_id"), "kept")
    whole = docs.where("doc_id IS NOT NULL")
    same = F.col("doc_id").cast("long") == F.col("kept_id")
    single = whole.join(kept.where("kept_rows = 1"), same, "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    several = (
        whole.join(kept.where("kept_rows > 1").select("kept_id"), same)
        .groupBy("kept_id").agg(F.min_by(F.struct(*columns), F.struct("text")).alias("kept_row")).select("kept_row.*")
    )
    return single.unionByName(several).unionByName(docs.where("doc_id IS NULL"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
