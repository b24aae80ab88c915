"""Approximate nearest neighbours: a forest of random-projection trees."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.common import stored, table

TREES = 8
#: Splits on the way to a leaf, at most. Leaves grow with the data, so that the leaves a
#: query visits, and the bests they return, don't.
DEPTH = 6
#: Vectors that the splits are taken from; every vector is indexed.
SAMPLE = 8192
#: Leaf entries that a query looks at, as a share of all vectors; a vector is an entry in
#: each tree. 64 dimensions without structure need this much for a recall of 0.95;
#: vectors in clusters need far less.
SEARCHED_SHARE = 1.1
NEIGHBOURS = 20
#: Leaf vectors in one task's group.
_BLOCK = 16_384


@dataclass(frozen=True)
class Forest:
    """Complete binary trees: node i has children 2i + 1 and 2i + 2.

    ``directions``: trees x inner nodes x dimensions; ``cuts``: trees x inner nodes.
    """

    directions: np.ndarray
    cuts: np.ndarray
    depth: int

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of every vector in every tree."""
        at = np.zeros((len(vectors), len(self.cuts)), np.int64)
        for _ in range(self.depth):
            for t in range(len(self.cuts)):
                side = (vectors * self.directions[t][at[:, t]]).sum(1) >= self.cuts[t][at[:, t]]
                at[:, t] = 2 * at[:, t] + 1 + side
        return at - ((1 << self.depth) - 1)

    def nearest_leaves(self, vector: np.ndarray, sizes: np.ndarray, searched: int) -> list[tuple[int, int]]:
        """Leaves in the order of one queue shared by all trees, until they hold ``searched``.

        A branch not taken waits with the smallest margin on its way; the queue always
        goes on with the branch whose margin is largest (least negative).
        """
        margins = self.directions @ vector - self.cuts
        queue = [(0.0, t, 0) for t in range(len(self.cuts))]
        inner, found, held = (1 << self.depth) - 1, [], 0
        while queue and held < searched:
            worst, t, node = heapq.heappop(queue)
            while node < inner:
                margin = float(margins[t, node])
                near, far = (2 * node + 2, 2 * node + 1) if margin >= 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (max(worst, abs(margin)), t, far))
                node = near
            found.append((t, node - inner))
            held += int(sizes[t, node - inner])
        return found


def grow(sample: np.ndarray, trees: int, depth: int, seed: int = 3) -> Forest:
    """Split at the median along the difference of two random members of a node."""
    rng = np.random.default_rng(seed)
    inner, width = (1 << depth) - 1, sample.shape[1]
    directions, cuts = np.zeros((trees, inner, width)), np.zeros((trees, inner))
    for t in range(trees):
        members = {0: np.arange(len(sample))}
        for node in range(inner):
            mine = members.pop(node)
            direction = rng.standard_normal(width)
            if len(mine) > 1:
                pair = rng.choice(mine, 2, replace=False)
                apart = sample[pair[0]] - sample[pair[1]]
                direction = apart if np.any(apart) else direction
            direction /= np.linalg.norm(direction)
            along = sample[mine] @ direction
            directions[t, node] = direction
            cuts[t, node] = np.median(along) if len(mine) else 0.0
            members[2 * node + 1] = mine[along < cuts[t, node]]
            members[2 * node + 2] = mine[along >= cuts[t, node]]
    return Forest(directions, cuts, depth)


def _usable(vectors: DataFrame, vector: str, key: str) -> DataFrame:
    """Vectors of finite numbers, not all zero, of the width that most have."""
    numbers = F.col(vector).cast("array<double>")
    fine = (
        F.col(key).isNotNull() & (F.size(numbers) > 0)
        & F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(numbers, lambda x: x != 0)
    )
    return vectors.select(F.col(key).cast("long").alias("id"), numbers.alias("v")).where(fine)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def nearest(
    vectors: DataFrame, queries: DataFrame, *, key: str = "vec_id", vector: str = "embedding",
    neighbours: int = NEIGHBOURS, trees: int = TREES, depth: int = DEPTH,
    searched_share: float = SEARCHED_SHARE, sample: int = SAMPLE,
) -> DataFrame:
    """For each query its nearest vectors by inner product: query_id, rank, vec_id, score.

    The forest is grown on a sample drawn by hash and sent to the tasks; its size depends
    on ``sample`` alone. All vectors are dealt to their leaf in every tree, each query to
    the leaves that the shared queue names; a leaf and its queries meet in one group, which
    keeps the query's best few, and a query's bests are merged. A leaf of more than
    ``_BLOCK`` vectors is cut into blocks that meet the queries apart.

    Equal vectors are indexed once, with the smallest ids that can be asked for, so that
    thousands of copies neither fill a leaf nor crowd out others: a vector stands for
    ``neighbours`` + 1 ids at most, enough for any answer. Ties go to the smaller id; a
    query is no candidate of its own. Null ids, and vectors that are null, empty, zero or
    hold null or non-finite components, take no part; nor do vectors of another width than
    the first by id. Rows repeated with id and vector count once. With a share of ``trees`` the
    answer is exact.
    """
    usable = _usable(vectors, vector, key)
    asked = _usable(queries, vector, key).distinct()
    first = usable.orderBy("id", "v").limit(1).select(F.size("v").alias("w")).collect()
    spark = vectors.sparkSession
    if not first:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = first[0]["w"]
    same = usable.where(F.size("v") == width)
    # the ids of equal vectors, smallest first; the window keeps only the first few
    ranked = same.distinct().withColumn(
        "r", F.expr("row_number() OVER (PARTITION BY v ORDER BY id)")
    ).where(F.col("r") <= neighbours + 1)
    points = stored(
        ranked.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "points"
    )
    n = points.count()
    drawn = points.select("v").orderBy(F.xxhash64("v"), "v").limit(sample).collect()
    held = np.array([r["v"] for r in drawn]).reshape(len(drawn), width)
    depth = max(0, min(depth, int(np.log2(max(1, len(held)) / 16 + 1))))
    searched = max(int(np.ceil(searched_share * n)), 16 * neighbours)
    forest = grow(held, trees, depth)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf = forest.leaves(_matrix(batch.column("v")))
            row = np.repeat(np.arange(batch.num_rows), trees)
            part = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.tile(np.arange(trees, dtype=np.int32), batch.num_rows)),
                    pa.array(leaf.ravel()), part.column("v"), part.column("ids"),
                ],
                ["tree", "leaf", "v", "ids"],
            )

    dealt = stored(points.mapInArrow(deal, "tree int, leaf long, v array<double>, ids array<long>"), "leaves")
    counted = dealt.groupBy("tree", "leaf").count().collect()  # trees x leaves, bounded by the sample
    sizes = np.zeros((trees, 1 << depth), np.int64)
    for r in counted:
        sizes[r["tree"], r["leaf"]] = r["count"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [forest.nearest_leaves(v, sizes, searched) for v in _matrix(batch.column("v"))]
            row = np.repeat(np.arange(len(found)), [len(f) for f in found])
            tree, leaf = np.array([x for f in found for x in f]).reshape(-1, 2).T
            blocks = -(-sizes[tree, leaf] // _BLOCK)
            row, tree, leaf = (np.repeat(x, blocks) for x in (row, tree, leaf))
            block = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            part = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(tree.astype(np.int32)), pa.array(leaf), pa.array(block.astype(np.int32)),
                    part.column("id"), part.column("v"),
                ],
                ["tree", "leaf", "block", "id", "v"],
            )

    spread = np.maximum(1, -(-sizes // _BLOCK))
    large = [(t, l, int(spread[t, l])) for t, l in zip(*np.nonzero(spread > 1))]
    if large:
        cut = spark.createDataFrame([(int(t), int(l), k) for t, l, k in large], "tree int, leaf long, k int")
        rows = dealt.join(cut, ["tree", "leaf"], "left").withColumn(
            "block", F.pmod(F.xxhash64("v"), F.coalesce("k", F.lit(1))).cast("int")
        ).drop("k")
    else:
        rows = dealt.withColumn("block", F.lit(0))
    place = ["tree", "leaf", "block"]
    visits = asked.where(F.size("v") == width).mapInArrow(
        ask, "tree int, leaf long, block int, id long, v array<double>"
    )

    def best(these: pa.Table, those: pa.Table) -> pa.Table:
        """The best of one leaf for each of its queries."""
        out = {"query_id": [], "vec_id": [], "score": []}
        if these.num_rows and those.num_rows:
            members, q = _matrix(those["v"]), _matrix(these["v"])
            ids = those["ids"].to_pylist()
            for query, near in zip(these["id"].to_pylist(), q @ members.T):
                found: list[tuple[float, int]] = []
                top = np.argsort(-near, kind="stable")[: neighbours + 1]
                level = near[top[-1]]
                for m in np.flatnonzero(near >= level).tolist():
                    found += [(-near[m], i) for i in ids[m] if i != query]
                for s, i in sorted(found)[:neighbours]:
                    out["query_id"].append(query)
                    out["vec_id"].append(i)
                    out["score"].append(-s)
        return pa.table({
            "query_id": pa.array(out["query_id"], pa.int64()),
            "vec_id": pa.array(out["vec_id"], pa.int64()),
            "score": pa.array(out["score"], pa.float64()),
        })

    found = (
        visits.groupBy(*place).cogroup(rows.groupBy(*place))
        .applyInArrow(best, "query_id long, vec_id long, score double")
    )
    # a pair may come from several leaves, in the same precision but not the same sum order
    return (
        found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        .withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)"))
        .where(F.col("rank") <= neighbours)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def op10_forest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
