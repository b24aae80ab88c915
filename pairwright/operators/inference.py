"""Exact permutation test and the two-way entity bootstrap over runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairwright.functions.mixing import MASK, mixed, mixed_array, mixed_int
from pairwright.operators.agreement import LAST_RUN, PIPELINES, RUNS
from pairwright.operators.metrics import ratio
from pairwright.session import checkpointed

# Bootstrap size and seed, and the runs of each group under test.
BOOTSTRAP_REPLICATES = 50_000
BOOTSTRAP_SEED = 20260730
RUNS_PER_GROUP = len(RUNS)
#: Replicates of a chunk, at most, slots of a block, and draws made at once.
CHUNK = 500
BLOCK = 512
DRAWS = 1 << 16
#: Counts that a task holds; with more entities, a chunk has fewer replicates.
_COUNT_BYTES = 64 << 20
_DRAWN_ROWS = 16
_PAIR_ROWS = 4096


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _moments(frame: DataFrame, values: str, prefix: str) -> DataFrame:
    """Add ``<prefix>_mean`` and ``<prefix>_se2``, the squared standard error."""
    size = F.size(values)
    mean = F.col(f"{prefix}_mean")
    squares = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + (v - mean) * (v - mean))
    deviation = F.sqrt(F.try_divide(squares, size - 1))
    return frame.withColumn(f"{prefix}_mean", F.try_divide(_total(F.col(values)), size)).withColumn(
        f"{prefix}_se2", F.try_divide(deviation * deviation, size)
    )


def _studentized(frame: DataFrame, left: str, right: str, out: str) -> DataFrame:
    """Mean gap over its unpooled standard error; 0 or infinite where that is 0."""
    both = _moments(_moments(frame, left, "_l"), right, "_r")
    gap = F.col("_l_mean") - F.col("_r_mean")
    error = F.sqrt(F.col("_l_se2") + F.col("_r_se2"))
    flat = F.when(gap == 0, 0.0).when(gap > 0, float("inf")).otherwise(float("-inf"))
    value = F.when(error == 0, flat).otherwise(F.try_divide(gap, error))
    return both.withColumns({out: value, f"{out}_gap": gap}).drop("_l_mean", "_l_se2", "_r_mean", "_r_se2")


def _run_values(runs: DataFrame, pipeline: str, value: str) -> Column:
    rows = F.when(F.col("pipeline") == pipeline, F.struct("run", F.col(value).alias("v")))
    return F.transform(F.array_sort(F.collect_list(rows)), lambda r: r["v"])


def permutation_test(runs: DataFrame, value: str = "f1") -> DataFrame:
    """Two-sided exact test over every 5/5 allocation of the ten run values.

    ``runs`` has one row per pipeline and run. The ten values become one row,
    which fans out to the 252 allocations.
    """
    left, right = _run_values(runs, PIPELINES[0], value), _run_values(runs, PIPELINES[1], value)
    observed = runs.agg(left.alias("left"), right.alias("right"))
    wrong_shape = (F.size("left") != RUNS_PER_GROUP) | (F.size("right") != RUNS_PER_GROUP)
    message = F.lit(f"expected {RUNS_PER_GROUP} observations per configuration")
    checked = observed.withColumn(
        "left", F.when(wrong_shape, F.raise_error(message).cast("array<double>")).otherwise(F.col("left"))
    )
    tested = _studentized(checked, "left", "right", "statistic")
    masks = F.filter(
        F.sequence(F.lit(0), F.lit(2 ** (2 * RUNS_PER_GROUP) - 1)),
        lambda m: F.bit_count(m) == RUNS_PER_GROUP,
    )
    allocated = tested.select("statistic", "statistic_gap", F.concat("left", "right").alias("pooled"), F.explode(masks).alias("mask"))

    def chosen(bit: int) -> Column:
        in_group = F.transform(
            F.sequence(F.lit(0), F.lit(2 * RUNS_PER_GROUP - 1)),
            lambda i: F.when(F.call_function("getbit", F.col("mask"), i) == bit, F.element_at("pooled", i + 1)),
        )
        return F.filter(in_group, lambda v: v.isNotNull())

    split = allocated.withColumns({"a": chosen(1), "b": chosen(0)})
    permuted = _studentized(split, "a", "b", "t")
    extreme = F.sum((F.abs("t") >= F.abs("statistic")).cast("bigint"))
    return permuted.agg(
        F.max("statistic").alias("statistic"),
        F.max("statistic_gap").alias("delta"),
        F.count("*").alias("total_allocations"),
        extreme.alias("extreme_allocations"),
        ratio(extreme, F.count("*")).alias("p_value"),
    )


def dense_slots(ids: DataFrame, column: str, slot: str) -> DataFrame:
    """Number distinct ids 0, 1, ... in sorted order without a global window.

    Rows are range-sorted, numbered inside their partition, and shifted by the
    sizes of the partitions before; only one row per partition is windowed.
    """
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = checkpointed(
        ids.select(column).distinct().orderBy(column).select(
            column, F.spark_partition_id().alias("_part"), within.alias("_within")
        )
    )
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    return placed.join(shifts, "_part").select(
        column, (F.col("_shift") + F.col("_within")).cast("bigint").alias(slot)
    )


#: What is drawn; a number keeps the draws of each apart.
_KINDS = {"source": 1, "target": 2, PIPELINES[0]: 3, PIPELINES[1]: 4}
_STEP = 0x9E3779B9


def stream_seed(kind: str, seed: int) -> int:
    """What the draws of a kind start from."""
    return mixed_int((seed + _KINDS[kind] * _STEP) & MASK)


def _draw(kind: str, seed: int, replicate: Column, draw: Column, size: Column | int) -> Column:
    """A number below ``size`` from the seed and the coordinates of a draw."""
    start = F.lit(stream_seed(kind, seed)).cast("long")
    of_replicate = mixed(start.bitwiseXOR(replicate.cast("long")))
    first = mixed(of_replicate.bitwiseXOR(mixed(draw.cast("long"))))
    second = mixed((first + F.lit(_STEP).cast("long")).bitwiseAND(F.lit(MASK)))
    return (F.shiftleft(first, 31) + F.shiftrightunsigned(second, 1)) % size


def _drawn(kind: str, seed: int, replicates: np.ndarray, draws: np.ndarray, size: int) -> np.ndarray:
    """The same numbers, replicates by draws."""
    of_replicate = mixed_array(np.uint32(stream_seed(kind, seed)) ^ replicates.astype(np.uint32))
    first = mixed_array(of_replicate[:, None] ^ mixed_array(draws.astype(np.uint32))[None, :])
    second = mixed_array(first + np.uint32(_STEP))
    wide = (first.astype(np.uint64) << np.uint64(31)) + (second >> np.uint32(1))
    return (wide % np.uint64(size)).astype(np.int64)


def entity_draws(
    spark: SparkSession, kind: str, entities: int, replicates: int, seed: int
) -> DataFrame:
    """``entities`` draws with replacement per replicate, counted per slot."""
    draws = spark.range(replicates * entities).select(
        F.floor(F.col("id") / entities).cast("bigint").alias("replicate"),
        (F.col("id") % entities).alias("draw"),
    )
    slot = _draw(kind, seed, F.col("replicate"), F.col("draw"), entities)
    return draws.select("replicate", slot.alias(f"{kind}_slot")).groupBy("replicate", f"{kind}_slot").agg(
        F.count("*").alias(f"{kind}_count")
    )


def run_draws(
    spark: SparkSession, replicates: int, seed: int, runs: dict[str, list[int]] | None = None
) -> DataFrame:
    """As many runs as a pipeline has, drawn with replacement per replicate, independently."""
    parts = []
    for pipeline in PIPELINES:
        known = list(RUNS) if runs is None else runs[pipeline]
        picks = F.explode(F.sequence(F.lit(0), F.lit(len(known) - 1))).alias("pick")
        rows = spark.range(replicates).select(F.col("id").alias("replicate"), picks)
        at = _draw(pipeline, seed, F.col("replicate"), F.col("pick"), len(known))
        run = F.get(F.array(*[F.lit(r) for r in known]), at.cast("int"))
        parts.append(rows.select("replicate", "pick", F.lit(pipeline).alias("pipeline"), run.alias("run")))
    return parts[0].union(parts[1])


def draw_effects(
    slotted: DataFrame, source_draws: DataFrame, target_draws: DataFrame, runs: DataFrame
) -> DataFrame:
    """Mean weighted F1 of the drawn runs per replicate, and its difference.

    ``slotted`` has a source and target slot, the label and both run masks per
    pair. A pair weighs the product of its entities' counts. Weights are summed
    per replicate and pattern before any run is looked at, so the ten run
    vectors never multiply the pair rows.
    """
    weights = (
        slotted.join(source_draws, "source_slot")
        .join(target_draws, ["target_slot", "replicate"])
        .groupBy("replicate", "label", "single_mask", "multi_mask")
        .agg(F.sum(F.col("source_count") * F.col("target_count")).alias("weight"))
    )
    mask = F.when(F.col("pipeline") == PIPELINES[0], F.col("single_mask")).otherwise(F.col("multi_mask"))
    says = F.call_function("getbit", mask, F.col("run")) == 1
    actual = F.col("label") == 1
    w = F.col("weight")
    zero = F.lit(0)
    # A replicate whose draws hit no pair keeps its row, so that it is reported below.
    cells = runs.join(weights, "replicate", "left").groupBy("replicate", "pipeline", "pick").agg(
        F.sum(F.when(says & actual, w).otherwise(zero)).alias("tp"),
        F.sum(F.when(says != actual, w).otherwise(zero)).alias("wrong"),
    )
    denominator = 2 * F.col("tp") + F.col("wrong")
    undefined = F.raise_error(F.lit("weighted F1 is undefined: no positive label and no positive prediction was drawn"))
    f1 = F.when(denominator == 0, undefined.cast("double")).otherwise(F.try_divide(2.0 * F.col("tp"), denominator))
    means = cells.withColumn("f1", f1).groupBy("replicate").agg(
        F.avg(F.when(F.col("pipeline") == PIPELINES[0], F.col("f1"))).alias("single_f1"),
        F.avg(F.when(F.col("pipeline") == PIPELINES[1], F.col("f1"))).alias("multi_f1"),
    )
    return means.withColumn("effect", F.col("single_f1") - F.col("multi_f1"))


def entity_counts(
    spark: SparkSession, kind: str, entities: int, replicates: int, seed: int, chunk: int
) -> DataFrame:
    """The counts of ``entity_draws``: bytes of slots by replicates, per block and chunk.

    A row draws a chunk of replicates whole, so nothing is gathered afterwards.
    """
    chunks = -(-replicates // chunk)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch["id"].to_pylist():
                mine = np.arange(at * chunk, min((at + 1) * chunk, replicates))
                counts = np.zeros((-(-entities // BLOCK) * BLOCK, chunk), np.uint8)
                for r in range(0, len(mine), _DRAWN_ROWS):
                    part = mine[r : r + _DRAWN_ROWS]
                    found = np.zeros((len(part), entities), np.int64)
                    for first in range(0, entities, DRAWS):
                        draws = np.arange(first, min(first + DRAWS, entities))
                        slots = _drawn(kind, seed, part, draws, entities)
                        slots += np.arange(len(part))[:, None] * entities
                        found += np.bincount(slots.ravel(), minlength=found.size).reshape(found.shape)
                    if found.max() > 255:
                        raise OverflowError("an entity was drawn more than 255 times in a replicate")
                    counts[:entities, r : r + len(part)] = found.T
                for block in range(0, entities, BLOCK):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block // BLOCK]), pa.array([at]), pa.array([counts[block : block + BLOCK].tobytes()], pa.binary())],
                        ["block", "chunk", "counts"],
                    )

    rows = spark.range(0, chunks, 1, max(1, min(chunks, 4 * spark.sparkContext.defaultParallelism)))
    return rows.mapInArrow(count, "block long, chunk long, counts binary").select(
        F.col("block").alias(f"{kind}_block"), "chunk", F.col("counts").alias(f"{kind}_counts")
    )


def known_runs(patterns: DataFrame) -> dict[str, list[int]]:
    """The runs that the decisions hold, per pipeline; every pair has to have all of them."""
    masks = dict(zip(PIPELINES, ("single_seen", "multi_seen")))
    if not set(masks.values()) <= set(patterns.columns):
        return {p: list(RUNS) for p in PIPELINES}
    seen = patterns.agg(*[f(m).alias(f"{n}_{m}") for m in masks.values() for n, f in (("any", F.bit_or), ("all", F.bit_and))]).first()
    runs = {}
    for pipeline, mask in masks.items():
        some, every = seen[f"any_{mask}"] or 0, seen[f"all_{mask}"] or 0
        if some != every:
            raise ValueError(f"{pipeline}: some pairs lack a decision of some runs; key_gaps names them")
        runs[pipeline] = [r for r in range(LAST_RUN + 1) if some >> r & 1]
        if not runs[pipeline]:
            raise ValueError(f"{pipeline} has no runs")
    return runs


def _cells(patterns: np.ndarray, runs: dict[str, list[int]]) -> np.ndarray:
    """Cells by patterns (label, masks): true positives and errors of every pipeline's runs."""
    label, *masks = patterns.T
    rows = []
    for mask, of in zip(masks, runs.values()):
        for run in of:
            says = (mask >> run & 1).astype(bool)
            rows += [says & (label == 1), (says != (label == 1)) & (label >= 0)]
    return np.array(rows, np.float64).reshape(-1, len(patterns))


_SUMS = "chunk long, sums binary"


def bootstrap_effects(
    patterns: DataFrame,
    replicates: int = BOOTSTRAP_REPLICATES,
    seed: int = BOOTSTRAP_SEED,
    chunk: int = CHUNK,
) -> DataFrame:
    """Pigeonhole bootstrap: resample sources, targets and runs independently.

    Every draw is a function of the seed and its coordinates, so a lost task
    recomputes the same numbers and the partitioning cannot change the result, which is
    that of ``draw_effects``. Slots are cut into blocks and replicates into chunks; the
    pairs of two blocks are one sparse matrix, which meets the blocks' counts once per
    chunk. So what is shuffled grows with the block pairs that hold pairs, not with pairs
    times replicates, and an entity with many pairs is spread over its block pairs.

    The runs are those that the decisions hold. Pairs that lack some, and replicates
    whose weighted F1 is undefined, are errors.
    """
    if replicates < 1:
        raise ValueError("replicates must be positive")
    spark = patterns.sparkSession
    kept = checkpointed(patterns)
    runs = known_runs(kept)
    sources = checkpointed(dense_slots(kept, "source_id", "source_slot"))
    targets = checkpointed(dense_slots(kept, "target_id", "target_slot"))
    sizes = {"source": sources.count(), "target": targets.count()}
    chunk = max(1, min(chunk, replicates, _COUNT_BYTES // max(1, *sizes.values())))
    slotted = kept.join(sources, "source_id").join(targets, "target_id")
    blocks = {f"{k}_block": F.floor(F.col(f"{k}_slot") / BLOCK).cast("long") for k in sizes}
    packed = (
        slotted.withColumns(blocks)
        .select(*blocks, F.struct(
            (F.col("source_slot") % BLOCK).cast("int").alias("s"), (F.col("target_slot") % BLOCK).cast("int").alias("t"),
            F.coalesce("label", F.lit(-1)).cast("long").alias("label"),
            F.col("single_mask").cast("long").alias("single"), F.col("multi_mask").cast("long").alias("multi"),
        ).alias("pair"))
        .groupBy(*blocks).agg(F.collect_list("pair").alias("pairs"))  # at most BLOCK x BLOCK pairs
    )
    # Spark takes these rows for a few bytes each, as it can't see what Python returns, and
    # would send all of them through the driver to every executor.
    counted = {k: entity_counts(spark, k, n, replicates, seed, chunk).hint("merge") for k, n in sizes.items()}
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    met = (
        packed.join(counted["source"], "source_block")
        .repartition(tasks, "target_block", "chunk").join(counted["target"], ["target_block", "chunk"])
        .select("chunk", "pairs", "source_counts", "target_counts")
    )
    cells = 2 * sum(map(len, runs.values()))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                pair = batch["pairs"][i].values
                left, right = (
                    np.frombuffer(batch[c][i].as_py(), np.uint8).reshape(-1, chunk)
                    for c in ("source_counts", "target_counts")
                )
                s, t, *fields = (pair.field(c).to_numpy() for c in ("s", "t", "label", "single", "multi"))
                known, of = np.unique(np.column_stack(fields), axis=0, return_inverse=True)
                order = np.argsort(of.ravel(), kind="stable")
                of = of.ravel()[order]
                weights = np.zeros((len(known), chunk))
                for first in range(0, len(order), _PAIR_ROWS):
                    rows = order[first : first + _PAIR_ROWS]
                    mine = of[first : first + _PAIR_ROWS]
                    starts = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
                    product = left[s[rows]].astype(np.int64) * right[t[rows]]
                    weights[mine[starts]] += np.add.reduceat(product, starts, axis=0)
                at = batch["chunk"][i].as_py()
                sums[at] = sums.get(at, 0) + _cells(known, runs) @ weights
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
                ["chunk", "sums"],
            )

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for name, data in zip(batch["chunk"].to_pylist(), batch["sums"].to_pylist()):
                mine = np.zeros((cells, chunk)) if data is None else np.frombuffer(data).reshape(cells, chunk)
                sums[name] = sums.get(name, 0) + mine
        for name, mine in sums.items():
            ids = np.arange(name * chunk, min((name + 1) * chunk, replicates))
            means, row = [], 0
            for pipeline, of in runs.items():
                shaped = mine[row : row + 2 * len(of), : len(ids)].reshape(len(of), 2, len(ids))
                row += 2 * len(of)
                drawn = _drawn(pipeline, seed, ids, np.arange(len(of)), len(of)).T
                tp, wrong = (shaped[drawn, i, np.arange(len(ids))] for i in (0, 1))
                below = 2 * tp + wrong
                if (below == 0).any():
                    raise ValueError("weighted F1 is undefined: no positive label and no positive prediction was drawn")
                means.append((2 * tp / below).sum(0) / len(of))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), *map(pa.array, means), pa.array(means[0] - means[1])],
                ["replicate", "single_f1", "multi_f1", "effect"],
            )

    # A chunk whose draws hit no pair keeps its row, so that it is reported.
    every = spark.range(-(-replicates // chunk)).select(
        F.col("id").alias("chunk"), F.lit(None).cast("binary").alias("sums")
    )
    return met.mapInArrow(weigh, _SUMS).unionByName(every).repartition("chunk").mapInArrow(
        effects, "replicate long, single_f1 double, multi_f1 double, effect double"
    )


def bootstrap_range(effects: DataFrame) -> DataFrame:
    """Mean effect and its 2.5 and 97.5 percentiles, linearly interpolated."""
    return effects.agg(
        F.count("*").alias("replicates"),
        F.avg("effect").alias("mean_effect"),
        F.percentile("effect", 0.025).alias("range_lower"),
        F.percentile("effect", 0.975).alias("range_upper"),
    ).withColumn("includes_zero", (F.col("range_lower") <= 0) & (F.col("range_upper") >= 0))


