"""Phrase collocations: an FM-index of word numbers per shard, counts summed over shards."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.common import by_bytes, stored, table, text_of
from pairwright.llm.dictionary import Numbered, unzip_numbers, zip_numbers

WORDS = 3
LEAST = 10
TOP = 2000
#: A phrase goes where a longer one has so many hundredths of its occurrences.
ABSORBED = 50
SHARD_BYTES = 16 << 20
_BREAK = re.compile(rb"[.,;:!?\x0A-\x0D]+")
#: Stands between pieces; no UTF-8 text holds this byte.
_END = b"\xff"
_ROWS = 1 << 16


class Intervals(NamedTuple):
    """Phrases by their place in both indexes: rows ``low`` to ``low + size`` of the
    forward one, ``back`` to ``back + size`` of the backward one."""

    words: tuple[np.ndarray, ...]
    low: np.ndarray
    back: np.ndarray
    size: np.ndarray


class _Transform:
    """The Burrows-Wheeler transform of ``text``, rows in order of their first ``depth``
    symbols, and where each row's left extension lies.

    Intervals of phrases shorter than ``depth`` extend as in the full order, as only
    their first symbols place them.
    """

    def __init__(self, text: np.ndarray, depth: int, kinds: int):
        key, most = text.astype(np.int64), kinds
        for d in range(1, depth):
            if most * kinds >= 1 << 62:
                key = np.unique(key, return_inverse=True)[1].astype(np.int64)
                most = int(key.max(initial=0)) + 1
            key, most = key * kinds + np.roll(text, -d), most * kinds
        rows = np.argsort(key, kind="stable")
        self.symbol = text[rows - 1]
        self.extended = np.empty(len(text), np.int64)
        self.extended[np.argsort(self.symbol, kind="stable")] = np.arange(len(text))


class PhraseIndex:
    """A bidirectional index of a sequence of symbols; 0 parts it and is in no phrase."""

    def __init__(self, text: np.ndarray, depth: int):
        text = np.append(text, 0).astype(np.int64)
        self.kinds = int(text.max()) + 1
        self.forward = _Transform(text, depth, self.kinds)
        self.backward = _Transform(text[::-1], depth, self.kinds)
        self.counts = np.bincount(text, minlength=self.kinds)

    def single(self) -> Intervals:
        """The phrases of one word."""
        low = np.cumsum(self.counts) - self.counts
        word = np.flatnonzero(self.counts)
        word = word[word > 0]
        return Intervals((word,), low[word], low[word], self.counts[word])

    def extended(self, of: Intervals, left: bool) -> Intervals:
        """All phrases with one word more at that side, with their counts.

        The symbols of an interval, in order, part the same interval of the other index.
        """
        index, low, other = (self.forward, of.low, of.back) if left else (self.backward, of.back, of.low)
        begins = np.cumsum(of.size) - of.size
        owner = np.repeat(np.arange(len(low)), of.size)
        row = np.arange(len(owner)) - begins[owner] + low[owner]
        key = owner * self.kinds + index.symbol[row]
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        size = np.diff(np.r_[first, len(key)])
        owner, word = np.divmod(key[first], self.kinds)
        moved = index.extended[row[order[first]]]
        rest = other[owner] + first - begins[owner]
        words = tuple(w[owner] for w in of.words)
        words = (word, *words) if left else (*words, word)
        found = Intervals(words, *((moved, rest) if left else (rest, moved)), size)
        real = word > 0
        return Intervals(tuple(w[real] for w in found.words), *(x[real] for x in found[1:]))

    def phrases(self, most: int) -> Iterator[Intervals]:
        """The phrases of two words, of three, and so on: to the right, then to the left."""
        held = self.single()
        for length in range(2, most + 1):
            held = self.extended(held, left=length % 2 == 1)
            yield held


_SHARDS = "shard string, lang string, word string, number int, n long, order binary"


def _shards(docs: DataFrame, shard_bytes: int) -> DataFrame:
    """For every shard, texts of one language in a task, a row with the order of its words
    by number (0 ends a piece), and a row for each distinct word."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shards = TaskContext.get().partitionId(), 0
        for batch in by_bytes(batches, "text", shard_bytes):
            langs = np.array(batch.column("lang").to_pylist())
            for lang in sorted(set(langs.tolist())):
                texts = batch.column("text").filter(pa.array(langs == lang)).to_pylist()
                known = Numbered({_END: 0})
                order = [
                    np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                    for words in ((_BREAK.sub(b" \xff ", t.encode().lower()) + b" \xff").split() for t in texts)
                ]
                order = np.concatenate(order)
                counts = np.bincount(order, minlength=len(known))
                words = [w.decode() for w in known if w != _END]
                name, shards = f"{part}-{shards}", shards + 1
                out = pa.table({
                    "shard": [name] * (len(words) + 1), "lang": [lang] * (len(words) + 1),
                    "word": pa.array([None, *words], pa.string()), "number": pa.array(range(len(words) + 1), pa.int32()),
                    "n": pa.array(np.r_[0, counts[1:]].astype(np.int64)), "order": pa.array([zip_numbers(order), *[None] * len(words)], pa.binary()),
                })
                yield from out.combine_chunks().to_batches(_ROWS)

    source = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of(F.col("text")).alias("text"))
    return source.mapInArrow(number, _SHARDS)


def _numbered(words: DataFrame) -> DataFrame:
    """``words`` with ``id``: 0 for the most frequent, and on without a hole.

    Small numbers keep the shuffled phrases small. Words are sorted by ranges, numbered
    inside their partition, and shifted by the sizes of the partitions before.
    """
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = stored(
        words.orderBy(F.desc("f"), "lang", "word").select("*", F.spark_partition_id().alias("part"), within.alias("place")),
        "frequent-words",
    )
    before = "sum(size) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    shifts = placed.groupBy("part").agg(F.count("*").alias("size")).select("part", F.expr(f"coalesce({before}, 0)").alias("shift"))
    return placed.join(shifts, "part").select("lang", "word", "f", (F.col("shift") + F.col("place")).alias("id"))


def _counted(shards: DataFrame, frequent: DataFrame, words: int) -> list[DataFrame]:
    """Counts of the phrases of 2 to ``words`` frequent words in every shard, as ids."""
    names = [f"w{i}" for i in range(words)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        for batch in batches:
            orders = batch.column("order")
            kept = 0
            for at in np.flatnonzero(orders.is_valid().to_numpy(zero_copy_only=False)).tolist():
                numbers.append(batch.column("number")[kept:at].to_numpy(zero_copy_only=False))
                ids.append(batch.column("id")[kept:at].to_numpy(zero_copy_only=False))
                kept = at + 1
                yield from phrases(np.concatenate(numbers), np.concatenate(ids), unzip_numbers(orders[at].as_py()))
                numbers, ids = [], []
            numbers.append(batch.column("number")[kept:].to_numpy(zero_copy_only=False))
            ids.append(batch.column("id")[kept:].to_numpy(zero_copy_only=False))

    def phrases(number: np.ndarray, of: np.ndarray, order: np.ndarray) -> Iterator[pa.RecordBatch]:
        known = np.sort(of)
        code = np.zeros(int(max(order.max(initial=0), number.max(initial=0))) + 1, np.int64)
        code[number] = np.searchsorted(known, of) + 1
        text = code[order]
        text = text[(text > 0) | (np.r_[0, text[:-1]] > 0)]  # one break is as good as many
        known = np.r_[np.int64(-1), known]
        for found in PhraseIndex(text, words).phrases(words):
            for i in range(0, len(found.size), _ROWS):
                part = [known[w[i : i + _ROWS]] for w in found.words]
                none = [np.full(len(part[0]), -1)] * (words - len(part))
                columns = [*part, *none, found.size[i : i + _ROWS]]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], [*names, "n"])

    answers = shards.where("word IS NOT NULL").join(frequent.select("id", "lang", "word"), ["lang", "word"])
    every = answers.select("shard", F.lit(0).alias("kind"), "number", "id", F.lit(None).cast("binary").alias("order")).union(
        shards.where("word IS NULL").select("shard", F.lit(1), F.lit(None).cast("int"), F.lit(None).cast("long"), "order")
    )
    tasks = max(1, shards.where("word IS NULL").count())
    dealt = every.repartition(tasks, "shard").sortWithinPartitions("shard", "kind")
    return dealt.mapInArrow(search, ", ".join(f"{n} long" for n in (*names, "n")))


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), in numbers of 38 digits."""
    wide = [x.cast("decimal(19,0)") for x in (a, left, right)]
    over = wide[0] * wide[0] * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", over, wide[1] * wide[2])


def collocations(
    docs: DataFrame, *, words: int = WORDS, least: int = LEAST, top: int = TOP, absorbed: int = ABSORBED,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """The best phrases of every language: lang, rank, phrase, a, l, r, n and score.

    A phrase is 2 to ``words`` words within a piece, ``least`` times or more (``a``);
    ``score`` compares it with the parts of its worst cut, ``l`` and ``r`` occurrences;
    phrases that a longer one absorbs go; ``n`` counts the words of the language.

    1. A shard holds the texts of one language of a batch as word numbers. Distinct words
       of all shards are counted; a word below ``least`` parts the text as a break does, as
       no phrase with it can reach ``least``.
    2. Each shard is indexed in both directions, and its phrases are enumerated by
       extending intervals, right and left in turn; tasks hold one shard at a time.
    3. Spark sums the counts over the shards. A frequent word or phrase is one row per
       shard, so no key is hot before the sum.
    4. Cuts and absorption are joins of the counted phrases; ranks are cut in salted
       groups before the language's own.

    Null texts are empty, null languages ``und``; empty tables give empty ones; repeated
    rows count as often as they occur; other columns are ignored.
    """
    shards = stored(_shards(docs, shard_bytes), "shards")
    found = shards.where("word IS NOT NULL")
    frequent = _numbered(
        found.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    )
    names = [f"w{i}" for i in range(words)]
    summed = stored(
        _counted(shards, frequent, words).groupBy(*names).agg(F.sum("n").alias("a")).where(F.col("a") >= least),
        "phrases",
    )

    def of(length: int, at: int = 0) -> DataFrame:
        """Phrases of that length, or words, with their words named from place ``at`` on."""
        if length == 1:
            return frequent.select(F.col("id").alias(f"w{at}"), F.col("f").alias("f"))
        exact = summed.where(F.col(f"w{length - 1}") >= 0)
        exact = exact.where(F.col(f"w{length}") < 0) if length < words else exact
        return exact.select(*[F.col(f"w{i}").alias(f"w{at + i}") for i in range(length)], F.col("a").alias("f"))

    def windows(length: int, longer: int) -> DataFrame:
        """The parts of that length of all longer phrases, and the longer one's count."""
        parts = F.array(*[
            F.struct(*[F.col(f"w{at + i}").alias(f"w{i}") for i in range(length)]) for at in range(longer - length + 1)
        ])
        return of(longer).select(F.explode(parts).alias("p"), "f").select("p.*", "f")

    scored = []
    for length in range(2, words + 1):
        mine = [f"w{i}" for i in range(length)]
        rows = of(length).withColumnRenamed("f", "a")
        if length < words:
            over = reduce(DataFrame.union, (windows(length, m) for m in range(length + 1, words + 1)))
            over = over.groupBy(*mine).agg(F.max("f").alias("longer"))
            rows = rows.join(over, mine, "left").where(
                F.coalesce(F.col("longer") * 100 < F.col("a") * absorbed, F.lit(True))
            ).drop("longer")
        for i, name in enumerate(mine):
            word = frequent.select(F.col("id").alias(name), F.col("word").alias(f"t{i}"), F.col("f").alias(f"f{i}"), "lang")
            rows = rows.join(word if i == 0 else word.drop("lang"), name)
        cuts = []
        for k in range(1, length):
            for at, size, name in ((0, k, f"l{k}"), (k, length - k, f"r{k}")):
                if size == 1:
                    rows = rows.withColumn(name, F.col(f"f{at}"))
                else:
                    rows = rows.join(of(size, at).withColumnRenamed("f", name), [f"w{at + i}" for i in range(size)])
            cuts.append(F.struct(
                _score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"),
                F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"),
            ))
        worst = F.array_min(F.array(*cuts))
        scored.append(rows.select(
            "lang", F.concat_ws(" ", *[f"t{i}" for i in range(length)]).alias("phrase"), "a", worst.alias("cut")
        ))
    every = reduce(DataFrame.union, scored).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = "ORDER BY score DESC, a DESC, phrase"
    salted = every.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = salted.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang, salt {order})"))
    first = first.where(F.col("rank") <= top).drop("rank", "salt")
    ranked = first.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang {order})")).where(F.col("rank") <= top)
    totals = found.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


#: The same phrases in DuckDB: n-grams from the words of every piece.
ORACLE = r"""
WITH pieces AS (
    SELECT row_number() OVER () AS p, lang, piece FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)
), words AS (
    SELECT p, lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces
), grams AS (
    SELECT lang, m, ws[i : i + m - 1] AS g
    FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i
          FROM words, (SELECT unnest([1, 2, 3]) AS m) WHERE len(ws) >= m)
), counts AS (
    SELECT lang, m, g, count(*)::BIGINT AS f FROM grams GROUP BY ALL
), totals AS (
    SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE m = 1 GROUP BY lang
), candidates AS (
    SELECT * FROM counts WHERE m > 1 AND f >= 10
), cuts AS (
    SELECT c.lang, c.m, c.g, c.f AS a, k, x.f AS l, y.f AS r,
           (1000000::HUGEINT * c.f * c.f // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) c
    JOIN counts x ON x.lang = c.lang AND x.g = c.g[1 : k]
    JOIN counts y ON y.lang = c.lang AND y.g = c.g[k + 1 : c.m]
), worst AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), absorbed AS (
    SELECT lang, part, max(f) AS f
    FROM (SELECT lang, f, unnest([g[1 : 2], g[2 : 3]]) AS part FROM candidates WHERE m = 3) GROUP BY ALL
), ranked AS (
    SELECT w.lang, array_to_string(w.g, ' ') AS phrase, a, l, r, score
    FROM worst w LEFT JOIN absorbed b ON b.lang = w.lang AND b.part = w.g
    WHERE b.f IS NULL OR 100 * b.f < 50 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank,
       phrase, a, l, r, n, score
FROM ranked JOIN totals USING (lang)
QUALIFY rank <= 2000
"""
