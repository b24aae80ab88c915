"""LM scoring: a gated recurrent language model trained and applied by all tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright.llm.common import remainder, stored, stored_by, table
from pairwright.llm.dictionary import (
    blocks, buckets_for, rows_of, unzip_numbers, unzip_words, zip_numbers, zip_words,
)
from pairwright.llm.gru import Network, Trainer, log_likelihoods, train

#: Words that the network names one by one; all others are told apart within tail classes.
WORDS = 2048
PER_CLASS = 64
TAILS = 8
HIDDEN = 16
RATE = 0.05
#: Every round trains on its share of the learned documents and averages the tasks' models.
ROUNDS = 2
#: Distinct words that a pack holds, and a step of the spelling takes up, at most.
PACK = 20_000
BLOCK_BYTES = 16 << 20
_SYMBOLS = 48
_TRIPLES = (_SYMBOLS + 1) ** 3
_PARTS = 8
_MILLI = 1000


def words_and_end(text: str) -> list[bytes]:
    """Lower-cased words of a text, and its end, written as no bytes."""
    return [*text.encode().lower().split(), b""]


@dataclass(frozen=True)
class Spelling:
    """A mixture of Markov chains over bytes: the class of a rare word, and its probability."""

    symbol: np.ndarray  # of each byte; the last symbol stands for all rare bytes
    logs: np.ndarray  # (two before, to) x class, log10; symbol _SYMBOLS starts and ends
    share: np.ndarray  # log10 of each class's share
    rare: float  # log10 probability of one of the bytes that share the last symbol

    def _steps(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(w) for w in words], np.int64)
        symbols = self.symbol[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.cumsum(lengths + 1)
        to = np.full(ends[-1] if len(ends) else 0, _SYMBOLS)
        inside = np.ones(len(to), bool)
        inside[ends - 1] = False
        to[inside] = symbols
        before = np.r_[_SYMBOLS, to[:-1]]
        before[np.r_[0, ends[:-1]]] = _SYMBOLS
        other = np.bincount(np.repeat(np.arange(len(words)), lengths), symbols == _SYMBOLS - 1, len(words))
        earlier = np.r_[_SYMBOLS, before[:-1]]
        earlier[np.r_[0, ends[:-1]]] = _SYMBOLS
        return (earlier * (_SYMBOLS + 1) + before) * (_SYMBOLS + 1) + to, ends, other

    def likelihoods(self, words: list[bytes]) -> np.ndarray:
        steps, ends, other = self._steps(words)
        sums = np.add.reduceat(self.logs[steps], np.r_[0, ends[:-1]], axis=0)
        return sums + other[:, None] * self.rare

    def classes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Class of each word, and the log10 probability of spelling it within its class."""
        out_class, out_log = [np.zeros(0, np.int64)], [np.zeros(0)]
        for i in range(0, len(words), PACK):
            logs = self.likelihoods(words[i : i + PACK])
            best = (logs + self.share).argmax(1)
            out_class.append(best)
            out_log.append(logs[np.arange(len(best)), best])
        return np.concatenate(out_class), np.concatenate(out_log)


    def belongs(self, words: list[bytes]) -> np.ndarray:
        """How likely each class is for each word."""
        like = (self.likelihoods(words) + self.share) * np.log(10)
        belongs = np.exp(like - like.max(1, keepdims=True))
        return belongs / belongs.sum(1, keepdims=True)

    def sums(self, words: list[bytes], belongs: np.ndarray) -> np.ndarray:
        """Triples by class, weighted by how much words belong to it; the words by class come last."""
        steps, ends, _ = self._steps(words)
        owner = np.repeat(np.arange(len(words)), np.diff(np.r_[0, ends]))
        counts = [np.bincount(steps, belongs[owner, k], _TRIPLES) for k in range(belongs.shape[1])]
        return np.vstack([np.stack(counts, 1), belongs.sum(0)])

    def refitted(self, sums: np.ndarray) -> Spelling:
        """The chains that follow from the ``sums`` of all words."""
        classes = sums.shape[1]
        cube = sums[:-1].reshape(_SYMBOLS + 1, _SYMBOLS + 1, _SYMBOLS + 1, classes)
        # pairs of a class back off to pairs of all words, triples to the class's pairs
        pairs = cube.sum(0)
        base = pairs.sum(2) + 0.1
        base /= base.sum(1, keepdims=True)
        pairs = pairs + 5.0 * base[:, :, None]
        pairs /= pairs.sum(1, keepdims=True)
        cube = cube + 4.0 * pairs[None]
        logs = np.log10(cube / cube.sum(2, keepdims=True)).reshape(_TRIPLES, classes).astype(np.float32)
        share = np.log10((sums[-1] + 1) / (sums[-1].sum() + classes))
        return Spelling(self.symbol, logs, share, self.rare)


_SPELLED = "part int, sums binary"


def fit_spelling(
    packs: DataFrame, heads: dict[bytes, int], often: np.ndarray, classes: int = TAILS, rounds: int = 15
) -> Spelling:
    """EM over all distinct words of the ``packs`` but the ``heads``.

    ``often`` counts the bytes of those words. A round is a pass over the packs. Every task
    adds up a table bounded by symbols and classes, and tables are added part by part in a
    shuffle. Classes start from shares drawn for each word.
    """
    symbol = np.full(256, _SYMBOLS - 1, np.int64)
    top = np.argsort(-often, kind="stable")[: _SYMBOLS - 1]
    symbol[top] = np.arange(len(top))
    rare = -float(np.log10(256 - len(top)))
    model = Spelling(
        symbol, np.full((_TRIPLES, classes), -np.log10(_SYMBOLS + 1), np.float32), np.full(classes, -np.log10(classes)), rare
    )
    if not often.any():
        return model

    def rows(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        data = [zstandard.compress(v.tobytes(), 1) for v in sums.values()]
        return pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array(data, pa.binary())], ["part", "sums"]
        )

    for turn in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], turn: int = turn, model: Spelling = model) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((_TRIPLES + 1, classes))
            for batch in batches:
                for seed, packed in zip(batch["n"].to_pylist(), batch["word"].to_pylist()):
                    words = [w for w in unzip_words(packed) if w not in heads]
                    if not words:
                        continue
                    if turn:
                        belongs = model.belongs(words)
                    else:
                        belongs = np.random.default_rng([2, seed]).dirichlet(np.full(classes, 0.3), len(words))
                    sums += model.sums(words, belongs)
            if sums[-1].any():
                yield rows(dict(enumerate(np.array_split(sums, _PARTS))))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for part, data in zip(batch["part"].to_pylist(), batch["sums"].to_pylist()):
                    sums[part] = sums.get(part, 0) + np.frombuffer(zstandard.decompress(data)).reshape(-1, classes)
            if sums:
                yield rows(sums)

        sent = packs.select("n", "word").mapInArrow(expect, _SPELLED)
        found = sorted(sent.repartition("part").mapInArrow(add, _SPELLED).collect(), key=lambda r: r["part"])
        model = model.refitted(
            np.concatenate([np.frombuffer(zstandard.decompress(r["sums"])).reshape(-1, classes) for r in found])
        )
    return model


@dataclass(frozen=True)
class Vocabulary:
    """Counts over all learned texts, and how codes and probabilities of words follow."""

    heads: dict[bytes, int]
    spelling: Spelling
    tokens: int
    distinct: int

    @property
    def tails(self) -> int:
        return len(self.spelling.share)


_COUNTED = "kind string, word binary, n long"
_ANSWERS = "block string, numbers binary, codes binary, counts binary, spelled binary, totals binary"
_CODED = "block string, codes binary, rows binary"
_SUMS = "part int, weight double, sums binary"


def _bucket_counts(group: pa.Table) -> tuple[list[list[bytes]], dict[bytes, int]]:
    words, counts = [], {}
    for packed, often in zip(group["words"].to_pylist(), group["counts"].to_pylist()):
        mine = unzip_words(packed)
        words.append(mine)
        for word, n in zip(mine, unzip_numbers(often).tolist()):
            counts[word] = counts.get(word, 0) + n
    return words, counts


def vocabulary(packs: DataFrame, *, words: int = WORDS, tails: int = TAILS) -> Vocabulary:
    """Counts of all learned words; the most frequent ones come to the driver, all others
    stay in packs, on which the spelling is fitted."""

    def count(group: pa.Table) -> pa.Table:
        _, counts = _bucket_counts(group)
        known = [(w, n) for w, n in counts.items() if n]
        top = sorted(known, key=lambda x: (-x[1], x[0]))[:words]
        learned = sorted(w for w, _ in known if w)
        first = group["bucket"][0].as_py() << 32
        rows = [("top", w, n) for w, n in top]
        rows += [("pack", zip_words(learned[i : i + PACK]), first + i) for i in range(0, len(learned), PACK)]
        often = np.bincount(np.frombuffer(b"".join(learned), np.uint8), minlength=256)
        rows += [("bytes", often.astype("<i8").tobytes(), 0)]
        rows += [("tokens", None, sum(n for _, n in known)), ("distinct", None, len(known))]
        kinds = (pa.string(), pa.binary(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["kind", "word", "n"])

    found = stored(packs.select("bucket", "words", "counts").groupBy("bucket").applyInArrow(count, _COUNTED), "counts")
    sums = {r["kind"]: r["n"] for r in found.where("kind IN ('tokens', 'distinct')").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    top = found.where("kind = 'top'").orderBy(F.desc("n"), "word").limit(words).collect()
    heads = {bytes(r["word"]): i for i, r in enumerate(top)}
    often = np.zeros(256, np.int64)
    for row in found.where("kind = 'bytes'").select("word").toLocalIterator():
        often += np.frombuffer(row["word"], "<i8")
    often -= np.bincount(np.frombuffer(b"".join(heads), np.uint8), minlength=256)
    spelling = fit_spelling(found.where("kind = 'pack'"), heads, often, tails)
    return Vocabulary(heads, spelling, sums.get("tokens", 0), sums.get("distinct", 0))


def coded(cut: DataFrame, known: Vocabulary, *, words: int = WORDS) -> tuple[DataFrame, np.ndarray]:
    """Blocks as codes, with each text's base score and tail score; and counts by code."""
    tails = known.tails

    def answer(group: pa.Table) -> pa.Table:
        packs, counts = _bucket_counts(group)
        distinct = list(counts)
        place = {w: i for i, w in enumerate(distinct)}
        rare = [w for w in distinct if w not in known.heads]
        kind, logs = known.spelling.classes(rare)
        code = np.array([known.heads.get(w, 0) for w in distinct], np.int64)
        spelled = np.zeros(len(distinct), np.int64)
        at = np.array([place[w] for w in rare], np.int64)
        code[at] = words + kind
        spelled[at] = np.ceil(-logs * _MILLI).astype(np.int64)
        often = np.array(list(counts.values()), np.int64)
        totals = np.zeros((4, words + tails), np.int64)
        for row, value in zip(totals, (often, often == 1, often == 2, often > 0)):
            np.add.at(row, code, value)
        rows: list[tuple] = [(None, None, None, None, None, zstandard.compress(totals.tobytes()))]
        for block, numbers, mine in zip(group["block"].to_pylist(), group["numbers"].to_pylist(), packs):
            i = np.array([place[w] for w in mine], np.int64)
            rows.append((block, numbers, zip_numbers(code[i]), zip_numbers(often[i]), zip_numbers(spelled[i]), None))
        kinds = [pa.string(), *[pa.binary()] * 5]
        names = ["block", "numbers", "codes", "counts", "spelled", "totals"]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    packs = cut.where("bucket >= 0").select("block", "bucket", "words", "numbers", "counts")
    answers = stored(packs.groupBy("bucket").applyInArrow(answer, _ANSWERS), "answers")
    totals = np.zeros((4, words + tails), np.int64)
    for row in answers.where("totals IS NOT NULL").select("totals").toLocalIterator():
        totals += np.frombuffer(zstandard.decompress(row["totals"]), np.int64).reshape(totals.shape)
    # absolute discounting: what seen words give up goes to spelling
    of_class, once, twice, types = totals[:, words:].astype(float)
    discount = np.clip((once + 0.5) / (once + 2 * twice + 1), 0.05, 0.95)
    unseen = np.where(of_class > 0, discount * types / np.maximum(of_class, 1), 1.0)
    base_of = known.tokens + 0.1 * (known.distinct + 1)

    def code(order: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        numbers = [unzip_numbers(n) for n in found["numbers"].to_pylist()]
        total = sum(map(len, numbers))
        codes, counts, spelled = (np.zeros(total, np.int64) for _ in range(3))
        for held, name in ((codes, "codes"), (counts, "counts"), (spelled, "spelled")):
            for at, values in zip(numbers, found[name].to_pylist()):
                held[at] = unzip_numbers(values)
        base = np.log10((counts + 0.1) / base_of)
        tail = np.zeros(total)
        rare = np.flatnonzero(codes >= words)
        kind = codes[rare] - words
        tail[rare] = np.log10(
            np.maximum(counts[rare] - discount[kind], 0) / np.maximum(of_class[kind], 1)
            + unseen[kind] * 10.0 ** (-spelled[rare] / _MILLI)
        )
        for block, mine, rows in zip(order["block"].to_pylist(), order["order"].to_pylist(), order["rows"].to_pylist()):
            number, held = unzip_numbers(mine), rows_of(rows)
            lengths = held["_words"].to_numpy()
            owner = np.repeat(np.arange(len(lengths)), lengths)
            for name, value in (("_base", base[number]), ("_tail", tail[number]), ("_known", counts[number] > 0)):
                held = held.append_column(name, pa.array(np.bincount(owner, value, len(lengths))))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held.schema) as writer:
                writer.write_table(held)
            out.append((block, zip_numbers(codes[number]), zstandard.compress(sink.getvalue().to_pybytes())))
        kinds = [pa.string(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["block", "codes", "rows"])

    orders = cut.where("bucket < 0").select("block", "order", "rows")
    mine = answers.where("block IS NOT NULL").drop("totals")
    whole = orders.groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(code, _CODED)
    return stored(whole, "coded"), totals[0]


def _network(counts: np.ndarray, words: int, hidden: int) -> Network:
    net = Network(words, len(counts) - words, PER_CLASS, hidden)
    net.start_from(counts.astype(float))
    return net


def trained(
    texts: DataFrame, counts: np.ndarray, *, words: int = WORDS, hidden: int = HIDDEN,
    rounds: int = ROUNDS, rate: float = RATE,
) -> Network:
    """The average, round by round, of networks that the tasks train on their blocks.

    Every learned text is trained on in one of the rounds, by truncated backpropagation
    with the state carried from window to window. What a task sends is its network, and
    networks are summed up part by part in a shuffle; the driver gets one.
    """
    net = _network(counts, words, hidden)
    for turn in range(rounds):
        start = net.flat()

        def learn(batches: Iterator[pa.RecordBatch], turn: int = turn, start: np.ndarray = start) -> Iterator[pa.RecordBatch]:
            own = _network(counts, words, hidden)
            own.load(start)
            trainer, seen = Trainer(own, rate), 0
            for batch in batches:
                for codes, rows in zip(batch["codes"].to_pylist(), batch["rows"].to_pylist()):
                    held = rows_of(rows)
                    lengths = held["_words"].to_numpy()
                    code = unzip_numbers(codes).astype(np.int64)
                    may = held["_learn"].to_numpy(zero_copy_only=False).astype(bool)
                    may &= (np.cumsum(may) + turn) % rounds == 0
                    if may.any():
                        code = code[np.repeat(may, lengths)]
                        train(trainer, code, lengths[may])
                        seen += len(code)
            if seen:
                parts = np.array_split(own.flat().astype(np.float64) * seen, _PARTS)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(_PARTS), pa.int32()), pa.array([float(seen)] * _PARTS),
                        pa.array([p.astype("<f4").tobytes() for p in parts], pa.binary()),
                    ],
                    ["part", "weight", "sums"],
                )

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            weights: dict[int, float] = {}
            for batch in batches:
                for part, weight, data in zip(*(batch[c].to_pylist() for c in ("part", "weight", "sums"))):
                    sums[part] = sums.get(part, 0) + np.frombuffer(data, "<f4").astype(np.float64)
                    weights[part] = weights.get(part, 0.0) + weight
            names = sorted(sums)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names, pa.int32()), pa.array([weights[p] for p in names], pa.float64()),
                    pa.array([sums[p].astype("<f8").tobytes() for p in names], pa.binary()),
                ],
                ["part", "weight", "sums"],
            )

        sent = texts.select("codes", "rows").mapInArrow(learn, _SUMS)
        rows = sorted(sent.repartition("part").mapInArrow(add, _SUMS).collect(), key=lambda r: r["part"])
        if not rows:
            break
        net.load(np.concatenate([np.frombuffer(r["sums"], "<f8") / r["weight"] for r in rows]).astype(np.float32))
    return net


def scored(docs: DataFrame, *, learn: Column, text: str = "text", words: int = WORDS) -> DataFrame:
    """``docs`` without the text, with what a language model of the texts that ``learn``
    names says of every text.

    Adds n_tokens (words and the end), n_known (tokens that learned texts hold),
    train_tokens, base_score (log10, one smoothed unigram) and score (log10 probability by
    the recurrent model). A frequent word's probability is that of its class times its
    softmax within the class; a rare word's is that of its tail class, times its share of
    the class or, for what the counts leave over, the chance of spelling it. Probabilities
    of all texts sum to at most one.

    Null and empty texts are their end alone; a null ``learn`` is false; repeated rows are
    learned and scored each. Without a learned text all counts are 0. Other columns stay.
    Names starting with an underscore are taken for the work on the way.
    """
    rest = [f for f in docs.schema.fields if f.name != text]
    buckets = buckets_for(docs)
    marked = docs.withColumn("_learn", F.coalesce(learn, F.lit(False)))
    cut = stored_by(
        blocks(marked, words_and_end, buckets=buckets, text=text, counted="_learn", block_bytes=BLOCK_BYTES),
        "lm-words", "block", buckets,
    )
    known = vocabulary(cut.where("bucket >= 0"), words=words)
    texts, counts = coded(cut, known, words=words)
    net = trained(texts, counts, words=words)
    flat, hidden = net.flat(), net.hidden
    names = [f.name for f in rest]
    tokens = known.tokens
    added = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    schema = T.StructType([*rest, *[T.StructField(n, k) for n, k in added]])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _network(counts, words, hidden)
        own.load(flat)
        for batch in batches:
            for codes, rows in zip(batch["codes"].to_pylist(), batch["rows"].to_pylist()):
                held = rows_of(rows).combine_chunks()
                lengths = held["_words"].to_numpy()
                logs = log_likelihoods(own, unzip_numbers(codes).astype(np.int64), lengths)
                columns = [held[n].combine_chunks() for n in names]
                columns += [
                    pa.array(lengths), pa.array(held["_known"].to_numpy().astype(np.int64)),
                    pa.array(np.full(len(lengths), tokens, np.int64)), held["_base"].combine_chunks(),
                    pa.array(logs / np.log(10) + held["_tail"].to_numpy()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    return texts.select("codes", "rows").mapInArrow(score, schema)


HELD_OUT_OF = 10


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held_out = remainder(F.col("doc_id"), HELD_OUT_OF) == 0
    return scored(docs, learn=~held_out).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
