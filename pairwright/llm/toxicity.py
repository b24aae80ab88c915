"""Toxicity by compression distance to dictionaries of toxic and of ordinary text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright.llm.common import remainder, table, text_of

#: Bounds of the labelled sample that the driver fits on. Documents of at most
#: SAMPLE_CHARS characters, so many of each class; scoring has no such bounds.
TOXIC_SAMPLE = 1500
ORDINARY_SAMPLE = 3000
SAMPLE_CHARS = 40_000
#: Share of the sample that dictionaries are trained on; the rest calibrates.
DICTIONARY_SHARE = 0.6

WINDOW_BYTES = 32
GRAM = 5
_CONTEXT = 6
#: Both dictionaries of a pair start with this many bytes of common ordinary text.
SHARED_BYTES = 4096
#: Bytes of each pair's own part.
PAIR_BYTES = (1024, 1024, 1536)
THRESHOLD = 0.3
_MARGIN = 24


def windows(text: bytes, size: int = WINDOW_BYTES) -> Iterator[bytes]:
    """All of the text in runs of about ``size`` bytes that end before a space."""
    start, end = 0, len(text)
    while start < end:
        stop = start + size
        if stop < end:
            space = text.find(b" ", stop, stop + size)
            stop = stop if space < 0 else space
        yield text[start:stop]
        start = stop


def _lowered(text: str) -> bytes:
    return text.encode().lower()


def _grams(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte grams and in how many different surroundings each occurs.

    Surroundings, not documents, so that copies of one passage count once.
    """
    grams, contexts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    wide = GRAM + 2 * _CONTEXT
    for text in texts:
        data = np.frombuffer(b" " * (_CONTEXT + 1) + text + b" " * (_CONTEXT + 1), np.uint8)
        data = data.astype(np.uint64)
        n = len(data) - wide + 1
        gram, context = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        for k in range(GRAM):
            gram = (gram << np.uint64(8)) | data[_CONTEXT + k : _CONTEXT + k + n]
        for k in range(wide):
            context = context * np.uint64(1099511628211) + data[k : k + n]
        grams.append(gram)
        contexts.append(context)
    _, first = np.unique(np.concatenate(contexts), return_index=True)
    return np.unique(np.concatenate(grams)[first], return_counts=True)


def _telling(toxic: list[bytes], ordinary: list[bytes]) -> set[bytes]:
    """Grams of many surroundings in toxic text and next to none in ordinary text."""
    found, times = _grams(toxic)
    other, often = _grams(ordinary)
    if not len(found):
        return set()
    at = np.minimum(np.searchsorted(other, found), max(len(other) - 1, 0))
    known = np.where(other[at] == found, often[at], 0) if len(other) else np.zeros(len(found))
    odds = np.log((times + 0.5) / times.sum()) - np.log((known + 0.5) / max(1, often.sum()))
    chosen = found[(odds > 3.5) & (times >= max(3, 0.02 * len(toxic)))]
    return {int(g).to_bytes(GRAM, "big") for g in chosen}


def _telling_words(texts: list[bytes], grams: set[bytes]) -> list[bytes]:
    """Every occurrence of a word with a telling gram, cut to those grams."""
    cut: dict[bytes, bytes] = {}
    out = []
    for text in texts:
        for word in text.split():
            part = cut.get(word)
            if part is None:
                padded = b" " + word + b" "
                hits = [i for i in range(len(padded) - GRAM + 1) if padded[i : i + GRAM] in grams]
                part = cut[word] = padded[hits[0] : hits[-1] + GRAM] if hits else b""
            if part:
                out.append(part)
    return out


def _joined(parts: list[bytes], by: int) -> list[bytes]:
    return [b"".join(parts[i : i + by]) for i in range(0, len(parts), by)]


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A zstandard dictionary of the samples; their ends, where they are too few to train."""
    try:
        trained = zstandard.train_dictionary(size, samples, k=32, d=8).as_bytes()
    except zstandard.ZstdError:
        trained = b"".join(samples)[-size:]
    return trained.rjust(size, b"\0")[-size:]


@lru_cache(maxsize=16)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    plan = zstandard.ZstdCompressionParameters(
        compression_level=3, window_log=17, hash_log=17, chain_log=17, search_log=8,
        target_length=64, min_match=5, strategy=zstandard.STRATEGY_LAZY2,
        write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    held.precompute_compress(compression_params=plan)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=plan)


@dataclass(frozen=True)
class ToxicityModel:
    """Pairs of dictionary contents (ordinary, toxic) and the calibration over their margins."""

    pairs: tuple[tuple[bytes, bytes], ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]

    def margins(self, text: bytes) -> list[np.ndarray]:
        """Per pair, how many windows the toxic dictionary shortens by so many bytes more.

        A histogram, so that a text of any length needs the same memory.
        """
        out = [np.zeros(2 * _MARGIN + 1, np.int64) for _ in self.pairs]
        block: list[bytes] = []

        def add() -> None:
            for counts, (ordinary, toxic) in zip(out, self.pairs):
                a, b = _compressor(ordinary).compress, _compressor(toxic).compress
                gains = np.array([len(a(w)) - len(b(w)) for w in block])
                counts += np.bincount(np.clip(gains, -_MARGIN, _MARGIN) + _MARGIN, minlength=len(counts))

        for window in windows(text):
            block.append(window)
            if len(block) == 4096:
                add()
                block.clear()
        if block:
            add()
        return out

    def features(self, text: bytes) -> list[float]:
        out: list[float] = []
        for counts in self.margins(text):
            total = int(counts.sum())
            above = counts[::-1].cumsum()[::-1]
            best = [int(np.flatnonzero(above >= k)[-1]) - _MARGIN if total >= k else 0 for k in (1, 2, 3)]
            mean = float((counts * np.arange(-_MARGIN, _MARGIN + 1)).sum()) / max(1, total)
            out += [best[0], sum(best) / 3, mean]
            out += [float(np.log1p(above[_MARGIN + g])) for g in (3, 4, 5, 6)]
        return [*out, float(np.log1p(total))] if self.pairs else []

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.pairs:
            return np.full(len(texts), 1 / (1 + np.exp(-self.weights[0])))
        x = np.array([self.features(_lowered(t)) for t in texts]).reshape(len(texts), len(self.means))
        x = (x - np.array(self.means)) / np.array(self.scales)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ np.array(self.weights[1:]), -30, 30)))


def _calibrated(x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge-penalised logistic regression by damped Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    ridge = np.full(a.shape[1], 1.0)
    ridge[0] = 1e-3
    w = np.zeros(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (weight * (label - p)) - ridge * w
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        w += step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
    return w


#: Windows of ordinary text that train the dictionaries, and those for the shared part.
PLAIN_WINDOWS, SHARED_WINDOWS = 120_000, 60_000


def fit_texts(
    toxic: list[str], ordinary: list[str], rate: float, *,
    plain_windows: int = PLAIN_WINDOWS, shared_windows: int = SHARED_WINDOWS,
) -> ToxicityModel:
    """Train the dictionary pairs and calibrate; ``rate``: the share of toxic documents.

    Of the distinct windows of the ordinary texts ``plain_windows`` train, drawn at random:
    ``shared_windows`` of them the part that both dictionaries share, the others the
    ordinary part. Windows bound the training only; every text is scored whole.
    Without texts of both classes the model is the constant ``rate``.
    """
    prior = float(np.log((rate + 1e-6) / (1 - rate + 1e-6)))
    if len(toxic) < 2 or len(ordinary) < 2:
        return ToxicityModel((), (), (), (prior,))
    bad, good = [_lowered(t) for t in toxic], [_lowered(t) for t in ordinary]
    cut_bad = min(len(bad) - 1, max(1, int(len(bad) * DICTIONARY_SHARE)))
    cut_good = min(len(good) - 1, max(1, int(len(good) * DICTIONARY_SHARE)))
    words = _telling_words(bad[:cut_bad], _telling(bad[:cut_bad], good[:cut_good]))
    plain = list(dict.fromkeys(w for t in good[:cut_good] for w in windows(t)))
    order = np.random.default_rng(1).permutation(len(plain))
    plain = [plain[i] for i in order[:plain_windows]]
    base = _trained(SHARED_BYTES, plain[:shared_windows])
    pairs = []
    for k, size in enumerate(PAIR_BYTES):
        own = [words[i] for i in np.random.default_rng(k).permutation(len(words))]
        ordinary_part = _trained(size, _joined(plain[shared_windows:] or plain, 2))
        pairs.append((base + ordinary_part, base + _trained(size, _joined(own, 8))))
    raw = ToxicityModel(tuple(pairs), (), (), ())
    rest = [*bad[cut_bad:], *good[cut_good:]]
    x = np.array([raw.features(t) for t in rest])
    label = np.r_[np.ones(len(bad) - cut_bad), np.zeros(len(good) - cut_good)]
    weight = np.where(label == 1, rate / label.mean(), (1 - rate) / (1 - label.mean()))
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    w = _calibrated((x - mean) / scale, label, weight)
    return ToxicityModel(tuple(pairs), tuple(mean), tuple(scale), tuple(w))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, *, learn: Column | None = None,
    toxic_sample: int = TOXIC_SAMPLE, ordinary_sample: int = ORDINARY_SAMPLE,
    sample_chars: int = SAMPLE_CHARS,
) -> ToxicityModel:
    """Fit on a bounded sample of labelled rows, drawn by a hash of id and text.

    ``learn`` is a condition on doc_id. Rows with a null id, text or label teach
    nothing; a text that is labelled several times counts once, as toxic if any says so.
    """
    named = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")
    )
    if learn is not None:
        named = named.where(learn)
    whole = docs.where("text IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    known = named.groupBy("toxic").count().collect()
    counts = {r["toxic"]: r["count"] for r in known}
    rate = counts.get(1, 0) / max(1, sum(counts.values()))
    # candidates are drawn from the labels before the texts are looked up: a few times
    # the sample, so that long texts and copies can be left out
    chosen: dict[int, list[str]] = {}
    for value, size in ((1, toxic_sample), (0, ordinary_sample)):
        drawn = (
            named.where(F.col("toxic") == value)
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * size)
        )
        rows = (
            whole.join(drawn, "doc_id").where(F.length("text").between(1, sample_chars))
            .groupBy("text").agg(F.min("doc_id").alias("doc_id"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(size).collect()
        )
        chosen[value] = [r["text"] for r in rows]
    bad = set(chosen[1])
    return fit_texts(chosen[1], [t for t in chosen[0] if t not in bad], rate)


def toxicity_scores(
    docs: DataFrame, model: ToxicityModel, *, text: str = "text", into: str = "score"
) -> DataFrame:
    """``docs`` with the calibrated probability that a document is toxic.

    One pass without a shuffle over whole texts, window by window. A null or empty text
    has no window and gets the score of one without a sign; repeated rows get equal
    scores. A column already called ``into`` is replaced.
    """
    names = [c for c in docs.columns if c != into]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.scores([t or "" for t in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*names, into])

    source = docs.select(*[F.col(f"`{c}`") for c in names])
    schema = T.StructType([*source.schema.fields, T.StructField(into, T.DoubleType())])
    return source.mapInArrow(score, schema)


def harmless_documents(
    docs: DataFrame, model: ToxicityModel, *, threshold: float = THRESHOLD
) -> DataFrame:
    """The rows of ``docs`` whose score stays below the threshold."""
    scored = toxicity_scores(docs, model, into="_toxicity")
    return scored.where(F.col("_toxicity") < threshold).drop("_toxicity")


HELD_OUT_OF, HELD_OUT = 4, 2


def learned(spark: SparkSession, sf_dir: str, docs: DataFrame) -> ToxicityModel:
    """The model of the labels that may be learned from."""
    may = remainder(F.col("doc_id"), HELD_OUT_OF) != HELD_OUT
    return fit_toxicity(docs, table(spark, sf_dir, "labels"), learn=may)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text")).alias("text")
    )
    return toxicity_scores(docs, learned(spark, sf_dir, docs)).select(
        "doc_id",
        (remainder(F.col("doc_id"), HELD_OUT_OF) == HELD_OUT).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
