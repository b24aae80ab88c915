"""Personal data: labelers vote on spans, EM weighs them, a classifier decides."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.common import table, text_of

#: Kinds and their patterns. Possessive loops, and a start only where a run starts or the
#: last match ended, give the same matches as the plain patterns in time linear in the text.
KINDS = ("email", "ip", "card", "phone")
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-](?:[\x20().-]*+[0-9])++",
}
#: Spellings that the strict patterns leave out.
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}+"
    r"(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]{1,63}+)++",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){7}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20._/-]{1,3}+[0-9]{4}){2}[\x20._/-]{1,3}+[0-9]{1,7}+(?![0-9])",
    "phone": r"(?<![0-9+.])(?:00[1-9][0-9]{0,2}[\x20.-])?\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20.-][0-9]{3,4}(?!\.?[0-9])",
}
#: A text without these holds no candidate.
_ANY = r"[0-9@]|[\[(]at[\])]"

#: Gazetteers and context words (fixed values).
TOP_LEVEL = "com org net edu gov mil int info biz io co eu uk de fr es it nl us ca au ch at be".split()
CARD_PREFIX = r"^(?:4|5[1-5]|2[2-7]|3[47]|6)"
CALLING_CODE = r"^\+?(?:00)?(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CONTEXT = {
    "email": r"(?i)(?:e-?mail|contact|write|reach|mailto|correo|courriel)",
    "ip": r"(?i)(?:\bip\b|address|host|server|login|logged|adresse)",
    "card": r"(?i)(?:card|visa|master|amex|credit|payment|karte|carte|tarjeta)",
    "phone": r"(?i)(?:phone|tel\b|tel[.:]|call|mobile|fax|whatsapp|telefon|teléfono|téléphone)",
}
AGAINST = r"(?i)(?:version|release|isbn|order|invoice|serial|ticket|section|\bv\.?|[$€£#])\s*$"

#: What a classifier looks at; the names say which labeler it comes from.
VOTES = ("regex", "gazetteer", "context", "against", "shape")
FEATURES = ("bias", *VOTES, "loose", "long")
ROUNDS = 30
_CONTEXT_CHARS = 40
_BLOCK = 64


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where lambdas of ``use`` read it."""
    return F.get(F.transform(F.array(value), use), 0)


def _starts(lengths: Column) -> Column:
    """Running sums before each element, over blocks so that no prefix is summed whole.

    ``lengths`` and what is read in lambdas have to be values bound by ``_let``.
    """
    block = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int"))
    sums = F.transform(block, lambda b: _sum(F.slice(lengths, b * _BLOCK + 1, _BLOCK)))

    def before(shifts: Column) -> Column:
        return F.transform(
            lengths,
            lambda _, i: F.get(shifts, F.floor(i / _BLOCK).cast("int"))
            + _sum(F.slice(lengths, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK)),
        )

    def shifted(held: Column) -> Column:
        return _let(F.transform(held, lambda _, b: _sum(F.slice(held, 1, b))), before)

    return _let(sums, shifted)


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda total, n: total + n)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits, at most 19, pass the check."""
    places = F.sequence(F.lit(1), F.length(digits))

    def value(i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) + 1 - i, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(i % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

    return _sum(F.transform(places, value)) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    """Whether a strict match passes the check of its kind."""
    digits = _digits(match)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = F.split(match, r"\.")
        return F.forall(part, lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        sized = F.length(digits).between(13, 19)
        return sized & F.when(sized, _luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(9, 15)


def _votes(kind: str, strict: bool, match: Column, holds: Column, before: Column, after: Column) -> dict[str, Column]:
    """What each labeler says of a span: 1 for, 0 against, -1 nothing."""
    digits = _digits(match)
    one, none, nay = F.lit(1), F.lit(-1), F.lit(0)

    def says(test: Column) -> Column:
        return F.when(test, one).otherwise(nay)

    if kind == "email":
        gazetteer = says(F.lower(F.regexp_extract(match, "([A-Za-z]+)$", 1)).isin(TOP_LEVEL))
        shape = says(match.rlike("^[A-Za-z0-9]") & (F.length(match) <= 254))
    elif kind == "ip":
        gazetteer = F.when(match.rlike(r"^(?:0|22[4-9]|2[3-9][0-9])\."), nay).otherwise(none)
        shape = says(match.rlike(r"^[1-9][0-9]{0,2}\.|:"))
    elif kind == "card":
        gazetteer = says(digits.rlike(CARD_PREFIX))
        shape = says(F.length(digits).between(13, 19) & holds)
    else:
        gazetteer = F.when(match.rlike(r"^\+|^00"), says(match.rlike(CALLING_CODE))).otherwise(none)
        shape = says(F.length(digits).between(9, 13))
    glued = after.rlike("^[A-Za-z0-9_]") | before.rlike("[A-Za-z0-9_]$")
    return {
        "regex": F.when(holds, one).otherwise(nay) if strict else none,
        "gazetteer": gazetteer,
        "context": F.when(before.rlike(CONTEXT[kind]), one).otherwise(none),
        "against": F.when(before.rlike(AGAINST) | glued, nay).otherwise(none),
        "shape": shape,
    }


def _found(text: Column, kind: str, strict: bool) -> Column:
    """All matches of a pattern in text order, with votes: an array of structs.

    Positions count code points; ``gap`` is the text before the match, since the last.
    """
    pattern = (STRICT if strict else LOOSE)[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    return F.when(F.size(matches) > 0, F.arrays_zip(matches.alias("match"), gaps.alias("gap")))


def _spans(found: Column, kind: str, strict: bool) -> Column:
    """Structs of the matches in ``found`` (zipped with gaps, one gap more than matches)."""

    def span(x: Column) -> Column:
        start = x["start"]
        before = F.substring(x["gap"], -_CONTEXT_CHARS, _CONTEXT_CHARS)
        after = x["after"]
        holds = _holds(kind, x["match"])
        votes = _votes(kind, strict, x["match"], holds, before, after)
        return F.struct(
            start.cast("int").alias("start"),
            (start + F.length(x["match"])).cast("int").alias("end"),
            (holds if strict else F.lit(False)).alias("base"),
            *[v.cast("int").alias(n) for n, v in votes.items()],
            F.lit(0 if strict else 1).alias("loose"),
            F.when(F.length(x["match"]) > 20, 1).otherwise(0).alias("long"),
        )

    def placed(every: Column, ends: Column) -> Column:
        matched = F.slice(every, 1, F.size(every) - 1)
        return F.transform(matched, lambda x, i: F.struct(
            x["match"].alias("match"), x["gap"].alias("gap"),
            (F.get(ends, i) + F.length(x["gap"])).alias("start"),
            F.substring(F.get(every, i + 1)["gap"], 1, 1).alias("after"),
        ))

    def spans(every: Column) -> Column:
        lengths = F.transform(every, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["match"]), F.lit(0)))
        return _let(_let(lengths, _starts), lambda ends: F.transform(placed(every, ends), span))

    return F.when(found.isNotNull(), _let(found, spans))


def _rebuilt(found: Column, text: Column, spans: Column, drop, fill) -> Column:
    """The text with the matches that ``drop`` names written as ``fill`` says."""
    parts = _let(spans, lambda held: F.transform(
        found,
        lambda x, i: F.concat(
            x["gap"],
            F.when(x["match"].isNull(), "")
            .when(drop(F.get(held, i)), fill(x["match"]))
            .otherwise(x["match"]),
        ),
    ))
    return F.when(found.isNull(), text).otherwise(F.array_join(parts, ""))


def _with_candidates(docs: DataFrame, text: Column) -> DataFrame:
    """Adds ``_s_kind`` and ``_l_kind``, arrays of strict and loose spans, null where none."""
    out = docs.withColumn("_text", text).withColumn("_hit", F.col("_text").rlike(_ANY))
    for kind in KINDS:
        out = out.withColumn(f"_f_{kind}", F.when(F.col("_hit"), _found(F.col("_text"), kind, True)))
        out = out.withColumn(f"_s_{kind}", _spans(F.col(f"_f_{kind}"), kind, True))
        hidden = _rebuilt(
            F.col(f"_f_{kind}"), F.col("_text"), F.col(f"_s_{kind}"),
            lambda s: s["base"], lambda m: F.repeat(F.lit("\x01"), F.length(m)),
        )
        out = out.withColumn(f"_m_{kind}", F.when(F.col("_hit"), hidden))
        out = out.withColumn(f"_g_{kind}", F.when(F.col("_hit"), _found(F.col(f"_m_{kind}"), kind, False)))
        out = out.withColumn(f"_l_{kind}", _spans(F.col(f"_g_{kind}"), kind, False))
    return out


@dataclass(frozen=True)
class SpanModel:
    """Weights of the final classifier, and how reliable EM found the labelers, by kind."""

    weights: dict[str, tuple[float, ...]]
    reliabilities: dict[str, dict[str, float]]

    def accepts(self, kind: str) -> Callable[[Column], Column]:
        """A base span stays; another needs a probability of at least one half."""
        bias, *weights = self.weights[kind]

        def accepted(span: Column) -> Column:
            score = F.lit(bias)
            for name, weight in zip(FEATURES[1:], weights):
                value = F.when(span[name] == 1, 1.0).when(span[name] == 0, -1.0).otherwise(0.0)
                score = score + (span[name] if name in ("loose", "long") else value) * F.lit(weight)
            return span["base"] | (score >= 0)

        return accepted


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """EM for two classes and labelers that may abstain: posteriors, P(vote | class).

    Starts from the majority of the votes; add-one smoothing keeps every rate inside
    (0, 1), so the result is defined for any counts, none included.
    """
    posterior = 1 / (1 + np.exp(-2.0 * (np.where(votes < 0, 0, 2 * votes - 1)).sum(1) - 0.5))
    rates = np.full((2, votes.shape[1], 3), 1 / 3)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        for v in (-1, 0, 1):
            rates[:, :, v + 1] = 1 + weight @ (votes == v)
        rates /= rates.sum(2, keepdims=True)
        prior = (1 + weight.sum(1)) / (2 + weight.sum())
        log = np.log(prior)[:, None] + np.log(
            np.take_along_axis(rates[:, None], (votes + 1)[None, :, :, None], 3)[..., 0]
        ).sum(2)
        posterior = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return posterior, rates


def _logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps for a ridge-penalised logistic regression on soft labels."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (target - p)) - ridge * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(hessian, gradient)
    return w


def fit_spans(docs: DataFrame, *, text: str = "text") -> SpanModel:
    """Weigh the labelers by EM over all candidates of ``docs``, and train the classifier.

    Each kind has labelers, and so reliabilities and weights, of its own. Spark counts the
    vote patterns (at most a few hundred a kind, whatever the corpus); only those counts
    come to the driver, where EM and the regression are small sums.
    """
    found = _with_candidates(docs.select(F.col(text).alias("text")), text_of(F.col("text")))
    columns = (*VOTES, "loose", "long")

    def patterns(kind: str) -> Column:
        spans = F.concat(*[F.coalesce(F.col(f"_{p}_{kind}"), F.array()) for p in "sl"])
        return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), *[s[c].alias(c) for c in columns]))

    rows = (
        found.select(F.explode(F.concat(*map(patterns, KINDS))).alias("s"))
        .groupBy(*[F.col(f"s.{c}").alias(c) for c in ("kind", *columns)])
        .agg(F.count("*").alias("n"))
        .orderBy("kind", *columns)
        .collect()
    )
    weights, right = {}, {}
    for kind in KINDS:
        mine = [list(r)[1:] for r in rows if r["kind"] == kind]
        data = np.array(mine, float).reshape(len(mine), len(columns) + 1)
        votes, counts = data[:, : len(VOTES)].astype(int), data[:, -1]
        posterior, rates = reliabilities(votes, counts)
        signed = np.where(votes < 0, 0, 2 * votes - 1)
        x = np.column_stack([np.ones(len(mine)), signed, data[:, len(VOTES) : -1]])
        weights[kind] = tuple(map(float, _logistic(x, posterior, counts)))
        right[kind] = {n: float(rates[1, j, 2] / (rates[1, j, 1] + rates[1, j, 2])) for j, n in enumerate(VOTES)}
    return SpanModel(weights, right)


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def personal_spans(docs: DataFrame, model: SpanModel, *, text: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``: arrays of kind, start and end.

    Ordered by kind as listed, then by start; positions count code points, ends are
    exclusive. Spans of one kind don't overlap. Null and empty texts have none, repeated
    rows each have theirs. Patterns take time linear in the text, also for a text that is
    one run of digits or dots; places are sums over blocks of matches, and arrays that
    lambdas read are computed once, so thousands of matches in a text cost in proportion.
    """
    found = _with_candidates(docs, text_of(F.col(text)))

    def of(kind: str, spans: Column, keep) -> Column:
        kept = F.filter(F.coalesce(spans, F.array()), keep)
        return F.transform(kept, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    base, every = [], []
    for kind in KINDS:
        strict, loose = F.col(f"_s_{kind}"), F.col(f"_l_{kind}")
        base.append(of(kind, strict, lambda s: s["base"]))
        more = F.concat(of(kind, strict, model.accepts(kind)), of(kind, loose, model.accepts(kind)))
        every.append(F.array_sort(more))
    for kind, spans in zip(KINDS, every):
        found = found.withColumn(f"_a_{kind}", spans)

    def apart(kind: str) -> Column:
        # an accepted span that fails its check may reach into a loose one: the first stays
        return _let(F.col(f"_a_{kind}"), lambda accepted: F.filter(
            accepted,
            lambda s, i: F.coalesce(F.get(accepted, i - 1)["end"] <= s["start"], F.lit(True)),
        ))

    return (
        found.withColumn("base_spans", F.concat(*base))
        .withColumn("spans", F.concat(*map(apart, KINDS)))
        .drop("_text", "_hit", *[f"_{p}_{k}" for k in KINDS for p in "fsmgla"])
    )


def redacted(docs: DataFrame, model: SpanModel, *, text: str = "text") -> DataFrame:
    """``docs`` with every found span written as its kind in brackets, kind after kind.

    Texts without a candidate stay as they are, null ones null; ``n_chars``, where there
    is one, follows the text.
    """
    names = docs.columns
    out = docs.withColumn("_text", F.col(text).cast("string"))
    out = out.withColumn("_hit", F.coalesce(F.col("_text").rlike(_ANY), F.lit(False)))
    for kind in KINDS:
        for strict in (True, False):
            out = out.withColumn("_f", F.when(F.col("_hit"), _found(F.col("_text"), kind, strict)))
            out = out.withColumn("_s", _spans(F.col("_f"), kind, strict))
            mark = F.lit(f"[{kind.upper()}]")
            out = out.withColumn(
                "_text",
                _rebuilt(F.col("_f"), F.col("_text"), F.col("_s"), model.accepts(kind), lambda _, m=mark: m),
            )
    replaced = {text: F.col("_text")}
    if "n_chars" in names:
        kind_of = docs.schema["n_chars"].dataType
        replaced["n_chars"] = F.when(F.col("_hit"), F.length("_text").cast(kind_of)).otherwise(F.col("n_chars"))
    return out.select(*[replaced.get(c, F.col(f"`{c}`")).alias(c) for c in names])


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = personal_spans(docs, fit_spans(docs))
    base = F.col("base_spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, KINDS), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans")
    )
