"""Quality rules: a table of thresholds compiled into one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.common import WORD_GAP, table, text_of

_WHITE = " \t\n\x0b\x0c\r"
#: Fixed values of the rules' contract.
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Frequent function words of the languages served (fixed values).
STOP_WORDS = (
    "a and are as at be by for from in is it of on or that the this to was with "
    "das den der des die ein eine es für ich im ist mit nicht sich und von zu "
    "au avec dans de des en est et il la le les pas pour que qui sur un une "
    "al con del el en es la las lo los no para por que se su un una y"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes while ``at_least <= of / per * 100 <= at_most``.

    ``of`` and ``per`` name counts; without ``per`` the count itself is compared.
    A ratio over zero words or lines passes.
    """

    name: str
    of: str
    per: str | None = None
    at_least: int | None = None
    at_most: int | None = None

    def failed(self) -> Column:
        value = F.col(self.of) * (100 if self.per else 1)
        unit = F.col(self.per) if self.per else F.lit(1)
        out = F.lit(False)
        if self.at_least is not None:
            out = out | (value < self.at_least * unit)
        if self.at_most is not None:
            out = out | (value > self.at_most * unit)
        return out

    def sql(self) -> str:
        value = f"100 * {self.of}" if self.per else self.of
        unit = self.per or "1"
        bounds = []
        if self.at_least is not None:
            bounds.append(f"{value} < {self.at_least} * {unit}")
        if self.at_most is not None:
            bounds.append(f"{value} > {self.at_most} * {unit}")
        return "(" + " OR ".join(bounds) + ")"


#: What fails a document whatever the other thresholds are.
BASE_RULES = (
    Rule("few_words", "n_words", at_least=20),
    Rule("repeated_words", "n_repeat_words", "n_words", at_most=30),
)
RULES = (
    Rule("word_length", "word_chars", "n_words", at_least=250, at_most=1200),
    Rule("symbols", "n_symbols", "n_words", at_most=10),
    Rule("stop_words", "n_stop_words", "n_words", at_least=2),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", at_most=40),
    Rule("shouting", "n_exclamations", "n_words", at_most=50),
    Rule("capitals", "n_capitals", "word_chars", at_most=50),
)


def quality_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` and the counts that the rules compare, all long.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words,
    n_exclamations, n_capitals, n_lines (lines with a word).
    Built from column functions only: one pass, no shuffle, no user function. Windows
    are compared by 64-bit hashes within their text; only texts that have an equal pair
    are sorted. A null or empty text, or one of white space, has 0 everywhere; a text of
    fewer than eight words has no window. Repeated rows are counted each. Columns of
    ``docs`` that have these names are replaced.
    """
    whole = F.col("_text")
    words, lines, hashes = F.col("_words"), F.col("_lines"), F.col("_hashes")
    bare = F.btrim(whole, F.lit(_WHITE))

    def long(c: Column) -> Column:
        return c.cast("long")

    def less(chars: str) -> Column:
        return F.length(whole) - F.length(F.translate(whole, chars, ""))

    order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    at = F.col("_at")
    twice = F.when(
        F.size(F.array_distinct(hashes)) < F.size(hashes),
        F.array_sort(
            F.transform(
                F.filter(
                    F.col("_order"),
                    lambda x, j: F.coalesce(
                        F.get(F.col("_order"), j - 1)["h"] == x["h"], F.lit(False)
                    )
                    | F.coalesce(F.get(F.col("_order"), j + 1)["h"] == x["h"], F.lit(False)),
                ),
                lambda x: x["i"],
            )
        ),
    )
    covered = F.aggregate(
        F.transform(at, lambda i, k: F.least(F.coalesce(F.get(at, k + 1) - i, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0),
        lambda total, n: total + n,
    )
    step = (
        docs.withColumn("_text", text_of(F.col(text)))
        .withColumn("_words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_GAP)))
        .withColumn("_lines", F.filter(F.split(whole, "\n"), lambda line: F.btrim(line, F.lit(_WHITE)) != ""))
        .withColumn(
            "_hashes",
            F.when(
                F.size(words) >= WINDOW,
                F.transform(
                    F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)),
                    lambda i: F.xxhash64(F.slice(words, i, WINDOW)),
                ),
            ).otherwise(F.array().cast("array<bigint>")),
        )
        .withColumn("_order", F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), order))
        .withColumn("_at", twice)
    )
    stops = [F.lit(w) for w in sorted(set(STOP_WORDS))]
    return (
        step.withColumn("n_words", long(F.size(words)))
        .withColumn("word_chars", long(F.length(F.translate(whole, _WHITE, ""))))
        .withColumn("n_symbols", long(less(SYMBOLS)))
        .withColumn("n_dup_lines", long(F.size(lines) - F.size(F.array_distinct(lines))))
        .withColumn("n_repeat_words", long(F.coalesce(covered, F.lit(0))))
        .withColumn("n_stop_words", long(F.size(F.filter(words, lambda w: F.lower(w).isin(*stops)))))
        .withColumn("n_exclamations", long(less("!")))
        .withColumn("n_capitals", long(less("ABCDEFGHIJKLMNOPQRSTUVWXYZ")))
        .withColumn("n_lines", long(F.size(lines)))
        .drop("_text", "_words", "_lines", "_hashes", "_order", "_at")
    )


def quality_verdicts(
    docs: DataFrame,
    *,
    text: str = "text",
    base_rules: tuple[Rule, ...] = BASE_RULES,
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``failed_rules`` (names) and ``kept``."""
    failed = F.filter(
        F.array(*[F.when(r.failed(), F.lit(r.name)) for r in (*base_rules, *rules)]),
        lambda name: name.isNotNull(),
    )
    base = [F.lit(r.name) for r in base_rules]
    return (
        quality_counts(docs, text)
        .withColumn("failed_rules", failed)
        .withColumn("base_failed", F.arrays_overlap("failed_rules", F.array(*base)))
        .withColumn("kept", F.size("failed_rules") == 0)
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass every rule, with the columns of ``docs``."""
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    # a filter isn't pushed below a row number that it asks for: pushed down, it would
    # hold every count's expression as often as a later one names it
    verdicts = quality_verdicts(plain).withColumn("_row", F.monotonically_increasing_id())
    return verdicts.where("kept AND _row >= 0").select("row.*")


_SHOWN = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return quality_verdicts(docs).select(*_SHOWN)


def _any(rules: tuple[Rule, ...]) -> str:
    return " OR ".join(r.sql() for r in rules)


_STOP_SQL = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM d
), windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w) AS times FROM (
    SELECT r, i, list_slice(words, i, i + 7) AS w
    FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM split)
  )
), covered AS (
  SELECT r, count(DISTINCT i + o) AS n_repeat_words
  FROM windows, (SELECT unnest(range(0, 8)) AS o) WHERE times > 1 GROUP BY r
), counts AS (
  SELECT s.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(list_filter(words, lambda x: lower(x) IN ({_STOP_SQL}))) AS BIGINT) AS n_stop_words,
    length(text) - length(replace(text, '!', '')) AS n_exclamations,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals,
    len(lines) AS n_lines
  FROM split s LEFT JOIN covered USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  ({_any(BASE_RULES)}) AS base_failed, NOT ({_any(BASE_RULES + RULES)}) AS kept
FROM counts
"""
