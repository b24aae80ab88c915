"""Pair similarities as Column expressions: names, descriptions and prices.

Two Jaccard conventions exist on purpose. The features treat two empty token
sets as identical (1.0); the agent tool treats them as unrelated (0.0). There
are likewise two price readers: the feature reader strips ``$`` and ``,`` and
needs the whole string to be a number, the tool reader takes the first run of
digits it meets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwright.functions.bags import bm25, cosine_tfidf, cosine_tokens, jaccard_qgrams  # noqa: F401
from pairwright.functions.text import let, words

# Fixed value: price ratio from which two prices are similar.
PRICE_SIMILAR_RATIO = 0.8


def _bound(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """Evaluate ``values`` once per row and hand them to ``body`` as one struct."""
    return let(F.struct(*[value.alias(name) for name, value in values.items()]), body)


def _set_jaccard(a: Column, b: Column, both_empty: float) -> Column:
    def score(sets: Column) -> Column:
        shared = F.size(F.array_intersect(sets["a"], sets["b"]))
        total = F.size(sets["a"]) + F.size(sets["b"]) - shared
        return F.when(total == 0, F.lit(both_empty)).otherwise(F.try_divide(shared, total))

    return _bound({"a": F.array_distinct(a), "b": F.array_distinct(b)}, score)


def jaccard_tokens(a: Column, b: Column) -> Column:
    return _set_jaccard(words(a), words(b), 1.0)


def tool_jaccard(a: Column, b: Column) -> Column:
    return _set_jaccard(words(a), words(b), 0.0)


def tool_bm25(a: Column, b: Column) -> Column:
    """Symmetric BM25 of two names, squashed to [0, 1) and rounded to 4 digits."""
    score = bm25(a, b)
    return F.when(score > 0, F.round(score / (score + 1.0), 4)).otherwise(0.0)


def lev_dist(a: Column, b: Column) -> Column:
    return F.levenshtein(F.lower(a), F.lower(b)).cast("double")


def lev_sim(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(F.lower(a)), F.length(F.lower(b)))
    return F.when(longest == 0, F.lit(1.0)).otherwise(
        1.0 - F.try_divide(lev_dist(a, b), longest)
    )


#: Spellings of a number that count as one.
DECIMAL = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def parse_price(price: Column) -> Column:
    """Number in a price string without ``$`` and ``,``; null when there is none.

    Only decimal spellings count: the cast alone would also take ``5d`` or ``0x1p3``.
    """
    bare = F.trim(F.translate(price.cast("string"), "$,", ""))
    number = F.when(bare.rlike(DECIMAL), bare.try_cast("double"))
    usable = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    return F.when(usable, number)


def price_exact_match(a: Column, b: Column) -> Column:
    return F.coalesce((parse_price(a) == parse_price(b)).cast("double"), F.lit(0.0))


def abs_norm(a: Column, b: Column) -> Column:
    x, y = parse_price(a), parse_price(b)
    largest = F.greatest(F.abs(x), F.abs(y))
    return (
        F.when(x.isNull() | y.isNull(), F.lit(0.5))
        .when(largest == 0, F.lit(1.0))
        .otherwise(1.0 - F.try_divide(F.abs(x - y), largest))
    )


def price_lev_dist(a: Column, b: Column) -> Column:
    return lev_dist(a.cast("string"), b.cast("string"))


def price_lev_sim(a: Column, b: Column) -> Column:
    return lev_sim(a.cast("string"), b.cast("string"))


def first_number(price: Column) -> Column:
    """First digit run of a price string, as the price tool reads it."""
    return F.regexp_extract(price, r"[0-9]+\.?[0-9]*", 0).try_cast("double")


def compare_prices(a: Column, b: Column) -> Column:
    """Struct of both numbers, ratio, difference and the similarity flag."""
    x, y = first_number(a), first_number(b)
    both = x.isNotNull() & y.isNotNull()
    ratio = F.when(F.greatest(x, y) > 0, F.try_divide(F.least(x, y), F.greatest(x, y))).otherwise(1.0)
    return F.struct(
        F.when(both, x).alias("price_a"),
        F.when(both, y).alias("price_b"),
        F.when(both, F.round(ratio, 4)).alias("ratio"),
        F.when(both, F.round(F.abs(x - y), 2)).alias("absolute_diff"),
        F.when(both, ratio >= PRICE_SIMILAR_RATIO).alias("similar"),
        F.when(~both, F.lit("unparseable")).alias("note"),
    )


def embedding_cosine(a: Column, b: Column) -> Column:
    """Dot product of two unit-norm vectors; 0 when either is missing or empty."""
    dot = F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )
    usable = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(F.coalesce(usable, F.lit(False)), dot).otherwise(0.0)


def display_price(price: Column) -> Column:
    """Price as shown in a prompt: missing values read ``N/A``."""
    missing = price.isNull() | F.lower(price).isin("nan", "none", "")
    return F.when(missing, F.lit("N/A")).otherwise(price)
