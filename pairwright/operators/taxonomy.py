"""Why a pair was decided wrongly: ordered rules over names, texts and reasoning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.text import WHITESPACE

# Word lists and patterns of the two taxonomies.
COLORS = (
    "black", "white", "silver", "red", "blue", "green", "gold", "pink", "gray", "grey", "purple",
    "brown", "orange", "yellow", "beige", "ivory", "chrome", "graphite", "titanium", "platinum",
    "midnight", "space gray", "rose gold", "matte", "glossy",
)
FORM_FACTORS = (
    "micro sd", "mini sd", "compact flash", "sdhc", "sdxc", "desktop", "laptop", "notebook",
    "tower", "mini", "portable", "internal", "external", "slim", "ultra-slim",
)
ACCESSORIES = (
    "case", "cover", "cable", "charger", "adapter", "mount", "stand", "dock", "battery", "strap",
    "screen protector", "stylus", "holder", "sleeve", "bag", "pouch", "remote", "replacement",
    "refill", "cartridge", "ink", "toner",
)
GENERIC = ("generic", "universal", "compatible", "replacement", "oem")
MODEL_NUMBER = r"[A-Z]{1,5}-?\d{2,}[A-Z]?"
FALSE_POSITIVE_HINTS = {
    "color variant": ("color", "colour"),
    "model variant": ("model number", "model variant", "suffix", "version"),
    "form factor": ("form factor", "size differ", "micro", "compact"),
    "accessory confusion": ("accessory", "cable", "case", "adapter"),
}
FALSE_NEGATIVE_HINTS = {
    "price mismatch": ("price", "cost", "expensive", "cheap"),
    "name mismatch": ("different name", "naming", "different brand", "brand mismatch"),
    "model number format": ("model number", "model format", "model differ", "identifier"),
    "sparse description": (
        "no description", "missing description", "lacking detail", "sparse", "insufficient",
    ),
}
PRICE_WORDS = ("price", "cost", "$")
SPARSE_BELOW = 10
PRICE_RATIO_ABOVE = 1.5
NAME_OVERLAP_BELOW = 0.3
OTHER = "other"

_WORD = r"[\p{L}\p{N}_]"


def whole_words(pattern: str) -> str:
    """A case-insensitive pattern with one group, between word boundaries."""
    return f"(?i)(?<!{_WORD})({pattern})(?!{_WORD})"


def found(text: Column, pattern: str) -> Column:
    """The set of whole-word occurrences of a pattern."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(whole_words(pattern)), F.lit(1)))


def color_words(text: Column) -> Column:
    return found(F.lower(text), "|".join(COLORS))


def model_numbers(text: Column) -> Column:
    return found(F.lower(text), MODEL_NUMBER)


def _mentions(words: tuple[str, ...], *texts: Column) -> Column:
    checks = [F.contains(text, F.lit(word)) for word in words for text in texts]
    result = checks[0]
    for check in checks[1:]:
        result = result | check
    return result


def _present(words: tuple[str, ...], *texts: Column) -> Column:
    """Which of the words occur as substrings, as a sorted array."""
    flags = [F.when(_mentions((word,), *texts), F.lit(word)) for word in words]
    return F.array_compact(F.array(*flags))


def _sets_differ(a: Column, b: Column) -> Column:
    same = (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
    return (F.size(a) > 0) & (F.size(b) > 0) & ~same


def _share_line(a: Column, b: Column) -> Column:
    """Some two model numbers agree on half the shorter one, at least two characters."""

    def akin(x: Column, y: Column) -> Column:
        half = F.floor(F.least(F.length(x), F.length(y)) / 2).cast("int")
        return (half >= 2) & (F.substring(x, F.lit(1), half) == F.substring(y, F.lit(1), half))

    return F.exists(a, lambda x: F.exists(b, lambda y: akin(x, y)))


def _by_hints(reasoning: Column, hints: dict[str, tuple[str, ...]]) -> Column:
    rule = None
    for category, words in hints.items():
        test = _mentions(words, reasoning)
        rule = F.when(test, category) if rule is None else rule.when(test, category)
    return rule.otherwise(OTHER)


_LOWERED = {
    "_sn": "source_name",
    "_tn": "target_name",
    "_sd": "source_description",
    "_td": "target_description",
    "_why": "reasoning",
}


def with_error_categories(rows: DataFrame) -> DataFrame:
    """Add ``fp_category`` and ``fn_category`` from the products and the reasoning.

    The texts are lower-cased in their own projection, once per row, because
    the rules look at them dozens of times.
    """
    lowered = rows.withColumns({name: F.lower(F.col(text)) for name, text in _LOWERED.items()})
    return lowered.withColumns(
        {"fp_category": _false_positive_category(), "fn_category": _false_negative_category()}
    ).drop(*_LOWERED)


def _false_positive_category() -> Column:
    sn, tn, sd, td, reasoning = (F.col(c) for c in _LOWERED)
    colors = color_words(F.concat_ws(" ", sn, sd)), color_words(F.concat_ws(" ", tn, td))
    forms = _present(FORM_FACTORS, sn, sd), _present(FORM_FACTORS, tn, td)
    models = model_numbers(sn), model_numbers(tn)
    return (
        F.when(_sets_differ(*colors), "color variant")
        .when(_sets_differ(*forms), "form factor")
        .when(_mentions(ACCESSORIES, sn, sd) != _mentions(ACCESSORIES, tn, td), "accessory confusion")
        .when(_sets_differ(*models) & _share_line(*models), "model variant")
        .when(_mentions(GENERIC, sn, sd) != _mentions(GENERIC, tn, td), "generic vs specific")
        .otherwise(_by_hints(reasoning, FALSE_POSITIVE_HINTS))
    )


def _false_negative_category() -> Column:
    sn, tn, _, _, reasoning = (F.col(c) for c in _LOWERED)

    def sparse(side: str) -> Column:
        return F.length(F.col(f"{side}_description")) < SPARSE_BELOW

    numbers = [F.col(f"{side}_price").cast("string").try_cast("double") for side in ("source", "target")]
    prices = [F.nanvl(n, F.lit(None).cast("double")) for n in numbers]
    gap = F.try_divide(F.greatest(*prices), F.least(*prices))
    far = (prices[0] > 0) & (prices[1] > 0) & (gap > PRICE_RATIO_ABOVE)
    models = model_numbers(sn), model_numbers(tn)
    plain = [F.transform(m, lambda v: F.replace(v, F.lit("-"), F.lit(""))) for m in models]
    words = [
        F.array_distinct(F.filter(F.split(n, WHITESPACE), lambda w: w != "")) for n in (sn, tn)
    ]
    overlap = F.try_divide(F.size(F.array_intersect(*words)), F.greatest(F.size(words[0]), F.size(words[1])))
    both_named = (F.size(words[0]) > 0) & (F.size(words[1]) > 0)
    return (
        F.when(sparse("source") | sparse("target"), "sparse description")
        .when(F.coalesce(far, F.lit(False)) & _mentions(PRICE_WORDS, reasoning), "price mismatch")
        .when(_sets_differ(*models) & F.arrays_overlap(*plain), "model number format")
        .when(both_named & (overlap < NAME_OVERLAP_BELOW), "name mismatch")
        .otherwise(_by_hints(reasoning, FALSE_NEGATIVE_HINTS))
    )
