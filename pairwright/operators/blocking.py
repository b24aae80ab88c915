"""TF-IDF character-gram blocking as an exact, prefix-filtered similarity join.

Work is done on distinct names: a name carried by a third of all rows is
compared once and its copies only reappear when pairs of ids are asked for.

Grams are ordered from rare to frequent. For a unit vector ``s`` the trailing
grams whose joint norm stays below the threshold are its *suffix*, the others
its *prefix*. If the first gram two names share lies in either suffix, then
their dot product is at most that suffix norm, hence below the threshold; so a
pair can only qualify by sharing a gram that is in both prefixes. The frequent
grams, whose posting lists would multiply into each other, are almost always in
the suffix on both sides and never joined with one another: their contribution
is added afterwards, to the pairs that can still reach the threshold. No pair is
lost and every score is the full dot product. A suffix holds a bounded number of
grams, so that adding it is cheap for texts of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairwright.functions.text import WHITESPACE
from pairwright.operators.lookup import spread
from pairwright.session import checkpointed

# Gram lengths and the similarity a candidate pair must reach.
GRAM_LENGTHS = (2, 3)
DEFAULT_THRESHOLD = 0.2

# Posting-list products above this are split over several tasks.
_PRODUCTS_PER_SALT = 1 << 24

# Longest suffix; any shorter suffix is equally valid.
_SUFFIX_GRAMS = 32

# Slack for rounding when a suffix norm is compared with the threshold.
_SLACK = 1e-9


def char_grams(name: Column) -> Column:
    """Lower-cased 2- and 3-grams across word boundaries, whitespace runs collapsed."""
    text = F.regexp_replace(F.lower(name), f"(?:{WHITESPACE[:-1]}){{2,}}", " ")
    grams = [F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}})).")) for n in GRAM_LENGTHS]
    return F.concat(*grams)


def gram_code(gram: Column) -> Column:
    """A gram as one integer, 21 bits per code point: exact, and cheap to join on."""
    points = [F.ascii(F.substring(gram, i, 1)).cast("bigint") for i in (1, 2, 3)]
    return F.shiftleft(points[0], 42) + F.shiftleft(points[1], 21) + points[2]


def distinct_names(records: DataFrame, side: str) -> DataFrame:
    """One row per name with its smallest id as key and its number of records."""
    return (
        records.select(F.col("id").cast("string").alias("id"), F.coalesce("name", F.lit("")).alias("name"))
        .groupBy("name")
        .agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
        .withColumn("side", F.lit(side))
    )


def gram_postings(names: DataFrame, threshold: float) -> DataFrame:
    """Unit-norm TF-IDF weight of every gram of every name, prefix grams marked."""
    total = names.agg(F.sum("copies")).first()[0] or 0
    counted = (
        names.select("side", "rep", "copies", F.explode(char_grams(F.col("name"))).alias("text"))
        .select("side", "rep", "copies", gram_code(F.col("text")).alias("gram"))
        .groupBy("side", "rep", "gram")
        .agg(F.count("*").alias("tf"), F.first("copies").alias("copies"))
    )
    frequency = counted.groupBy("gram").agg(
        F.sum("copies").alias("df"),
        F.sum((F.col("side") == "source").cast("bigint")).alias("source_names"),
        F.sum((F.col("side") == "target").cast("bigint")).alias("target_names"),
    )
    idf = F.log((1.0 + F.lit(float(total))) / (1.0 + F.col("df"))) + 1.0
    per_name = Window.partitionBy("side", "rep")
    # Running totals from the most frequent gram backwards: one sort, linear.
    backwards = per_name.orderBy(F.desc("df"), F.desc("gram"))
    weighted = counted.join(frequency, "gram").withColumn("raw", F.col("tf") * idf)
    mass = F.col("raw") * F.col("raw")
    leading = F.sqrt(F.col("rest") / F.col("mass")) >= threshold - _SLACK
    return (
        weighted.withColumn("rest", F.sum(mass).over(backwards.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("from_end", F.row_number().over(backwards))
        .withColumn("mass", F.sum(mass).over(per_name))
        .select(
            "side",
            "rep",
            "gram",
            (F.col("raw") / F.sqrt("mass")).alias("weight"),
            (leading | (F.col("from_end") > _SUFFIX_GRAMS)).alias("in_prefix"),
            F.greatest(
                F.lit(1),
                F.ceil(F.col("source_names") * F.col("target_names") / F.lit(float(_PRODUCTS_PER_SALT))),
            ).cast("int").alias("salts"),
        )
    )


def _salted_product(source: DataFrame, target: DataFrame) -> DataFrame:
    """Join two posting lists on the gram; a hot gram is spread over its salts.

    Postings are few bytes but multiply in the join, so both sides are placed by
    the join key in a fixed number of partitions instead of leaving that number
    to their size.
    """
    left = source.select(
        F.col("rep").alias("source_rep"),
        "gram",
        F.col("weight").alias("sw"),
        F.col("in_prefix").alias("sp"),
        F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int").alias("salt"),
    )
    right = target.select(
        F.col("rep").alias("target_rep"),
        "gram",
        F.col("weight").alias("tw"),
        F.col("in_prefix").alias("tp"),
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
    )
    keys = ["gram", "salt"]
    return spread(left, *keys).join(spread(right, *keys), keys).select(
        "source_rep",
        "target_rep",
        (F.col("sw") * F.col("tw")).alias("product"),
        (F.col("sp") & F.col("tp")).alias("decisive"),
    )


def _suffixes(postings: DataFrame, name: str) -> DataFrame:
    weight = F.col("weight")
    entries = F.collect_list(F.struct("gram", "weight"))
    return (
        postings.filter(~F.col("in_prefix"))
        .groupBy(F.col("rep").alias(f"{name}_rep"))
        .agg(
            (F.map_from_entries(entries) if name == "target" else entries).alias(f"{name}_suffix"),
            F.sqrt(F.sum(weight * weight)).alias(f"{name}_rest"),
        )
    )


def _suffix_dot(left: Column, right: Column) -> Column:
    """Dot product of a bounded sparse vector with one held as a map; 0 when missing."""
    dot = F.aggregate(
        left,
        F.lit(0.0),
        lambda acc, e: acc + e["weight"] * F.coalesce(F.try_element_at(right, e["gram"]), F.lit(0.0)),
    )
    return F.coalesce(dot, F.lit(0.0))


def similar_names(
    sources: DataFrame, targets: DataFrame, threshold: float = DEFAULT_THRESHOLD
) -> DataFrame:
    """Pairs of distinct names at or above the threshold, with their copy counts."""
    if threshold <= 0:
        raise ValueError("the threshold must be positive: at 0 every pair would qualify")
    left, right = distinct_names(sources, "source"), distinct_names(targets, "target")
    # Six reads follow, so the postings are computed once and kept in the shared folder.
    postings = checkpointed(spread(gram_postings(left.unionByName(right), threshold), "rep", "gram"))
    source = postings.filter(F.col("side") == "source")
    target = postings.filter(F.col("side") == "target")
    products = _salted_product(source.filter("in_prefix"), target).unionByName(
        _salted_product(source.filter(~F.col("in_prefix")), target.filter("in_prefix"))
    )
    candidates = (
        products.groupBy("source_rep", "target_rep")
        .agg(F.sum("product").alias("partial"), F.max("decisive").alias("decisive"))
        .filter("decisive")
    )
    # Adding the suffixes is per-pair work, so the candidates stay evenly spread.
    candidates = spread(candidates, "source_rep", "target_rep")
    reachable = F.col("partial") + F.coalesce(
        F.col("source_rest") * F.col("target_rest"), F.lit(0.0)
    )
    scored = (
        candidates.join(_suffixes(source, "source"), "source_rep", "left")
        .join(_suffixes(target, "target"), "target_rep", "left")
        .filter(reachable >= threshold - _SLACK)
        .select(
            "source_rep",
            "target_rep",
            (F.col("partial") + _suffix_dot(F.col("source_suffix"), F.col("target_suffix"))).alias(
                "similarity_score"
            ),
        )
        .filter(F.col("similarity_score") >= threshold)
    )
    return scored.join(
        left.select(
            F.col("rep").alias("source_rep"),
            F.col("name").alias("source_name"),
            F.col("copies").alias("source_copies"),
        ),
        "source_rep",
    ).join(
        right.select(
            F.col("rep").alias("target_rep"),
            F.col("name").alias("target_name"),
            F.col("copies").alias("target_copies"),
        ),
        "target_rep",
    )


def _ids_by_name(records: DataFrame, side: str) -> DataFrame:
    return records.select(
        F.col("id").cast("string").alias(f"{side}_id"),
        F.coalesce("name", F.lit("")).alias(f"{side}_name"),
    )


def candidate_pairs(
    sources: DataFrame, targets: DataFrame, threshold: float = DEFAULT_THRESHOLD
) -> DataFrame:
    """``source_id, target_id, similarity_score`` of every qualifying id pair."""
    names = similar_names(sources, targets, threshold).select(
        "source_name", "target_name", "similarity_score"
    )
    return (
        names.join(_ids_by_name(sources, "source"), "source_name")
        .join(_ids_by_name(targets, "target"), "target_name")
        .select("source_id", "target_id", "similarity_score")
    )


def candidate_classes(
    sources: DataFrame, targets: DataFrame, threshold: float = DEFAULT_THRESHOLD
) -> DataFrame:
    """The qualifying id pairs without expanding them: ``kind, left_id, right_id, similarity_score``.

    Records of one name are a class, named by its smallest id. A ``pair`` row links a source
    class with a target class; a ``source`` or ``target`` row says that the record on the right
    belongs to the class on the left. Joining them gives ``candidate_pairs``, which is quadratic
    in the copies; this grows with records and pairs of distinct names.
    """
    parts = []
    for side, records in (("source", sources), ("target", targets)):
        names = distinct_names(records, side).select(F.col("name").alias(f"{side}_name"), "rep")
        parts.append(
            _ids_by_name(records, side)
            .join(names, f"{side}_name")
            .select(
                F.lit(side).alias("kind"), F.col("rep").alias("left_id"), F.col(f"{side}_id").alias("right_id"),
                F.lit(None).cast("double").alias("similarity_score"),
            )
        )
    linked = similar_names(sources, targets, threshold).select(
        F.lit("pair").alias("kind"), F.col("source_rep").alias("left_id"), F.col("target_rep").alias("right_id"),
        "similarity_score",
    )
    return linked.unionByName(parts[0]).unionByName(parts[1])


def blocking_summary(names: DataFrame) -> DataFrame:
    """Count, range and mean of the similarity over id pairs, without expanding them."""
    weight = F.col("source_copies") * F.col("target_copies")
    return names.agg(
        F.coalesce(F.sum(weight), F.lit(0)).alias("n_pairs"),
        F.min("similarity_score").alias("min_similarity"),
        F.max("similarity_score").alias("max_similarity"),
        F.try_divide(F.sum(weight * F.col("similarity_score")), F.sum(weight)).alias("mean_similarity"),
    )


def blocking_recall(
    names: DataFrame, sources: DataFrame, targets: DataFrame, true_pairs: DataFrame
) -> DataFrame:
    """Share of the true pairs whose names were kept, looked up by name."""
    kept = names.select("source_name", "target_name", F.lit(True).alias("found"))
    located = (
        true_pairs.join(_ids_by_name(sources, "source"), "source_id", "left")
        .join(_ids_by_name(targets, "target"), "target_id", "left")
        .join(kept, ["source_name", "target_name"], "left")
    )
    found = F.coalesce(F.sum(F.col("found").cast("bigint")), F.lit(0))
    return located.agg(found.alias("found"), F.count("*").alias("true_matches")).withColumn(
        "recall", F.try_divide("found", "true_matches")
    )
