"""Queries over pair similarities and the feature matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions import alignment as A
from pairwright.functions import similarity as S
from pairwright.functions import text as X
from pairwright.operators.features import FEATURE_NAMES, feature_summary, pair_features
from pairwright.operators.lookup import attach_products
from pairwright.plans import standins as B
from pairwright.plans.registry import registered

_WS = r"[\t-\r\x1c-\x1f\x{{85}}\p{{Z}}]+"
_WORDS = "list_filter(regexp_split_to_array(lower({t}), '" + _WS + "'), lambda x: x <> '')"
_TERMS = r"regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}_]{{2,}}')"

# Word counts of both sides of every text pair, one row per pair and word.
_BAG_SQL = """
{name}_a AS (SELECT {key}, w, count(*) AS n FROM (SELECT {key}, unnest({left}) AS w FROM {src}) GROUP BY ALL),
{name}_b AS (SELECT {key}, w, count(*) AS n FROM (SELECT {key}, unnest({right}) AS w FROM {src}) GROUP BY ALL),
{name} AS (
  SELECT {key}, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y
  FROM {name}_a a FULL JOIN {name}_b b USING ({key}, w))
"""


def _bag(name: str, src: str, key: str, left: str, right: str, tokens: str) -> str:
    return _BAG_SQL.format(
        name=name, src=src, key=key, left=tokens.format(t=left), right=tokens.format(t=right)
    )


def _text_bag(tokens: str) -> str:
    return "WITH " + B.TEXT_PAIRS_SQL + "," + _bag(
        "bag", "text_pairs", "doc_id", "text_a", "text_b", tokens
    )


@registered(
    _text_bag(_WORDS)
    + """
SELECT doc_id, round(coalesce(j, 1.0), 6) AS jaccard_features, round(coalesce(j, 0.0), 6) AS jaccard_tool
FROM text_pairs LEFT JOIN (
  SELECT doc_id, sum(CAST(x > 0 AND y > 0 AS INT)) / count(*) AS j FROM bag GROUP BY doc_id) USING (doc_id)
"""
)
def text_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = B.text_pairs(spark, sf_dir)
    return pairs.select(
        "doc_id",
        F.round(S.jaccard_tokens(F.col("text_a"), F.col("text_b")), 6).alias("jaccard_features"),
        F.round(S.tool_jaccard(F.col("text_a"), F.col("text_b")), 6).alias("jaccard_tool"),
    )


_GRAM_LIST = (
    "CASE WHEN length({t}) >= 3 THEN list_transform(range(1, length({t}) - 1), lambda i: substr(lower({t}), i, 3))"
    " WHEN length({t}) > 0 THEN [lower({t})] ELSE [] END"
)


@registered(
    "WITH " + B.TEXT_PAIRS_SQL + """,
gram_positions AS (
  SELECT doc_id, string_split(lower(text), '') AS c, unnest(range(1, greatest(length(text) - 1, 2))) AS i FROM documents),
grams AS (SELECT DISTINCT doc_id, concat(c[i], c[i + 1], c[i + 2]) AS g FROM gram_positions),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
shared AS (
  SELECT a.doc_id, count(*) AS k FROM grams a JOIN grams b ON b.doc_id = a.doc_id + 1 AND b.g = a.g GROUP BY 1)
SELECT t.doc_id, round(coalesce(k, 0) / (a.n + b.n - coalesce(k, 0)), 6) AS jaccard_qgm3
FROM text_pairs t JOIN sizes a ON a.doc_id = t.doc_id JOIN sizes b ON b.doc_id = t.doc_id + 1
LEFT JOIN shared s ON s.doc_id = t.doc_id
"""
)
def text_qgram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = B.text_pairs(spark, sf_dir)
    score = S.jaccard_qgrams(F.col("text_a"), F.col("text_b"))
    return pairs.select("doc_id", F.round(score, 6).alias("jaccard_qgm3"))


@registered(
    _text_bag(_WORDS)
    + """
SELECT doc_id, round(coalesce(sum(x * y) / nullif(sqrt(sum(x * x)) * sqrt(sum(y * y)), 0), 0), 6) AS cosine_tokens
FROM text_pairs LEFT JOIN bag USING (doc_id) GROUP BY doc_id
"""
)
def text_cosine_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = S.cosine_tokens(F.col("text_a"), F.col("text_b"))
    return B.text_pairs(spark, sf_dir).select("doc_id", F.round(score, 6).alias("cosine_tokens"))


@registered(
    _text_bag(_TERMS)
    + """,
weighted AS (
  SELECT doc_id, x, y, CASE WHEN x > 0 AND y > 0 THEN 1.0::DOUBLE ELSE ln(1.5::DOUBLE) + 1 END AS idf FROM bag)
SELECT doc_id,
       round(coalesce(sum(x * y) / nullif(sqrt(sum((x * idf) ** 2)) * sqrt(sum((y * idf) ** 2)), 0), 0), 6) AS cosine_tfidf
FROM text_pairs LEFT JOIN weighted USING (doc_id) GROUP BY doc_id
"""
)
def text_cosine_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = S.cosine_tfidf(F.col("text_a"), F.col("text_b"))
    return B.text_pairs(spark, sf_dir).select("doc_id", F.round(score, 6).alias("cosine_tfidf"))


@registered(
    _text_bag(_WORDS)
    + """,
lengths AS (SELECT doc_id, sum(x) AS la, sum(y) AS lb FROM bag GROUP BY doc_id),
scored AS (
  SELECT doc_id,
         sum(CASE WHEN x > 0 AND y > 0 THEN
           y * ln(1.4::DOUBLE) * x * 2.5 / (x + 1.5 * (0.25 + 0.75 * la / ((la + lb) / 5.0::DOUBLE)))
         + x * ln(1.4::DOUBLE) * y * 2.5 / (y + 1.5 * (0.25 + 0.75 * lb / ((la + lb) / 5.0::DOUBLE))) ELSE 0 END) / 2 AS sc
  FROM bag JOIN lengths USING (doc_id) GROUP BY doc_id)
SELECT doc_id, round(coalesce(CASE WHEN sc > 0 THEN sc / (sc + 1) END, 0), 4) AS bm25
FROM text_pairs LEFT JOIN scored USING (doc_id)
"""
)
def text_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = S.tool_bm25(F.col("text_a"), F.col("text_b"))
    return B.text_pairs(spark, sf_dir).select("doc_id", F.round(score, 4).alias("bm25"))


@registered(
    "SELECT doc_id, CAST(len(" + _WORDS.format(t="text") + ") AS INT) AS n_words, "
    "CAST(len(" + _TERMS.format(t="text") + ") AS INT) AS n_terms, "
    "CAST(greatest(length(text) - 2, 1) AS INT) AS n_qgrams FROM documents"
)
def text_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return B.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.size(X.words(text)).alias("n_words"),
        F.size(X.terms(text)).alias("n_terms"),
        F.size(X.qgrams(text)).alias("n_qgrams"),
    )


def _name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = B.named_products(spark, sf_dir)
    return attach_products(B.successor_pairs(spark, sf_dir), names, names)


@registered(
    "WITH " + B.PAIRED_SQL + """
SELECT source_id, target_id,
       CAST(levenshtein(lower(source_name), lower(target_name)) AS DOUBLE) AS lev_dist,
       round(1 - levenshtein(lower(source_name), lower(target_name))
             / greatest(length(source_name), length(target_name)), 6) AS lev_sim,
       round(jaro_winkler_similarity(lower(source_name), lower(target_name)), 6) AS jaro_winkler
FROM paired
"""
)
def name_edit_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("source_name"), F.col("target_name")
    return _name_pairs(spark, sf_dir).select(
        "source_id",
        "target_id",
        S.lev_dist(a, b).alias("lev_dist"),
        F.round(S.lev_sim(a, b), 6).alias("lev_sim"),
        F.round(A.jaro_winkler(a, b), 6).alias("jaro_winkler"),
    )


@registered(
    "WITH " + B.PAIRED_SQL + """,
best AS (
  SELECT source_id, target_id, i, max(jaro_winkler_similarity(x, y)) AS jw
  FROM (SELECT source_id, target_id, i, lower(string_split(source_name, ' ')[i]) AS x,
               lower(unnest(string_split(target_name, ' '))) AS y
        FROM (SELECT *, unnest(range(1, len(string_split(source_name, ' ')) + 1)) AS i FROM paired))
  GROUP BY 1, 2, 3)
SELECT source_id, target_id, round(avg(jw), 6) AS monge_elkan FROM best GROUP BY 1, 2
"""
)
def name_monge_elkan(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = A.monge_elkan(F.col("source_name"), F.col("target_name"))
    return _name_pairs(spark, sf_dir).select(
        "source_id", "target_id", F.round(score, 6).alias("monge_elkan")
    )


# Dynamic programming row by row over name pairs, as a recursive query whose
# working set holds one row of every pair's matrix.
_DP_SQL = (
    "WITH RECURSIVE " + B.PAIRED_SQL + """,
chars AS (
  SELECT source_id, target_id, string_split(lower(source_name), '') AS a, string_split(lower(target_name), '') AS b FROM paired),
dp AS (
  SELECT source_id, target_id, a, b, 0 AS i,
         list_transform(range(0, len(b) + 1), lambda j: -j) AS nw,
         list_transform(range(0, len(b) + 1), lambda j: 0::BIGINT) AS sw, 0::BIGINT AS best
  FROM chars
  UNION ALL
  SELECT source_id, target_id, a, b, i + 1, nw_next, sw_next, greatest(best, list_max(sw_next))
  FROM (
    SELECT source_id, target_id, a, b, i, best,
      list_reduce(range(1, len(b) + 1), lambda acc, j: list_append(acc,
        greatest(nw[j] + CAST(b[j] = a[i + 1] AS BIGINT), nw[j + 1] - 1, acc[-1] - 1)), [-(i + 1)::BIGINT]) AS nw_next,
      list_reduce(range(1, len(b) + 1), lambda acc, j: list_append(acc,
        greatest(0, sw[j] + CAST(b[j] = a[i + 1] AS BIGINT), sw[j + 1] - 1, acc[-1] - 1)), [0::BIGINT]) AS sw_next
    FROM dp WHERE i < len(a)))
SELECT source_id, target_id, CAST(nw[-1] AS DOUBLE) AS needleman_wunsch, CAST(best AS DOUBLE) AS smith_waterman
FROM dp WHERE i = len(a)
"""
)


@registered(_DP_SQL)
def name_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("source_name"), F.col("target_name")
    return _name_pairs(spark, sf_dir).select(
        "source_id",
        "target_id",
        A.needleman_wunsch(a, b).alias("needleman_wunsch"),
        A.smith_waterman(a, b).alias("smith_waterman"),
    )


@registered()
def name_tool_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratcliff-Obershelp has no SQL form; rows only."""
    score = A.tool_edit_distance(F.col("source_name"), F.col("target_name"))
    return _name_pairs(spark, sf_dir).select(
        "source_id", "target_id", F.round(score, 6).alias("edit_distance")
    )


_PRICE_CTE = B.PAIRED_SQL + """,
priced AS (
  SELECT *, CASE WHEN source_price <> 'nan' THEN CAST(source_price AS DOUBLE) END AS x,
            CASE WHEN target_price <> 'nan' THEN CAST(target_price AS DOUBLE) END AS y FROM paired)
"""


@registered(
    "WITH " + _PRICE_CTE + """
SELECT source_id, target_id,
       CASE WHEN x = y THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS price_exact_match,
       round(CASE WHEN x IS NULL OR y IS NULL THEN 0.5::DOUBLE ELSE 1 - abs(x - y) / greatest(abs(x), abs(y)) END, 6) AS price_abs_norm,
       CAST(levenshtein(source_price, target_price) AS DOUBLE) AS price_lev_dist,
       round(1 - levenshtein(source_price, target_price) / greatest(length(source_price), length(target_price)), 6) AS price_lev_sim
FROM priced
"""
)
def price_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("source_price"), F.col("target_price")
    return _name_pairs(spark, sf_dir).select(
        "source_id",
        "target_id",
        S.price_exact_match(a, b).alias("price_exact_match"),
        F.round(S.abs_norm(a, b), 6).alias("price_abs_norm"),
        S.price_lev_dist(a, b).alias("price_lev_dist"),
        F.round(S.price_lev_sim(a, b), 6).alias("price_lev_sim"),
    )


@registered(
    "WITH " + _PRICE_CTE + """,
valued AS (SELECT *, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN least(x, y) / greatest(x, y) END AS r FROM priced)
SELECT source_id, target_id,
       CASE WHEN r IS NOT NULL THEN x END AS price_a, CASE WHEN r IS NOT NULL THEN y END AS price_b,
       round(r, 4) AS ratio, CASE WHEN r IS NOT NULL THEN round(abs(x - y), 2) END AS absolute_diff,
       r >= 0.8 AS similar, CASE WHEN r IS NULL THEN 'unparseable' END AS note
FROM valued
"""
)
def tool_compare_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = S.compare_prices(F.col("source_price"), F.col("target_price")).alias("c")
    return _name_pairs(spark, sf_dir).select("source_id", "target_id", compared).select(
        "source_id", "target_id", "c.*"
    )


@registered(
    """
SELECT a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
"""
)
def tool_embedding_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = B.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    following = vectors.select(
        (F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")
    )
    score = S.embedding_cosine(F.col("embedding"), F.col("other"))
    return vectors.join(following, "vec_id").select("vec_id", F.round(score, 6).alias("cosine"))


@registered(
    "WITH " + B.PRODUCTS_SQL
    + "SELECT id, CASE WHEN price = 'nan' THEN 'N/A' ELSE price END AS shown_price, "
    "CASE WHEN price = 'nan' THEN NULL ELSE CAST(price AS DOUBLE) END AS price_num FROM products"
)
def price_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.named_products(spark, sf_dir).select(
        "id",
        S.display_price(F.col("price")).alias("shown_price"),
        S.parse_price(F.col("price")).alias("price_num"),
    )


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    goods = B.products(spark, sf_dir)
    return pair_features(B.successor_pairs(spark, sf_dir), goods, goods)


_FEATURES_SQL = (
    _DP_SQL.replace("SELECT source_id, target_id, CAST(nw[-1]", "SELECTED", 1).split("SELECTED")[0].rstrip()
    + """,
aligned AS (
  SELECT source_id, target_id, CAST(nw[-1] AS DOUBLE) AS nw, CAST(best AS DOUBLE) AS sw FROM dp WHERE i = len(a)),
elkan AS (
  SELECT source_id, avg(jw) AS me FROM (
    SELECT source_id, i, max(jaro_winkler_similarity(x, y)) AS jw
    FROM (SELECT source_id, i, lower(string_split(source_name, ' ')[i]) AS x, lower(unnest(string_split(target_name, ' '))) AS y
          FROM (SELECT *, unnest(range(1, len(string_split(source_name, ' ')) + 1)) AS i FROM paired))
    GROUP BY 1, 2) GROUP BY 1),
"""
    + _bag("name_bag", "paired", "source_id", "source_name", "target_name", _WORDS)
    + ","
    + _bag("desc_bag", "paired", "source_id", "source_description", "target_description", _TERMS)
    + """,
name_scores AS (
  SELECT source_id, sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) AS cosine_tokens,
         sum(CAST(x > 0 AND y > 0 AS INT)) / count(*) AS jaccard FROM name_bag GROUP BY 1),
desc_weighted AS (
  SELECT source_id, x, y, CASE WHEN x > 0 AND y > 0 THEN 1.0::DOUBLE ELSE ln(1.5::DOUBLE) + 1 END AS idf FROM desc_bag),
desc_scores AS (
  SELECT source_id, coalesce(sum(x * y) / nullif(sqrt(sum((x * idf) ** 2)) * sqrt(sum((y * idf) ** 2)), 0), 0) AS cosine_tfidf
  FROM desc_weighted GROUP BY 1),
fields AS (
  SELECT CAST(id AS BIGINT) AS no, 'name' AS field, lower(name) AS v FROM products
  UNION ALL SELECT CAST(id AS BIGINT), 'description', lower(description) FROM products WHERE description <> ''),
letters AS (
  SELECT no, field, unnest(string_split(v, '')) AS c, unnest(range(1, length(v) + 1)) AS i, length(v) AS n FROM fields),
sliding AS (
  SELECT no, field, i, n, concat(c, lead(c) OVER w, lead(c, 2) OVER w) AS g
  FROM letters WINDOW w AS (PARTITION BY no, field ORDER BY i)),
grams AS MATERIALIZED (SELECT DISTINCT no, field, g FROM sliding WHERE i <= greatest(n - 2, 1)),
gram_sizes AS (SELECT CAST(no AS VARCHAR) AS id, field, count(*) AS n FROM grams GROUP BY 1, 2),
gram_shared AS (
  SELECT CAST(a.no AS VARCHAR) AS source_id, a.field, count(*) AS k
  FROM grams a JOIN grams b ON b.no = a.no + 1 AND b.field = a.field AND b.g = a.g GROUP BY 1, 2),
gram_scores AS (
  SELECT p.source_id, f.field,
         CASE WHEN a.n IS NULL AND b.n IS NULL THEN 1.0::DOUBLE WHEN a.n IS NULL OR b.n IS NULL THEN 0.0::DOUBLE
              ELSE coalesce(k, 0) / (a.n + b.n - coalesce(k, 0)) END AS j
  FROM paired p CROSS JOIN (VALUES ('name'), ('description')) f(field)
  LEFT JOIN gram_sizes a ON a.id = p.source_id AND a.field = f.field
  LEFT JOIN gram_sizes b ON b.id = p.target_id AND b.field = f.field
  LEFT JOIN gram_shared s ON s.source_id = p.source_id AND s.field = f.field),
priced AS (
  SELECT source_id, source_price AS sp, target_price AS tp, source_name AS sn, target_name AS tn,
         CASE WHEN source_price <> 'nan' THEN CAST(source_price AS DOUBLE) END AS x,
         CASE WHEN target_price <> 'nan' THEN CAST(target_price AS DOUBLE) END AS y FROM paired)
SELECT p.source_id, p.target_id,
       round(gn.j, 6) AS name_jaccard_qgm3, round(n.cosine_tokens, 6) AS name_cosine_tokens,
       round(n.jaccard, 6) AS name_jaccard_tokens, round(me, 6) AS name_monge_elkan,
       CAST(levenshtein(lower(sn), lower(tn)) AS DOUBLE) AS name_lev_dist,
       round(1 - levenshtein(lower(sn), lower(tn)) / greatest(length(sn), length(tn)), 6) AS name_lev_sim,
       round(nw, 6) AS name_needleman_wunsch, round(sw, 6) AS name_smith_waterman,
       round(gd.j, 6) AS desc_jaccard_qgm3, round(coalesce(d.cosine_tfidf, 0), 6) AS desc_cosine_tfidf,
       CASE WHEN x = y THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS price_exact_match,
       round(CASE WHEN x IS NULL OR y IS NULL THEN 0.5::DOUBLE ELSE 1 - abs(x - y) / greatest(abs(x), abs(y)) END, 6) AS price_abs_norm,
       CAST(levenshtein(sp, tp) AS DOUBLE) AS price_lev_dist,
       round(1 - levenshtein(sp, tp) / greatest(length(sp), length(tp)), 6) AS price_lev_sim
FROM paired p JOIN priced USING (source_id) JOIN aligned USING (source_id) JOIN elkan USING (source_id)
JOIN name_scores n USING (source_id) LEFT JOIN desc_scores d USING (source_id)
JOIN gram_scores gn ON gn.source_id = p.source_id AND gn.field = 'name'
JOIN gram_scores gd ON gd.source_id = p.source_id AND gd.field = 'description'
"""
)


@registered(_FEATURES_SQL)
def pair_feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = [F.round(F.col(n), 6).alias(n) for n in FEATURE_NAMES]
    return feature_rows(spark, sf_dir).select("source_id", "target_id", *rounded)


@registered(
    "WITH features AS (" + _FEATURES_SQL.replace("WITH RECURSIVE", "WITH RECURSIVE", 1) + """),
long AS (UNPIVOT (SELECT * EXCLUDE (source_id, target_id) FROM features) ON COLUMNS(*) INTO NAME feature VALUE v)
SELECT feature, round(min(v), 4) AS min_value, round(max(v), 4) AS max_value,
       round(avg(v), 4) AS mean_value, round(stddev_pop(v), 4) AS std_value
FROM long GROUP BY 1
"""
)
def feature_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = feature_summary(pair_feature_matrix(spark, sf_dir))
    return stats.select(
        "feature",
        *[F.round(c, 4).alias(c) for c in ("min_value", "max_value", "mean_value", "std_value")],
    )
