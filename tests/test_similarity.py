import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairwright.functions import alignment as A
from pairwright.functions import bags
from pairwright.functions import similarity as S
from pairwright.functions import text as X


@pytest.fixture(scope="module")
def score(spark):
    def run(function, a, b):
        row = spark.createDataFrame([(a, b)], "a string, b string")
        return row.select(function(F.col("a"), F.col("b")).alias("v")).first()["v"]

    return run


@pytest.mark.parametrize(
    "function, a, b, expected",
    [
        (S.jaccard_tokens, "", "", 1.0),
        (S.jaccard_tokens, "a", "", 0.0),
        (S.jaccard_tokens, "Hello world", "hello  EARTH", 1 / 3),
        (S.tool_jaccard, "", "", 0.0),
        (S.tool_jaccard, "hello world", "hello world", 1.0),
        (S.jaccard_qgrams, "abcd", "abce", 1 / 3),
        (S.jaccard_qgrams, "", "", 1.0),
        (S.jaccard_qgrams, "ab", "AB", 1.0),
        (S.jaccard_qgrams, "a😀bc", "a😀bd", 1 / 3),
        (S.cosine_tokens, "a a b", "a b b", 4 / 5),
        (S.cosine_tokens, "", "a", 0.0),
        (S.cosine_tfidf, "", "dvd player", 0.0),
        (S.cosine_tfidf, "dvd player", "dvd player", 1.0),
        (S.cosine_tfidf, "x y", "x z", 0.0),
        (S.lev_dist, "Kitten", "sitting", 3.0),
        (S.lev_sim, "", "", 1.0),
        (S.lev_sim, "abc", "abd", 2 / 3),
        (S.price_exact_match, "$1,299.00", "1299", 1.0),
        (S.price_exact_match, "nan", "nan", 0.0),
        (S.abs_norm, "50", "100", 0.5),
        (S.abs_norm, "N/A", "100", 0.5),
        (S.abs_norm, "0", "0", 1.0),
        (S.price_lev_dist, "nan", "nan", 0.0),
        (S.price_lev_sim, "nan", "nan", 1.0),
        (S.tool_bm25, "", "hello", 0.0),
        (S.tool_bm25, "   ", "hello", 0.0),
        (S.tool_bm25, "apple iphone", "samsung galaxy", 0.0),
        (A.needleman_wunsch, "abc", "abc", 3.0),
        (A.needleman_wunsch, "abc", "xyz", 0.0),
        (A.needleman_wunsch, "", "abc", -3.0),
        (A.needleman_wunsch, "abcd", "", -4.0),
        (A.needleman_wunsch, "", "", 0.0),
        (A.smith_waterman, "xabcy", "abc", 3.0),
        (A.smith_waterman, "", "abc", 0.0),
        (A.jaro_winkler, "MARTHA", "marhta", 0.9611111111),
        (A.jaro_winkler, "dwayne", "duane", 0.84),
        (A.monge_elkan, "", "", 1.0),
        (A.monge_elkan, "a", "", 0.0),
        (A.tool_edit_distance, "apple", "apple", 0.0),
        (A.tool_edit_distance, "", "", 0.0),
        (A.tool_edit_distance, "Apple", "apple", 0.2),
    ],
)
def test_hand_values(score, function, a, b, expected):
    assert score(function, a, b) == pytest.approx(expected)


def test_tfidf_weights_unshared_terms_more(score):
    w = math.log(1.5) + 1
    assert score(S.cosine_tfidf, "dvd player", "dvd disc") == pytest.approx(1 / (1 + w * w))


def test_monge_elkan_is_asymmetric(score):
    assert score(A.monge_elkan, "sony", "sony dvd player") == pytest.approx(1.0)
    assert score(A.monge_elkan, "sony dvd player", "sony") < 1.0


def test_bm25_closed_form(score):
    k, avg = 1.5, 7 / 5
    idf = math.log(1.4)
    one = 3 * idf * 2.5 / (1 + k * (0.25 + 0.75 * 3 / avg))
    two = 3 * idf * 2.5 / (1 + k * (0.25 + 0.75 * 4 / avg))
    mean = (one + two) / 2
    assert score(S.tool_bm25, "apple iphone 12", "apple iphone 12 pro") == round(mean / (mean + 1), 4)


def test_compare_prices(score):
    close = score(S.compare_prices, "$99.99", "$89.99")
    assert (close["price_a"], close["price_b"], close["absolute_diff"], close["similar"]) == (99.99, 89.99, 10.0, True)
    assert score(S.compare_prices, "$10.00", "$100.00")["similar"] is False
    assert score(S.compare_prices, "N/A", "$50.00")["note"] == "unparseable"
    assert score(S.compare_prices, "1,299.99", "1")["price_a"] == 1.0


def test_unicode_whitespace_and_terms(spark):
    row = spark.createDataFrame([(" Élan vital x\t",)], "t string").select(
        X.words(F.col("t")).alias("w"), X.terms(F.col("t")).alias("t")
    ).first()
    assert row["w"] == ["élan", "vital", "x"]
    assert row["t"] == ["élan", "vital"]


def _cells(a, b, local):
    row = [0 if local else -j for j in range(len(b) + 1)]
    best = 0
    for i, ca in enumerate(a, 1):
        new = [0 if local else -i]
        for j, cb in enumerate(b, 1):
            value = max(row[j - 1] + (ca == cb), row[j] - 1, new[j - 1] - 1)
            new.append(max(0, value) if local else value)
            best = max(best, new[-1])
        row = new
    return best if local else row[-1]


def test_alignment_equals_cellwise_dynamic_program(spark):
    import random

    rng = random.Random(5)
    texts = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(0, 24))) for _ in range(120)]
    pairs = [(a, b) for a, b in zip(texts, reversed(texts))]
    rows = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", A.needleman_wunsch("a", "b").alias("nw"), A.smith_waterman("a", "b").alias("sw")
    ).collect()
    for row in rows:
        assert row["nw"] == _cells(row["a"], row["b"], False)
        assert row["sw"] == _cells(row["a"], row["b"], True)


def test_word_pairs_in_slices_equal_one_by_one(monkeypatch):
    from pairwright.functions import alignment as A

    texts = ["", "martha dwayne", "marhta", "a  duane", "dixon dicksonx martha", "é", "xyz abc dwayne duane"]
    left, right = zip(*[(x.split(), y.split()) for x in texts for y in texts])
    whole = A._monge_elkan(list(left), list(right))
    monkeypatch.setattr(A, "_SLICE_CELLS", 8)
    assert list(A._monge_elkan(list(left), list(right))) == list(whole)
    alone = [A._monge_elkan([x], [y])[0] for x, y in zip(left, right)]
    assert alone == pytest.approx(list(whole))
    assert A._jaro_winkler(["martha", "", "dwayne"], ["marhta", "x", "duane"]) == pytest.approx([0.961111, 0, 0.84], abs=1e-6)


def test_bags_in_slices_equal_one_by_one(monkeypatch):
    import pandas as pd

    from pairwright.functions import bags as B

    texts = ["", " ", "a", "ab", "abc abc x", "b😀 c😀　x x", "éa éa bc\x1cde", "abcabcabc"]
    left, right = map(list, zip(*[(x, y) for x in texts for y in texts]))
    grams = [{s[i : i + 3] for i in range(max(len(s) - 2, min(len(s), 1)))} for s in left + right]
    expected = [len(a & b) / len(a | b) if a | b else 1.0 for a, b in zip(grams, grams[len(left) :])]
    assert list(B._qgram_jaccard(left, right, 3)) == pytest.approx(expected)
    # Grams of any length stay exact: they are numbered anew where 63 bits would not hold them.
    same = [float(x == y) for x, y in zip(left, right)]
    assert list(B._qgram_jaccard(left, right, 30)) == same
    for score in (B._cosine_tokens, B._cosine_tfidf, B._bm25):
        whole = list(score(left, right))
        monkeypatch.setattr(B, "_SLICE_CHARS", 9)
        assert list(B._in_slices(pd.Series(left), pd.Series(right), score)) == pytest.approx(whole)
        assert [score([x], [y])[0] for x, y in zip(left, right)] == pytest.approx(whole)
    assert len(B._in_slices(pd.Series([], dtype=object), pd.Series([], dtype=object), B._bm25)) == 0


@pytest.mark.parametrize("function", [S.cosine_tokens, S.cosine_tfidf, S.tool_bm25, S.jaccard_qgrams])
def test_no_lambda_walks_the_tokens_of_a_text(spark, function):
    rows = spark.createDataFrame([("a", "b"), (None, "b")], "a string, b string")
    scored = rows.select(function(F.col("a"), F.col("b")).alias("v"))
    assert "lambda" not in scored._jdf.queryExecution().optimizedPlan().toString()
    assert [r["v"] for r in scored.collect()] == [0.0, 0.0]


def test_qgrams_are_the_same_by_table_and_by_sorting(monkeypatch):
    rng = random.Random(3)

    def text(letters: str) -> str:
        return "".join(rng.choice(letters) for _ in range(rng.choice((0, 1, 2, 3, 40))))

    def grams(value: str, q: int) -> set[str]:
        return {value[i : i + q] for i in range(len(value) - q + 1)} or ({value} if value else set())

    for letters in ("ab", "abcdefgh 1,", "é漢𝒳a_ ."):
        left, right = [text(letters) for _ in range(60)], [text(letters) for _ in range(60)]
        for q in (1, 2, 3, 5):
            sets = [(grams(a, q), grams(b, q)) for a, b in zip(left, right)]
            wanted = [len(a & b) / len(a | b) if a | b else 1.0 for a, b in sets]
            for share, cells in ((16, 1 << 22), (0, 0), (0, 1 << 22)):
                monkeypatch.setattr(bags, "_TABLE_SHARE", share)
                monkeypatch.setattr(bags, "_TABLE_CELLS", cells)
                assert list(bags._qgram_jaccard(left, right, q)) == wanted


def test_terms_are_parted_without_a_regular_expression_of_the_engine(spark):
    left, right = "Ab-c 12.5—été…ÉTÉ_x 　漢字 ²", "ab été_x 12 漢字… c²"
    frame = spark.createDataFrame([(left, right)], "a string, b string").select(S.cosine_tfidf(F.col("a"), F.col("b")).alias("s"))
    a, b = (Counter(re.findall(r"\w{2,}", text.lower())) for text in (left, right))

    def norm(bag, other):
        return math.sqrt(sum((n if w in other else n * bags.TFIDF_UNSHARED_IDF) ** 2 for w, n in bag.items()))

    assert math.isclose(frame.first()["s"], sum(a[w] * b[w] for w in a) / (norm(a, b) * norm(b, a)))
    assert "regexp_replace" not in frame._jdf.queryExecution().executedPlan().toString()


def test_matching_blocks_are_those_of_difflib(monkeypatch):
    rng = random.Random(5)
    asked = []
    plain = A.difflib.SequenceMatcher

    def counted(*args):
        asked.append(args)
        return plain(*args)

    for letters, longest in (("ab", 30), ("abc d", 60), ("é漢😀xyz", 40), ("abcdefghijk", 240)):
        sides = [["".join(rng.choice(letters) for _ in range(rng.choice((0, 1, 2, rng.randint(0, longest))))) for _ in range(200)] for _ in "ab"]
        wanted = [plain(None, a, b).ratio() for a, b in zip(*sides)]
        monkeypatch.setattr(A.difflib, "SequenceMatcher", counted)
        assert list(A._ratcliff_obershelp(*sides)) == wanted
        monkeypatch.setattr(A.difflib, "SequenceMatcher", plain)
    # Only long texts are left to the step that goes letter by letter.
    assert all(max(len(a), len(b)) >= 200 for _, a, b in asked)
