"""The registered queries and the pipeline's stages on a small corpus, against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from pairwright.llm import ann, bpe, near_dedup, packing, pii, queries
from test_operators import _BASE, TEXTS, base_spans, quality_by_hand, sets_of

_RNG = random.Random(8)
_WORDS = "the and of river stone cloud green window paper music garden is to a in that quiet morning light".split()
CLASH = "doc_id long, text string, lang string, source string, n_chars long, node long, key string, spans string, _text string, bin int, size long, kept boolean"


def prose(n):
    return " ".join(_RNG.choice(_WORDS) + _RNG.choice(["", "", "s", "ly", "."]) for _ in range(n))


def corpus():
    texts = [*TEXTS, *[prose(_RNG.randrange(30, 300)) for _ in range(60)]]
    texts += [t.replace("river", "brook", 1) for t in texts[20:30]] + texts[30:35]
    texts += [t.replace("garden", "vilegrub").replace("music", "muckbrain") for t in texts[40:60]]
    texts.append("10.0.0.1 jo@b.example.org " * 3000)
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate(texts)]
    # ids with two texts, each with a near copy, and repeated rows
    rows += [(500, _BASE.replace("word1", "x", 1), "en", "s", 1), (500, max(texts[20:70], key=len).replace("quiet", "loud", 1), "en", "s", 1),
             rows[26], rows[26], (None, "no id", None, None, None), (None, None, None, None, None)]
    return [(*r, 1, "k", "s", "t", 2, 3, True) for r in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, CLASH).repartition(3).write.parquet(str(path / "documents.parquet"))
    labels = [(i, 1, int("vilegrub" in (t or ""))) for i, t, *_ in rows if i is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    rng = np.random.default_rng(4)
    vectors = [(i, rng.standard_normal(12).tolist()) for i in range(300)]
    vectors += [(300, None), (301, [0.0] * 12), (302, [float("nan")] * 12), (303, [None] * 12), (320, vectors[7][1]), (340, [1.0, 2.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").write.parquet(str(path / "embeddings.parquet"))
    return str(path)


def held(spark, sf_dir, name):
    found = defaultdict(list)
    frame = queries.QUERIES[name](spark, sf_dir)
    for r in frame.collect():
        found[r["doc_id"]].append(r)
    return found


def by_id(rows):
    found = defaultdict(list)
    for i, t, *_ in rows:
        found[i].append(t or "")
    return found


def same(found, wanted, columns):
    """Rows of each id, in any order, with these columns."""
    assert set(found) == set(wanted)
    for i, mine in wanted.items():
        assert sorted(tuple(r[c] for c in columns) for r in found[i]) == sorted(mine), i


def test_op2(spark, sf_dir, rows):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = held(spark, sf_dir, "op2_best_fit_packing")
    sequences = defaultdict(list)
    for mine in found.values():
        for r in mine:
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    for i, texts in by_id(rows).items():
        every = [[*library.encode(t, add_special_tokens=False).ids, 0] for t in texts]
        whole = sorted(zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
                       for r in found[i] for ids in every[:1]) if len(every) == 1 else None
        if whole is not None:
            assert sorted(r["ids_crc32"] for r in found[i]) == whole
            assert sum(r["length"] for r in found[i]) == len(every[0])
    assert {i: sum(r["length"] for r in m) for i, m in found.items()} == {
        i: sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for t in ts) for i, ts in by_id(rows).items()
    }


def test_op3(spark, sf_dir, rows):
    kinds = ("email", "ip", "card", "phone")

    def want(text):
        spans = base_spans(text)
        count = Counter(k for k, _, _ in spans)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        return (*[count[k] for k in kinds], hashlib.sha256(joined.encode()).hexdigest())

    found = held(spark, sf_dir, "op3_personal_data")
    same(found, {i: [want(t) for t in ts] for i, ts in by_id(rows).items()}, [*[f"n_{k}" for k in kinds], "base_sha256"])
    for mine in found.values():
        for r in mine:
            assert sum(r[f"n_{k}"] for k in kinds) <= len([s for s in r["spans"].split(",") if s])


def test_many_matches_in_one_text(spark):
    text = "from 10.0.0.1 to 300.1.1.1 or 0049 30 1234-5678, a@b.co " * 10_000
    docs = spark.createDataFrame([(1, text), (2, "x"), (3, None)], "doc_id long, text string")
    model = pii.fit_spans(docs)
    assert set(model.weights) == set(pii.KINDS)
    found = {r["doc_id"]: r for r in pii.personal_spans(docs, model).collect()}
    assert [tuple(s) for s in found[1]["base_spans"]] == base_spans(text)
    assert found[1]["text"] == text and not found[2]["spans"] and not found[3]["spans"]
    hidden = {r["doc_id"]: r["text"] for r in pii.redacted(docs, model).collect()}
    assert hidden[1].count("[EMAIL]") == 10_000 and hidden[1].count("[IP]") >= 10_000 and hidden[3] is None


def test_op4(spark, sf_dir, rows):
    found = held(spark, sf_dir, "op4_toxicity")
    assert sum(map(len, found.values())) == len(rows)
    for i, mine in found.items():
        for r in mine:
            assert r["held_out"] == (zlib.crc32(str("" if i is None else i).encode()) % 4 == 2)
            assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_op5(spark, sf_dir, rows):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))

    def want(text):
        n = len(library.encode(text, add_special_tokens=False).ids)
        return len(text.encode()), n, n > 1024

    found = held(spark, sf_dir, "op5_token_counts")
    same(found, {i: [want(t) for t in ts] for i, ts in by_id(rows).items()}, ["n_bytes", "n_tokens", "over_limit"])


def classes_by_hand(rows):
    """component of every id: rows of one id, and similar texts, hang together."""
    known = [(i, sets_of(t)) for i, t, *_ in rows if i is not None]
    label = {i: i for i, _ in known}

    def join(a, b):
        low, high = sorted((label[a], label[b]))
        for x in [x for x in label if label[x] == high]:
            label[x] = low

    for k, (i, a) in enumerate(known):
        for j, b in known[:k]:
            both = len(a & b)
            if both and 100 * both >= 75 * (len(a) + len(b) - both):
                join(i, j)
    return label


def test_op6(spark, sf_dir, rows):
    label = classes_by_hand(rows)
    other = max(range(20, 70), key=lambda i: len(rows[i][1]))
    assert label[500] == label[other] == label[6]  # both texts of one id count
    found = held(spark, sf_dir, "op6_minhash_dedup")
    want = {
        i: [(len(sets_of(t)), label.get(i), i is None or label[i] == i) for t in ts] for i, ts in by_id(rows).items()
    }
    same({k: v for k, v in found.items() if k is not None}, {k: v for k, v in want.items() if k is not None},
         ["n_shingles", "component_id", "kept"])
    assert [(r["component_id"], r["kept"]) for r in found[None]] == [(None, True)] * 2


def test_one_row_of_each_group(spark, sf_dir, rows):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = near_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    label = classes_by_hand(rows)
    ids = [r["doc_id"] for r in kept.collect()]
    assert Counter(i for i in ids if i is not None) == Counter(set(label.values())) and ids.count(None) == 2


def test_op7(spark, sf_dir, rows):
    found = held(spark, sf_dir, "op7_sharding")
    want = {i: [(len(t.encode()) + 8, zlib.crc32(t.encode()), "rows", None) for t in ts] for i, ts in by_id(rows).items()}
    assert set(found) == set(want)
    shards = defaultdict(list)
    for i, mine in found.items():
        got = Counter((r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in mine)
        assert got == Counter(want[i])
        for r in mine:
            shards[r["shard"]].append(r["slot"])
    sizes = [len(s) for s in shards.values()]
    assert set(shards) == set(range(24)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())


def test_op8(spark, sf_dir, rows):
    def want(text):
        n, *rest = quality_by_hand(text)
        return (n, *rest, n < 20 or 100 * rest[3] > 30 * n)

    found = held(spark, sf_dir, "op8_quality_rules")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    same(found, {i: [want(t) for t in ts] for i, ts in by_id(rows).items()}, names)


def test_op9(spark, sf_dir, rows):
    own = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(bpe.vocabulary_file()), special_tokens={}
    )

    def want(text):
        ids = own.encode_ordinary(text)
        joined = ",".join(map(str, ids)).encode()
        return len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    found = held(spark, sf_dir, "op9_byte_bpe")
    same(found, {i: [want(t) for t in ts] for i, ts in by_id(rows).items()}, ["n_tokens", "ids_sha256", "decoded_sha256"])


def test_op10(spark, sf_dir):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    known = {i: np.array(v) for i, v in vectors.items() if v and len(v) == 12 and None not in v and np.isfinite(v).all() and any(v)}
    found = defaultdict(list)
    for r in queries.QUERIES["op10_forest_neighbours"](spark, sf_dir).collect():
        found[r["query_id"]].append(r)
    assert set(found) == {i for i in known if i % 20 == 0}
    hit = 0
    for i, mine in found.items():
        mine.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, ann.NEIGHBOURS + 1))
        assert all(abs(r["score"] - known[i] @ known[r["vec_id"]]) < 1e-9 and r["vec_id"] != i for r in mine)
        best = sorted((-(known[i] @ v), k) for k, v in known.items() if k != i)[: ann.NEIGHBOURS]
        hit += len({k for _, k in best} & {r["vec_id"] for r in mine})
    assert hit >= 0.9 * ann.NEIGHBOURS * len(found)


def test_stages_one_by_one(spark, sf_dir, rows):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scores = held(spark, sf_dir, "op4_toxicity")
    kept = stages["toxicity"](spark, docs, sf_dir)
    assert kept.columns == docs.columns
    harmless = {i for i, m in scores.items() if not any(r["predicted"] for r in m)}
    assert {r["doc_id"] for r in kept.collect()} == harmless

    verdicts = held(spark, sf_dir, "op8_quality_rules")
    good = stages["quality"](spark, docs, sf_dir)
    assert good.columns == docs.columns
    assert Counter(r["doc_id"] for r in good.collect()) == Counter(i for i, m in verdicts.items() for r in m if r["kept"])

    single = stages["near_duplicates"](spark, docs, sf_dir)
    assert Counter(r["doc_id"] for r in single.where("doc_id IS NOT NULL").collect()) == Counter(set(classes_by_hand(rows).values()))

    hidden = stages["personal_data"](spark, docs, sf_dir)
    assert hidden.columns == docs.columns and hidden.count() == docs.count()
    for r in hidden.collect():
        assert not base_spans(r["text"]) and (r["text"] is None or len(r["text"]) == r["n_chars"] or r["n_chars"] in (1, None) or "[" not in r["text"])

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = stages["packing"](spark, docs, sf_dir).collect()
    assert sum(r["length"] for r in pieces) == sum(
        len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in rows
    )
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf_dir).count() == 0, name


def test_pipeline_runs_its_stages(spark, sf_dir, rows):
    found = corpus_pipeline.run(spark, sf_dir).collect()
    ids = {r["doc_id"] for r in found}
    assert ids and not any(re.search("vilegrub.*vilegrub", t or "") for i, t, *_ in rows if i in ids)
    assert len(ids - {None}) == len({classes_by_hand(rows)[i] for i in ids if i is not None})
