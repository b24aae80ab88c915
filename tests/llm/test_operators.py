"""The corpus operators on small tables: brute force, edge rows, empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from pairwright.llm import ann, bpe, gru, lm, near_dedup, packing, pii, quality, sharding, token_counts, toxicity
from pairwright.llm.tokenization import units

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, block string"
_RNG = random.Random(4)
_LONG = " ".join(_RNG.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(30_000))
_BASE = " ".join(f"word{_RNG.randrange(400)}" for _ in range(200))
TEXTS = [
    None, "", " \n\t ", "one", "The cat sat on the mat and it was fine.", _LONG, _BASE, _BASE,
    _BASE.replace("word7", "changed", 1), _BASE.upper(), "x" * 5000, "a\n a  b\n\n c <|endoftext|> d",
    "mail me at jo.doe@mail.example.com or +1 (282) 555-3362, host 10.0.0.1 and 999.1.1.1",
    "card 4111 1111 1111 1111 and 4111 1111 1111 1112", "jo [at] example [dot] com, phone: 282-555-3362",
    "1.2.3.45.6.7.8 a@b.c_d@e.f +12 ) 3 4.5.6.7",
    "naïve café ünï 日本語 'tis we're I'll " * 30, "line one here\nline one here\nother line\n" * 12,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", None, 1.0, "b") for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "no id at all here", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_units_join_to_the_text():
    for text in filter(None, TEXTS):
        first, *rest = units(text)
        assert first + "".join(f" {u}" for u in rest) == text


def test_token_counts(docs, none, library):
    found = token_counts.token_counts(docs)
    assert "text" not in found.columns and found.count() == docs.count()
    for i, text in enumerate(TEXTS):
        assert by_id(found)[i]["n_tokens"] == len(ids_of(library, text))
    assert token_counts.token_counts(none).count() == 0


def test_packing_round_trip(docs, none, library):
    pieces = packing.token_pieces(docs)
    packed = packing.assign_sequences(pieces, group_pieces=8).collect()
    held = {}
    for r in packed:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    for i, text in enumerate(TEXTS):
        mine = sorted((r["piece"], r["start"], bytes(r["ids"])) for r in packed if r["doc_id"] == i)
        copies = 2 if i == 4 else 1
        whole = b"".join(p[2] for p in mine[::copies])
        assert np.frombuffer(whole, "<u4").tolist() == [*ids_of(library, text), 0]
        assert all(len(p[2]) == 4 * packing.CAPACITY for p in mine[1:] if len(mine) > copies)
    whole = packing.sequences(packing.assign_sequences(pieces))
    assert {r["n_tokens"] * 4 for r in whole.collect()} == {len(r["ids"]) for r in whole.collect()}
    assert packing.packed_documents(none).count() == 0


def test_fullest_combination_is_the_best():
    rng = random.Random(3)
    for _ in range(60):
        room = rng.randrange(1, 60)
        items = [rng.randrange(1, 40) for _ in range(rng.randrange(0, 9))]
        held = np.bincount(items or [0], minlength=100)
        held[0] = 0
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums if s + x <= room}
        chosen = packing.fullest(room, held)
        assert sum(chosen) == max(sums) and not Counter(chosen) - Counter(items)


KIND = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in KIND.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_personal_data(spark, docs, none):
    model = pii.fit_spans(docs)
    found = by_id(pii.personal_spans(docs, model).select("doc_id", "base_spans", "spans"))
    for i, text in enumerate(TEXTS):
        assert [tuple(s) for s in found[i]["base_spans"]] == base_spans(text)
        assert set(found[i]["base_spans"]) <= set(found[i]["spans"])
    hidden = by_id(pii.redacted(docs, model))
    assert hidden[12]["text"].startswith("mail me at [EMAIL] or [PHONE], host [IP]")
    assert hidden[0]["text"] is None and hidden[5]["text"] == _LONG
    assert pii.fit_spans(none).weights and pii.personal_spans(none, model).count() == 0
    hard = spark.createDataFrame([(1, "1" * 100_000), (2, "a." * 50_000), (3, "@a" + ".a" * 50_000)], "doc_id long, text string")
    assert pii.personal_spans(hard, model).count() == 3


def test_em_finds_the_unreliable_labeler():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.5
    votes = np.stack([np.where(rng.random(4000) < p, truth, ~truth) for p in (0.95, 0.9, 0.85, 0.55)], 1).astype(int)
    posterior, rates = pii.reliabilities(votes, np.ones(4000))
    assert ((posterior > 0.5) == truth).mean() > 0.95
    right = (rates[0, :, 1] + rates[1, :, 2]) / 2
    assert right.argmin() == 3 and right[0] > 0.9
    assert pii.reliabilities(np.zeros((0, 4), int), np.zeros(0))[0].shape == (0,)


def test_toxicity(spark, docs, none):
    rng = random.Random(5)
    plain = [" ".join(rng.choice("river stone cloud green window paper music garden".split()) + rng.choice("aeiou") for _ in range(120)) for _ in range(240)]
    bad = [t if i % 2 else t.replace("river", "vilegrub").replace("stone", "muckbrain") for i, t in enumerate(plain)]
    held = spark.createDataFrame([(i, t) for i, t in enumerate(bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(160)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(held, labels)
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(held, model).collect()}
    assert np.mean([(scores[i] >= 0.5) == (i % 2 == 0) for i in range(160, 240)]) > 0.95
    edge = toxicity.toxicity_scores(docs, model).collect()
    assert len(edge) == docs.count() and all(0 <= r["score"] <= 1 for r in edge)
    assert toxicity.harmless_documents(none, model).count() == 0
    blank = toxicity.fit_toxicity(none, labels.where("false"))
    assert toxicity.toxicity_scores(docs, blank).count() == docs.count()
    assert b"".join(toxicity.windows(b"ab cd " * 300)) == b"ab cd " * 300


def sets_of(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def test_near_duplicates(spark, docs, none):
    rng = random.Random(8)
    made = list(TEXTS)
    for _ in range(150):  # more near copies than a sparse key may hold
        words = _BASE.split()
        for _ in range(rng.randrange(1, 12)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
        made.append(" ".join(words))
    frame = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    sets = [sets_of(t) for t in made]
    label = list(range(len(made)))
    for i in range(len(made)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    for dense in (near_dedup.DENSE, 10**6):
        found = by_id(near_dedup.near_duplicates(frame, dense=dense))
        assert [found[i]["component_id"] for i in range(len(made))] == label
        assert all(found[i]["n_shingles"] == len(s) for i, s in enumerate(sets))
    edge = near_dedup.near_duplicates(docs).collect()
    assert len(edge) == docs.count()
    assert [(r["component_id"], r["kept"]) for r in edge if r["doc_id"] is None] == [(None, True)]
    assert near_dedup.near_duplicates(none).count() == 0


def test_deduplicated_keeps_one_row(docs):
    kept = near_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert {7, 8, 9} & {r["doc_id"] for r in kept.collect()} == set()


def test_sharding(spark, docs, none):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 7}" if i % 2 or i > 60 else f"own{i}") for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, source string")
    found = sharding.interleaved_shards(frame, shards=24, bin_rows=100).toPandas()
    sizes = found.groupby("shard").size()
    assert len(sizes) == 24 and sizes.max() - sizes.min() <= 1
    for _, part in found.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    hot = found[found["source"] == "hot"].groupby("shard").size()
    assert hot.max() - hot.min() <= 4
    edge = sharding.interleaved_shards(docs, shards=4)
    assert edge.count() == docs.count() and set(docs.columns) < set(edge.columns)
    assert sharding.interleaved_shards(none).count() == 0


def quality_by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_quality(docs, none):
    found = by_id(quality.quality_verdicts(docs))
    for i, text in enumerate(TEXTS):
        r = found[i]
        mine = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert mine == quality_by_hand(text)
        assert r["base_failed"] == (mine[0] < 20 or 100 * mine[4] > 30 * mine[0])
        assert not (r["base_failed"] and r["kept"])
    assert quality.kept_documents(docs).columns == docs.columns
    assert quality.kept_documents(none).count() == 0


def test_byte_bpe(docs, none):
    path = bpe.vocabulary_file()
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(path), special_tokens={})
    found = by_id(bpe.decode(bpe.encode(docs)))
    for i, text in enumerate(TEXTS):
        assert found[i]["ids"] == own.encode_ordinary(text or "")
        assert bytes(found[i]["decoded"]) == (text or "").encode()
        assert found[i]["block"] == "b"
    assert bpe.encode(none).count() == 0


def test_language_model(spark, docs, none):
    from pyspark.sql import functions as F

    found = lm.scored(docs.drop("score", "block"), learn=F.col("doc_id") % 3 != 0).collect()
    learned = Counter()
    for i, text in [*enumerate(TEXTS), (4, TEXTS[4])]:
        if i % 3:
            learned.update(lm.words_and_end(text or ""))
    n, v = sum(learned.values()), len(learned)
    for r in found:
        text = TEXTS[r["doc_id"]] if r["doc_id"] is not None else "no id at all here"
        tokens = lm.words_and_end(text or "")
        want = sum(np.log10((learned[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        assert r["n_tokens"] == len(tokens) and r["train_tokens"] == n
        assert r["n_known"] == sum(learned[t] > 0 for t in tokens)
        assert r["base_score"] == pytest.approx(want) and r["score"] < 0
    assert lm.scored(none, learn=F.lit(True)).count() == 0


def test_network_gradients_and_carried_state():
    rng = np.random.default_rng(0)
    net = gru.Network(6, 2, 3, 4)
    for name in net.NAMES:
        setattr(net, name, (rng.standard_normal(getattr(net, name).shape) * 0.3).astype(np.float64))
    inputs, targets = rng.integers(0, 9, (4, 3)), rng.integers(0, 8, (4, 3))

    def loss():
        states, _ = net.run(inputs, np.zeros((3, 4)))
        return -net.score(states.reshape(-1, 4).astype(np.float64), targets.ravel())[0].sum()

    states, kept = net.run(inputs, np.zeros((3, 4)))
    grads = {n: np.zeros_like(getattr(net, n)) for n in net.NAMES if n != "table"}
    _, back = net.score(states.reshape(-1, 4).astype(np.float64), targets.ravel(), grads)
    net.backward(inputs, kept, back.reshape(4, 3, 4), grads)
    for name, at in (("recurrent", (1, 2)), ("out", (0, 1)), ("within", (4, 1)), ("out_bias", (2,))):
        held = getattr(net, name)
        old = held[at]
        held[at] = old + 1e-2
        up = loss()
        held[at] = old - 1e-2
        down = loss()
        held[at] = old
        assert grads[name][at] == pytest.approx((up - down) / 2e-2, rel=0.02, abs=2e-3)
    small = gru.Network(6, 2, 3, 4)
    codes, lengths = rng.integers(0, 8, 50), np.array([20, 1, 29])
    whole = gru.log_likelihoods(small, codes, lengths, window=50)
    assert np.allclose(whole, gru.log_likelihoods(small, codes, lengths, window=3), atol=1e-4)
    p = np.exp([gru.log_likelihoods(small, np.array([c]), np.array([1]))[0] for c in range(8)])
    assert p.sum() == pytest.approx(1, abs=1e-4)


def test_forest_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((900, 16))
    v[100:160] = v[100]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [None] * 16), (None, v[0].tolist()), rows[3]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = frame.where("vec_id % 20 = 0")
    found = ann.nearest(frame, asked, searched_share=float(ann.TREES)).toPandas()
    assert set(found["query_id"]) == set(range(0, 900, 20))
    for q, part in found.groupby("query_id"):
        near = v @ v[q]
        near[q] = -np.inf
        part = part.sort_values("rank")
        best = np.lexsort((np.arange(900), -np.round(near, 9)))[:20]
        assert list(part["rank"]) == list(range(1, 21))
        assert np.allclose(part["score"], near[best])
    some = ann.nearest(frame, asked).toPandas()
    merged = some.merge(found, on=["query_id", "vec_id"])
    assert len(merged) / len(found) > 0.9
    assert ann.nearest(frame.where("false"), asked).count() == 0


def _many_words(spark):
    """30,000 words, the first 2,500 twice."""
    words = [f"w{i * 7919:x}é" for i in range(30_000)]
    texts = [" ".join(words[i : i + 500]) for i in range(0, len(words), 500)] + [" ".join(words[:2500])]
    docs = spark.createDataFrame([(t, True) for t in texts], "text string, learn boolean")
    cut = lm.blocks(docs, lm.words_and_end, buckets=64, counted="learn")
    return words, lm.stored(cut, "test-words").where("bucket >= 0")


def test_lm_names_2048_words(spark):
    words, packs = _many_words(spark)
    heads = lm.vocabulary(packs).heads
    assert set(heads) == {b"", *sorted(w.encode() for w in words[:2500])[:2047]}


def test_lm_spelling_learns_from_all_words(spark):
    words, packs = _many_words(spark)
    known = lm.vocabulary(packs, tails=1)
    rare = [w.encode() for w in words if w.encode() not in known.heads]
    assert len(rare) == 30_000 - 2047
    model, end = known.spelling, lm._SYMBOLS
    cube = np.zeros((end + 1,) * 3)
    for word in rare:
        seen = [end, end, *model.symbol[list(word)], end]
        for triple in zip(seen, seen[1:], seen[2:]):
            cube[triple] += 1
    pairs = cube.sum(0)
    base = (pairs + 0.1) / (pairs + 0.1).sum(1, keepdims=True)
    pairs = (pairs + 5 * base) / (pairs + 5 * base).sum(1, keepdims=True)
    cube += 4 * pairs
    wanted = np.log10(cube / cube.sum(2, keepdims=True)).ravel()
    assert np.allclose(model.logs[:, 0], wanted, atol=1e-4)


@pytest.mark.parametrize("scale, close", [(1.0, True), (400.0, False)])
def test_network_takes_off_bounds_only_where_no_probability_vanishes(scale, close):
    net = gru.Network(6, 2, 3, 4)
    net.start_from(np.arange(1, 9, dtype=float))
    net.within *= scale * 10
    net.out *= scale * 10
    rng = np.random.default_rng(3)
    h, target = rng.uniform(-1, 1, (40, 4)).astype(np.float32), rng.integers(0, 8, 40)
    found = gru._bounds(net.within.reshape(2, 3, 4), net.within_bias.reshape(2, 3))[1]
    assert (found == close).all()

    def log_softmax(logit):
        top = logit.max()
        return logit - top - np.log(np.exp(logit - top).sum())

    wanted = []
    for state, code in zip(h.astype(float), target):
        of_class = log_softmax(state @ net.out + net.out_bias)
        if code >= 6:
            wanted.append(of_class[2 + code - 6])
        else:
            part = slice(code // 3 * 3, code // 3 * 3 + 3)
            wanted.append(of_class[code // 3] + log_softmax(net.within[part] @ state + net.within_bias[part])[code % 3])
    assert np.allclose(net.score(h, target)[0], wanted, rtol=1e-4, atol=1e-3)
