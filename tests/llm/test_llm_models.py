"""Toxicity, language and language-model scores."""

import collections
import math
import random
import time
import zlib

import numpy as np
import pytest
from splitwright.llm import language, lattice, toxicity
from splitwright.llm.text import WordHashes

WORDS = ["ba", "ro", "tin", "mel", "sol", "kar", "dun", "fes", "gil", "hop"]


def held(i, modulus, remainder):
    return i is not None and zlib.crc32(str(i).encode()) % modulus == remainder


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        words = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(rng.randint(3, 60))]
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["Vile,", "nasty", "GRIM"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(600, None), (601, ""), (None, "vile")]
    labels += [(700, 1), (3, None), (None, 1), (5, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_is_learned(labelled):
    docs, labels = labelled
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == 603
    for r in got:
        assert 0.0 <= r["score"] <= 1.0 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == held(r["doc_id"], 4, 2)
    judged = [r for r in got if r["held_out"] and r["doc_id"] < 600]
    right = [r["predicted"] == int(r["doc_id"] % 6 == 0) for r in judged]
    assert len(judged) > 100 and sum(right) / len(right) > 0.95
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[600]["score"] == by_id[601]["score"] and by_id[None]["predicted"] == 1
    assert sorted(map(tuple, toxicity.toxicity_scores(docs, labels).collect()), key=repr) == sorted(map(tuple, got), key=repr)


def test_toxicity_learns_from_coordinates(labelled):
    """The one task that learns gets coordinates, no texts."""
    docs, labels = labelled
    rows = toxicity.training_rows(docs, labels)
    assert rows.columns == ["_order", "toxic", "at"]
    got = sorted((r["toxic"], r["at"]) for r in rows.collect())
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    known = [(r["doc_id"], r["toxic"]) for r in labels.collect() if r["doc_id"] in texts and r["toxic"] in (0, 1) and not held(r["doc_id"], 4, 2)]
    assert got == sorted((y, toxicity.features((texts[i] or "").encode(), WordHashes()).tolist()) for i, y in known)


def test_labels_of_held_out_documents_teach_nothing(labelled):
    from pyspark.sql import functions as F

    docs, labels = labelled
    out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    turned = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first, second = (sorted(map(tuple, toxicity.toxicity_scores(docs, x).collect()), key=repr) for x in (labels, turned))
    assert first == second


def test_without_toxic(labelled, clashing, empty):
    docs, labels = labelled
    kept = {r["doc_id"] for r in toxicity.without_toxic(docs, labels).collect()}
    assert len(kept & set(range(0, 600, 6))) < 10 and len(kept & {i for i in range(600) if i % 6}) > 490
    assert toxicity.without_toxic(empty, labels).count() == 0
    same = toxicity.without_toxic(clashing, labels.limit(0))
    assert same.columns == clashing.columns and same.count() == clashing.count()


def test_features_are_words_pairs_and_skips():
    hashes = WordHashes()
    assert len(toxicity.features(b"One two, three", hashes)) == 3 + 2 + 1
    assert set(toxicity.features(b"one", hashes)) <= set(toxicity.features(b"ONE two", hashes))
    assert len(toxicity.features(b"", hashes)) == 0


def test_languages(spark):
    rng = random.Random(2)
    parts = {"en": ["the", "ing", "th", "wh", "and"], "de": ["sch", "ung", "ich", "keit", "ver"], "fr": ["eau", "oux", "que", "ent", "ais"], "es": ["ción", "ñas", "ar", "los", "ez"]}
    rows = []
    for i in range(400):
        name = list(parts)[i % 4]
        rows.append((i, " ".join(rng.choice(parts[name]) + rng.choice(parts[name]) for _ in range(rng.randint(2, 40))), name if i % 9 else None))
    rows += [(400, None, "en"), (401, "", "en"), (402, "12 +3 ...", "de"), (None, "schung", "de")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.languages(table).collect()}
    assert len(got) == 404
    assert all(r["held_out"] == held(i, 4, 2) and 0 <= r["score"] <= 1 for i, r in got.items())
    assert [got[i]["lang_pred"] for i in (400, 401, 402)] == ["und"] * 3 and got[None]["lang_pred"] == "de"
    right = [got[i]["lang_pred"] == list(parts)[i % 4] for i in range(400) if held(i, 4, 2)]
    assert sum(right) / len(right) > 0.97


def test_languages_without_any(docs, clashing, empty):
    from pyspark.sql import functions as F

    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.languages(none).collect()} == {"und"}
    assert language.languages(empty).count() == 0
    assert {r["lang_pred"] for r in language.languages(clashing).collect()} <= {"en", "de", "und"}


def test_families():
    assert language.family_of("en") == language.family_of("de-AT") == "germanic" and language.family_of("xx") == "xx"


def paths(word, pieces, start=0):
    if start == len(word):
        yield []
    for end in range(start + 1, len(word) + 1):
        if word[start:end] in pieces:
            for rest in paths(word, pieces, end):
                yield [word[start:end], *rest]


def test_lattice_sums_all_segmentations():
    rng = random.Random(4)
    pieces = sorted({bytes([b]) for b in b"abc\xff"} | {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 4))) for _ in range(20)} | {b"\xffab", b"\xffc"})
    log_p = np.log(np.random.default_rng(1).dirichlet(np.ones(len(pieces))))
    value = dict(zip(pieces, log_p))
    words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 8))) for _ in range(60)]
    grid = lattice.Lattice(pieces, log_p)
    expected = collections.Counter()
    for word, score in zip(words, grid.scores(words)):
        all_paths = [(sum(value[p] for p in path), path) for path in paths(b"\xff" + word, value)]
        total = math.log(sum(math.exp(s) for s, _ in all_paths))
        assert abs(total - score) < 1e-9
        for s, path in all_paths:
            for p in path:
                expected[p] += 2 * math.exp(s - total)
    got = grid.expected(words, np.full(len(words), 2.0))
    assert np.allclose(got, [expected[p] for p in pieces])


def test_long_words_are_walked_in_linear_time(monkeypatch):
    rng = random.Random(5)
    pieces = sorted({bytes([b]) for b in range(256)} | {bytes(rng.choice(b"abcd") for _ in range(rng.randint(2, 12))) for _ in range(300)})
    log_p = np.log(np.random.default_rng(1).dirichlet(np.ones(len(pieces))))
    grid = lattice.Lattice(pieces, log_p)
    monkeypatch.setattr(lattice, "WINDOW", 37)
    words = [bytes(rng.choice(b"abcd") for _ in range(n)) for n in (0, 1, 36, 37, 400)]
    walked, uses = grid.scores(words), grid.expected(words, np.arange(1.0, 6.0))
    monkeypatch.setattr(lattice, "WALKED", 0)
    assert np.allclose(walked, grid.scores(words)) and np.allclose(uses, grid.expected(words, np.arange(1.0, 6.0)))
    monkeypatch.undo()
    begun = time.process_time()
    score = grid.scores([bytes(rng.choices(b"abcdefgh", k=1_000_000))])[0]
    assert math.isfinite(score) and score < -1e5 and time.process_time() - begun < 60


def test_words_of_similar_length_share_their_steps(monkeypatch):
    rng = random.Random(6)
    pieces = sorted({bytes([b]) for b in range(256)} | {bytes(rng.choice(b"abcd") for _ in range(rng.randint(2, 12))) for _ in range(300)})
    log_p = np.log(np.random.default_rng(1).dirichlet(np.ones(len(pieces))))
    grid = lattice.Lattice(pieces, log_p)
    words = [bytes(rng.choice(b"abcde") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    counts = np.arange(1.0, 501.0)
    # in plain numbers where a float holds them, in logs throughout, and place by place
    scores, uses = grid.scores(words), grid.expected(words, counts)
    assert 1 < grid.plain < 60
    grid.plain = 0
    assert np.allclose(scores, grid.scores(words)) and np.allclose(uses, grid.expected(words, counts))
    monkeypatch.setattr(lattice, "WALKED", len(words))
    assert np.allclose(scores, grid.scores(words)) and np.allclose(uses, grid.expected(words, counts))
    monkeypatch.undo()
    pieces = sorted({*pieces, *(bytes(rng.choices(b"efghijklmnop", k=25)) for _ in range(20_000))})
    grid = lattice.Lattice(pieces, np.full(len(pieces), -math.log(len(pieces))))
    words = [bytes(rng.choices(b"abcdefgh", k=5_000)) for _ in range(18)]
    begun = time.process_time()
    assert np.isfinite(grid.scores(words)).all() and grid.expected(words, np.ones(18)).sum() > 18
    # a substring that begins no piece is not looked at again, however long the longest piece is
    assert time.process_time() - begun < 3


def scores_brute(texts):
    token = [(i, (t or "").encode().lower().split()) for i, t, *_ in texts]
    count, n = collections.Counter(), 0
    for i, words in token:
        if not held(i, 10, 0):
            count.update([*words, None])
    n, v = sum(count.values()), len(count)
    base = lambda w: math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1)))
    return sorted(((i, held(i, 10, 0), len(w) + 1, sum(count[x] > 0 for x in [*w, None]), n, round(sum(map(base, [*w, None])), 6)) for i, w in token), key=repr)


@pytest.mark.skipif(not __import__("os").path.exists(lattice.PIECES), reason="no vocabulary file")
def test_language_scores(docs, clashing, empty, texts, monkeypatch):
    want = scores_brute(texts)
    for table in (docs, clashing.drop("lang")):
        got = lattice.language_scores(table).collect()
        rows = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got]
        assert sorted(rows, key=repr) == want
        assert all(r["score"] < 0 for r in got)
    assert lattice.language_scores(empty).count() == 0


def test_the_model_is_a_distribution():
    """Word probabilities of a closed vocabulary, with what the lattice leaves for all other words, sum to 1."""
    counts = np.array([[3, 0], [1, 2], [0, 1], [0, 0]])
    log_lattice = np.log([0.1, 0.2, 0.3, 0.4])
    model = lattice._Model(n=9, v=4, ends=2, n_words=7, v_words=3, languages=[(4, 2, 1), (3, 2, 1)])
    assert np.allclose(model.word_probabilities(counts, log_lattice).sum(axis=1), 1)
    total = 0.0
    for size in range(4):  # all texts of up to three words over the vocabulary, and the rest of the mass
        for code in range(4**size):
            tokens = np.array([(code // 4**k) % 4 for k in range(size)], np.int64)
            total += 10 ** lattice._log_probabilities(tokens, np.array([size]), model, model.word_probabilities(counts, log_lattice))[0]
    assert abs(total - (1 - (1 - model.end()) ** 4)) < 1e-9


@pytest.mark.skipif(not __import__("os").path.exists(lattice.PIECES), reason="no vocabulary file")
def test_a_long_unseen_word_has_a_finite_score(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(20)), "en" if i % 2 else "de") for i in range(40)]
    unseen = "".join(rng.choice("qxyz0123456789") for _ in range(10_000))
    tested = next(i for i in range(100, 200) if held(i, 10, 0))
    table = spark.createDataFrame([*rows, (tested, f"ba {unseen} ro {unseen}", "en")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in lattice.language_scores(table, rounds=1).collect()}
    assert got[tested]["held_out"] and got[tested]["n_known"] == 3
    assert all(math.isfinite(r["score"]) for r in got.values())
    # far below what a float holds, and the second use comes from the document's own words
    assert -100_000 < got[tested]["score"] < -5_000


@pytest.mark.skipif(not __import__("os").path.exists(lattice.PIECES), reason="no vocabulary file")
def test_pieces_are_fitted_in_three_rounds(spark):
    words = spark.createDataFrame([(bytearray(a.encode() + b.encode()),) for a in WORDS for b in WORDS], "word binary")
    pieces, weights = lattice.load_pieces()
    log_p, log_stop = lattice.fit_pieces(words, pieces, weights)
    want, want_stop = lattice.fit_pieces(words, pieces, weights, rounds=3)
    assert np.allclose(log_p, want) and abs(log_stop - want_stop) < 1e-9


def test_small_probabilities_stay_in_log_space():
    counts, log_lattice = np.array([[3, 0], [0, 0]]), np.array([-2.0, -5000.0])
    model = lattice._Model(n=5, v=2, ends=2, n_words=3, v_words=1, languages=[(3, 1, 1), (0, 0, 1)])
    log_p = model.word_log_probabilities(counts, log_lattice)
    share = math.log(lattice.DISCOUNT / 3)
    assert np.allclose(log_p[:, 1], [2 * share - 5000, share - 5000])
    p = model.word_probabilities(counts, log_lattice)
    got = lattice._log_probabilities(np.array([1, 0]), np.array([2]), model, p, log_p)[0]
    kept = math.log(1 - lattice.CACHE / (1 + lattice.CACHE_HALF))
    each = [math.log(0.5) + x[1] + kept + x[0] for x in log_p]
    want = np.logaddexp(*each) + 2 * math.log(1 - model.end()) + math.log(model.end())
    assert abs(got - want / math.log(10)) < 1e-9


def test_packed_tokens_come_back():
    tokens = np.array([0, 1, 70_000, 5, 1 << 30], np.int32)
    assert lattice.unpacked(lattice.packed(tokens)).tolist() == tokens.tolist()
    assert len(lattice.unpacked(lattice.packed(tokens[:0]))) == 0
