import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitwright.functions import sets
from splitwright.functions.ids import content_key, format_id, own_group_key, parse_id, parse_profile_id
from splitwright.functions.names import (
    ONE_TOKEN_SUFFIXES,
    REPEATED_SUFFIXES,
    TWO_TOKEN_SUFFIXES,
    name_key,
    strip_all_suffixes,
    strip_one_suffix,
    strip_two_suffixes,
)
from splitwright.functions.numbers import nearest_grid_value, to_number
from splitwright.functions.sets import folded_set, hashed_shingles, word_shingles
from splitwright.functions.vectors import softmax, top_positions


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_token_lists():
    assert (len(ONE_TOKEN_SUFFIXES), len(TWO_TOKEN_SUFFIXES), len(REPEATED_SUFFIXES)) == (47, 57, 58)
    assert len(set(REPEATED_SUFFIXES)) == 58


def test_name_key(spark):
    values = ["  Aspirin\t", " CAFFEINE\n", "", None, "a  B"]
    assert column(spark, values, name_key) == ["aspirin", "caffeine", "", None, "a  b"]


def test_one_suffix(spark):
    values = ["levocetirizine dihydrochloride", "sodium", "x sodium hydrate", "x  y sodium", "caffeine", "x estolate", None]
    want = ["levocetirizine", None, "x sodium", "x y", None, None, None]
    assert column(spark, values, strip_one_suffix) == want


def test_two_suffixes(spark):
    values = ["x sodium glycinate", "a b sodium hydrate sulfate", "sodium chloride", "x phosphate complex", "sodium complex",
              "x complex", "caffeine  plain", "x sodium complex hydrate"]
    want = ["x", "a b sodium", "sodium", "x", "sodium complex", "x complex", "caffeine  plain", "x sodium complex"]
    assert column(spark, values, strip_two_suffixes) == want


def test_all_suffixes(spark):
    values = ["X Sodium Glycinate", "Sodium Chloride", "X phosphate complex", "sodium", " A   B ", "", None]
    assert column(spark, values, strip_all_suffixes) == ["x", "sodium", "x", "sodium", "a b", "", None]


def test_numbers(spark):
    values = ["1", " 2.5 ", "1e3", "10d", "5f", "n/a", "", None, "-.5", "3."]
    assert column(spark, values, to_number) == [1.0, 2.5, 1000.0, None, None, None, None, None, -0.5, 3.0]


def test_grid(spark):
    assert column(spark, [0.1, 7.0, None], nearest_grid_value, "double") == [0.12, 10.0, None]
    assert column(spark, [2.0, 2.5], lambda c: nearest_grid_value(c, (3.0, 1.0)), "double") == [1.0, 3.0]


def test_ids(spark):
    assert column(spark, [7, 12345], lambda c: format_id(c, "IT"), "long") == ["IT_0007", "IT_12345"]
    assert column(spark, ["IT_0007", "IT_12345", None], lambda c: parse_id(c, "IT")) == [7, 12345, None]
    with pytest.raises(Exception, match="expected IT_NNNN"):
        column(spark, ["XX_0007"], lambda c: parse_id(c, "IT"))


def test_profile_id(spark):
    good, bad, none = column(spark, ["CPC020_HEPG2_6H:BRD-K01234567:3.33333", "CPC020_HEPG2:BRD", None], parse_profile_id)
    assert tuple(good) == ("CPC020", "HEPG2", 6, "BRD-K01234567", "3.33333", True)
    assert tuple(bad) == tuple(none) == (None,) * 5 + (False,)


def test_content_key(spark):
    df = spark.createDataFrame([("CCO", "MCF7", "10"), ("CCO", None, "10")], "a string, b string, c string")
    got = [r[0] for r in df.select(content_key(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [hashlib.sha256(b"CCO|MCF7|10").hexdigest()[:16], None]


def test_own_group_key(spark):
    df = spark.createDataFrame([(1, "k"), (2, ""), (3, None)], "id long, g string")
    got = [r[0] for r in df.select(own_group_key(F.col("g"), F.col("id"))).collect()]
    assert got == ["k", "_acyclic_2", "_acyclic_3"]


def test_shingles(spark):
    values = ["The cat  sat on the mat", "one two", "a b c a b c a b c", "   ", ""]
    got = column(spark, values, lambda c: word_shingles(c))
    assert got[0] == ["the cat sat", "cat sat on", "sat on the", "on the mat"]
    assert got[1] == ["one two"]
    assert sorted(got[2]) == ["a b c", "b c a", "c a b"]
    assert got[3] == [] and got[4] == []
    hashed = column(spark, values, hashed_shingles)
    assert [len(h) for h in hashed] == [4, 1, 3, 0, 0] and hashed[0] == sorted(hashed[0])
    folded = column(spark, values[:2], lambda c: folded_set(word_shingles(c), 16))
    assert all(0 <= b < 16 for f in folded for b in f)


@pytest.mark.parametrize("size", [20, 1_000_000])
def test_hashed_shingles_are_shared_as_shingles_are(spark, monkeypatch, size):
    """White space, other scripts, nulls and long words: the same rows share the same hashes, however tasks cut their batches."""
    monkeypatch.setattr(sets, "TEXT_BYTES", size)
    rng = random.Random(3)
    blanks = [" ", "\t", "\n", "\x0b", "\f", "\r", "  ", " \n", "\u00a0"]
    texts = ["", " ", None, "a", " a", "a ", "a b", "A  B", "\x1c x y z", "x" * 500, "x" * 499 + "y", "a\x00 a b", "a a a a", "\u03a3\u03b1\u03c2 \u03a3 a"]
    texts += ["".join(rng.choice(["a", "b", "C", "\u00e9", "\u6f22", "ab"]) + rng.choice(blanks) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    rows = df.select("i", word_shingles(F.col("t")).alias("w"), hashed_shingles(F.col("t")).alias("h")).collect()
    assert all(r["h"] == sorted(set(r["h"])) for r in rows)
    places = []
    for c in "wh":
        where = {}
        for r in sorted(rows):
            for x in set(r[c] or []):
                where.setdefault(x, []).append(r["i"])
        places.append(sorted(where.values()))
    assert places[0] == places[1]
    data, offsets = np.frombuffer("".join(t or "" for t in texts).encode(), np.uint8), np.cumsum([0] + [len((t or "").encode()) for t in texts])
    whole = sets._shingle_sets(data, offsets, 3)
    monkeypatch.setattr(sets, "WORD_BYTES", size // 2)
    assert all((x == y).all() for x, y in zip(whole, sets._shingle_sets(data, offsets, 3)))


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, -1.0],)], "v array<double>")
    weights, top = df.select(softmax(F.col("v")), top_positions(F.col("v"), 2)).first()
    assert abs(sum(weights) - 1) < 1e-12 and top == [1, 2]
