"""Small document tables with copies, shared passages, nulls and clashing columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
CLASHING = ("_key1", "_key2", "_row", "_score", "kept", "n_lines", "band", "label", "score", "taken", "_spans", "words", "id", "key", "n")


def sentence(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """``(doc_id, text, lang, source)`` of about eighty documents."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghinorst") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    german = ["ü" + w for w in vocabulary[:200]]
    passage = sentence(rng, vocabulary, 70)
    out = []
    for i in range(60):
        words = german if i % 3 == 0 else vocabulary
        text = "\n".join(sentence(rng, words, rng.randint(1, 30)) for _ in range(rng.randint(1, 6)))
        if i % 7 == 0:
            text += "\nThe  Common line\t"
        if i % 5 == 0:
            text += "\n" + passage
        if i % 6 == 0:
            text += f"\n {i}-mail: Bob.{i % 12}@example.com 10.0.0.{i} 4111 1111 1111 1111 +49 (30) 1234567"
        out.append([i, text, "de" if i % 3 == 0 else "en", f"s{i % 4}"])
    for i in range(60, 80):  # copies and near copies
        words = out[(i * 7) % 12][1].split(" ")
        if i % 2 and len(words) > 4:
            words[rng.randrange(len(words))] = "changed"
        out.append([i, (" " if i % 2 else "  ").join(words), "en", None])
    out += [[80, None, None, None], [81, "", "en", "s1"], [82, " \n\t", None, "s9"], [83, "12 34 !", "en", "s1"], [84, "x", "en", "s1"]]
    out += [[None, "no id here", "en", "s2"], [85, "tie one two three four five", "en", "s3"], [85, "tie one two three four five", "en", "s3"]]
    out.append([86, sentence(rng, vocabulary, 30_000), "en", "s3"])
    return [tuple(r) for r in out]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, lang, s, len(t or "")) for i, t, lang, s in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with columns that bear the operators' own names."""
    from pyspark.sql import functions as F

    return docs.withColumns({name: F.lit("other") for name in CLASHING})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

