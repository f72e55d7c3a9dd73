"""Language identification in two steps: the family, then the languages within it.

Linear support vector machines on hashed byte n-grams: one against the rest for each family, one against
one for the languages of a family. All are trained on a bounded sample; the weights, a fixed number of
coordinates for each machine, are broadcast and every document is read once.
"""

from __future__ import annotations

import math
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitwright.llm.text import arrow_map, documents, remainder, texts_of

DIMENSIONS = 1 << 12
GRAMS = (1, 2, 3)
#: The sample: so many documents for each language in expectation, fewer when there are many languages.
PER_LANGUAGE = 800
SAMPLE_ROWS = 8_000
HELD_OUT = (4, 2)
EPOCHS = 15
COST = 4.0
# Families by ISO 639-1 code; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "indo-aryan": ("hi", "ur", "bn", "mr", "gu", "pa", "ne"),
    "turkic": ("tr", "az", "kk", "uz", "tk"),
    "uralic": ("fi", "et", "hu"),
    "semitic": ("ar", "he", "am", "mt"),
}
_FAMILY = {language: family for family, languages in FAMILIES.items() for language in languages}
_LETTER = re.compile(r"[^\W\d_]")
_FACTORS = [np.uint32(c) for c in (2654435761, 2246822519, 3266489917)]


def family_of(language: str) -> str:
    return _FAMILY.get(language.lower().split("-")[0].split("_")[0], language)


def counts(text: bytes) -> np.ndarray:
    """Unit vector of the hashed byte n-grams; runs of white space count as one space."""
    codes = np.frombuffer(b" ".join([b"", *text.lower().split(), b""]), np.uint8).astype(np.uint32)
    total = np.zeros(DIMENSIONS)
    shift = np.uint32(32 - int(math.log2(DIMENSIONS)))
    with np.errstate(over="ignore"):
        gram = np.zeros(len(codes), np.uint32)
        for n in GRAMS:
            gram = (gram[: len(codes) - n + 1] * np.uint32(257)) + codes[n - 1 :]
            if len(gram) == 0:
                break
            total += np.bincount((gram * _FACTORS[n - 1]) >> shift, minlength=DIMENSIONS)
    norm = math.sqrt(float((total * total).sum()))
    return (total / norm if norm else total).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a linear machine with hinge loss, by dual coordinate descent; classes weigh alike."""
    positive = max(1, int((y > 0).sum()))
    cost = np.where(y > 0, COST * len(y) / (2.0 * positive), COST * len(y) / (2.0 * max(1, len(y) - positive)))
    alpha, w = np.zeros(len(y)), np.zeros(x.shape[1], np.float64)
    size = (x * x).sum(axis=1).astype(np.float64)
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(y)):
            if size[i]:
                after = min(max(alpha[i] - (y[i] * float(x[i] @ w) - 1.0) / size[i], 0.0), cost[i])
                if after != alpha[i]:
                    w += (after - alpha[i]) * y[i] * x[i]
                    alpha[i] = after
    return w.astype(np.float32)


def fit(languages: list[str], x: np.ndarray) -> tuple[list[tuple[str, str]], np.ndarray]:
    """Machines and their weights; a machine is ``(family, "")`` or ``(language, other language)``."""
    names = np.array(languages)
    groups = np.array([family_of(n) for n in languages])
    machines: list[tuple[str, str]] = []
    weights = []
    families = sorted(set(groups))
    for family in families:
        machines.append((family, ""))
        weights.append(svm(x, np.where(groups == family, 1.0, -1.0)) if len(families) > 1 else np.zeros(x.shape[1], np.float32))
        for one, other in combinations(sorted(set(names[groups == family])), 2):
            rows = (names == one) | (names == other)
            machines.append((one, other))
            weights.append(svm(x[rows], np.where(names[rows] == one, 1.0, -1.0)))
    return machines, np.stack(weights, axis=1)


def train(docs: DataFrame) -> dict:
    """Families, their languages, and the machines' weights; empty without labelled text."""
    modulus, out = HELD_OUT
    rows = documents(docs, "lang").withColumn("lang", F.col("lang").cast("string"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.coalesce(remainder(F.col("doc_id"), modulus), F.lit(0)) != out))
    per_language = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not per_language:
        return {}
    want = min(PER_LANGUAGE, max(2, SAMPLE_ROWS // len(per_language)))
    share = F.create_map(*[c for k, n in sorted(per_language.items()) for c in (F.lit(k), F.lit(int(min(1.0, want / n) * 1_000_000)))])
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.element_at(share, F.col("lang")))

    def vectors():
        def step(batch: pa.RecordBatch):
            v = [counts(t).astype(np.float16).tobytes() for t in texts_of(batch["text"])]
            yield pa.record_batch([batch["doc_id"], batch["lang"], pa.array(v, pa.binary())], ["doc_id", "lang", "v"])

        return step

    def learn(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("v", "ascending")])
        x = np.stack([np.frombuffer(v, np.float16) for v in group["v"].to_pylist()]).astype(np.float32)
        machines, weights = fit(group["lang"].to_pylist(), x)
        return pa.table({"one": [m[0] for m in machines], "other": [m[1] for m in machines], "w": [weights[:, i].tobytes() for i in range(len(machines))]})

    # the sample is bounded, so one task may hold it
    sample = arrow_map(sample, vectors, "doc_id long, lang string, v binary").withColumn("_all", F.lit(0))
    found = sample.groupBy("_all").applyInArrow(learn, "one string, other string, w binary").collect()
    model = {"families": {}, "pairs": {}, "weights": np.stack([np.frombuffer(r["w"], np.float32) for r in found], axis=1)}
    for language in sorted(per_language):
        model["families"].setdefault(family_of(language), []).append(language)
    for i, r in enumerate(found):
        model["pairs"][r["one"], r["other"]] = i
    return model


def predict(model: dict, margins: np.ndarray) -> tuple[str, float]:
    """Best family by its machine, then votes of the machines within; ties go to the larger margin sum."""
    pairs = model["pairs"]
    known = {f: margins[pairs[f, ""]] for f in model["families"] if (f, "") in pairs}
    family = max(sorted(known), key=known.get)
    rest = [m for f, m in known.items() if f != family]
    score = _sure((known[family] - max(rest)) / 2) if rest else 1.0
    votes = {language: [0, 0.0] for language in model["families"][family]}
    for one, other in combinations(sorted(votes), 2):
        if (one, other) in pairs:
            margin = float(margins[pairs[one, other]])
            votes[one if margin >= 0 else other][0] += 1
            votes[one][1] += margin
            votes[other][1] -= margin
    best = max(sorted(votes), key=lambda n: tuple(votes[n]))
    for other in votes:
        if other != best and tuple(sorted((best, other))) in pairs:
            margin = float(margins[pairs[tuple(sorted((best, other)))]])
            score = min(score, _sure(margin if best < other else -margin))
    return best, score


def _sure(margin: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, 2.0 * margin))))


def languages(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document.

    A null text, or one without a letter, is ``und`` with score 0, and so is every text if no row has a
    language. Null ids are not held out and may be learned from; repeated rows count each. The number of
    languages is taken to be small. Other columns are not read.
    """
    modulus, out = HELD_OUT
    held = docs.sparkSession.sparkContext.broadcast(train(docs))

    def work():
        model = held.value

        def step(batch: pa.RecordBatch):
            found = []
            for text in batch["text"].to_pylist():
                if not model or not text or not _LETTER.search(text):
                    found.append(("und", 0.0))
                else:
                    found.append(predict(model, counts(text.encode()) @ model["weights"]))
            yield pa.record_batch(
                [batch["doc_id"], pa.array([f[0] for f in found], pa.string()), pa.array([float(f[1]) for f in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

        return step

    found = arrow_map(documents(docs), work, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id"), modulus) == out, F.lit(False)).alias("held_out"), "lang_pred", "score")
