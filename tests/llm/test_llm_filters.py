"""Decontamination, mixing and personal data against brute force."""

import collections
import hashlib
import math
import random
import re

import pytest
from helpers_llm import rows_of
from splitwright.llm import decontaminate, disclosure, mixing
from splitwright.llm.text import alnum_words

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    return WORD.findall(raw)


def windows_of(items, size):
    out = collections.defaultdict(set)
    for item, text in items:
        w = words_of(text)
        n = min(size, len(w))
        for k in range(len(w) - n + 1) if n else ():
            out[tuple(w[k : k + n])].add(str(item))
    return out


def hits_brute(texts, items, size):
    windows = windows_of(items, size)
    lengths = {len(w) for w in windows}
    out = []
    for i, text, *_ in texts:
        w = words_of(text)
        hit, named = set(), set()
        for k in range(len(w)):
            for n in lengths:
                found = windows.get(tuple(w[k : k + n]))
                if found and k + n <= len(w):
                    hit |= set(range(k, k + n))
                    named |= found
        digest = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(named), digest, bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def items(texts):
    rng = random.Random(9)
    out = []
    for n in range(12):
        w = rng.choice([t for _, t, *_ in texts if t and len(t.split()) > 20]).split()
        at = rng.randrange(len(w) - 15)
        out.append((n, " ".join(w[at : at + rng.randint(3, 15)]).upper()))
    return [*out, (2, out[0][1]), (100, None), (101, " -- "), (102, "x"), (103, out[3][1] + " and more words")]


@pytest.fixture(scope="module")
def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_contamination(docs, clashing, empty, benchmark, texts, items):
    want = hits_brute(texts, items, 10)
    assert sum(r[5] for r in want) > 5
    for table, block in ((docs, 50_000), (clashing, 50_000), (docs, 20)):
        got = decontaminate.contamination(table, benchmark, block_words=block).drop("longest_hit")
        assert rows_of(got) == want
    assert decontaminate.contamination(empty, benchmark).count() == 0
    clean = decontaminate.contamination(docs, benchmark.limit(0)).collect()
    assert len(clean) == len(texts) and not any(r["contaminated"] for r in clean)


def test_random_automata():
    rng = random.Random(1)
    for _ in range(150):
        vocabulary = [b"a", b"b", b"c", b"d"][: rng.randint(1, 4)]
        make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
        items = [(str(i), make(rng.randint(1, 12))) for i in range(rng.randint(1, 5))]
        size = rng.randint(1, 6)
        words = make(rng.randint(0, 40)) + [b"z"] + make(5)
        spans, named = decontaminate.SuffixAutomaton(items, size).hits(words)
        text = b" ".join(words).decode()
        want = hits_brute([(0, text)], [(i, b" ".join(w).decode()) for i, w in items], size)[0]
        covered = {k for s, e in spans for k in range(s, e)}
        assert (len(covered), len(named)) == (want[2], want[3])
        assert spans == decontaminate.merged(spans)


def test_cut_passages(spark, benchmark, clashing):
    w = [f"word{i}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(w[10:25]))], "item_id long, text string")
    rows = [(1, "Start, " + " ".join(w) + " end.", 9), (2, " ".join(w[10:22]), 9), (3, "clean  text\n", 9), (4, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r for r in decontaminate.decontaminated(table, bench).collect()}
    text = "Start, " + " ".join(w[:10]) + "  " + " ".join(w[25:]) + " end."
    assert sorted(got) == [1, 3, 4] and got[1]["text"] == text and got[1]["n_chars"] == len(text)
    assert tuple(got[3]) == rows[2] and tuple(got[4]) == rows[3]
    kept = decontaminate.decontaminated(clashing, benchmark)
    assert kept.columns == clashing.columns
    assert not any(r["contaminated"] for r in decontaminate.contamination(decontaminate.decontaminated(table, bench), bench).collect())


def level_targets(sizes):
    """Repeat the resharing until no target is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        rest = total - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2 * sizes[s] for s in over}


def test_mix(docs, clashing, empty, texts):
    sizes = collections.Counter()
    for _, text, _, source in texts:
        sizes[source] += len((text or "").encode().split())
    want = level_targets(sizes)
    got = mixing.mixed(docs).collect()
    assert len(got) == len(texts) and rows_of(mixing.mixed(clashing)) == rows_of(mixing.mixed(docs.repartition(5)))
    assert mixing.mixed(empty).count() == 0
    taken = collections.Counter()
    by_target = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[round(r["target"], 6), r["source_size"]] += r["taken"]
    for source, target in want.items():
        key = next(k for k in taken if abs(k[0] - target) < 1e-5 and k[1] == sizes[source])
        by_target[source] = taken[key]
    assert all(-mixing.BLOCK * 2 <= by_target[s] - t <= 1e-6 for s, t in want.items() if list(want.values()).count(t) == 1)


def test_shards_hold_their_quotas(docs):
    sizes = mixing.sized(docs)
    sources = mixing.targets(sizes)
    mix = mixing.mixed_blocks(sizes, sources, levels=3).collect()
    assert len({(r["_row"], r["block"], r["pass"]) for r in mix}) == len(mix)
    per_shard = collections.Counter(r["shard"] for r in mix)
    assert len(per_shard) == 8 and max(per_shard.values()) - min(per_shard.values()) <= 3
    per_source = collections.Counter((r["shard"], r["source"]) for r in mix)
    assert len({v for (shard, source), v in per_source.items() if source == "s3"}) > 1


def test_block_texts_are_the_documents_words(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(rng.randint(0, 300))), "ab"[i % 2]) for i in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r["doc_id"]: r["taken"] for r in mixing.mixed(table).collect()}
    seen = collections.Counter()
    for r in mixing.block_texts(table).collect():
        assert all(w.startswith(f"d{r['doc_id']}w") for w in r["text"].split())
        seen[r["doc_id"]] += len(r["text"].split())
    assert {i: n for i, n in taken.items() if n} == dict(seen)


def test_reruns_agree_with_null_and_repeated_ids(spark):
    rng = random.Random(6)
    text = lambda: " ".join(f"w{rng.randint(0, 500)}" for _ in range(rng.randint(0, 300)))
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, text(), "abc"[i % 5 % 3]) for i in range(200)]
    rows += rows[:10]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    results, blocks = [], []
    for partitions in (1, 7):
        rng.shuffle(rows)
        table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(partitions)
        results.append(rows_of(mixing.mixed(table)))
        blocks.append(sorted((r["shard"], r["place"], r["text"]) for r in mixing.block_texts(table).collect()))
    assert results[0] == results[1] and blocks[0] == blocks[1]
    assert sum(len(b[2].split()) for b in blocks[0]) == sum(r["taken"] for r in mixing.mixed(table).collect())


def test_hypergeometric_draws(spark):
    from pyspark.sql import functions as F

    good, total, draws = 7, 20, 9
    u = (F.col("id") + 0.5) / 2000
    x = mixing.hypergeometric(F.lit(float(good)), F.lit(float(total)), F.lit(float(draws)), u)
    got = collections.Counter(int(r[0]) for r in spark.range(2000).select(x).collect())
    for k in range(0, 8):
        p = math.comb(good, k) * math.comb(total - good, draws - k) / math.comb(total, draws)
        assert abs(got[k] / 2000 - p) < 2e-3
    big = mixing.hypergeometric(F.lit(4e6), F.lit(1e7), F.lit(5e6), u)
    values = [r[0] for r in spark.range(2000).select(big).collect()]
    assert abs(sum(values) / 2000 - 2e6) < 10 and 700 < (sum((v - 2e6) ** 2 for v in values) / 2000) ** 0.5 < 850


NAIVE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def naive_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(NAIVE.items()):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and disclosure.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end()))
    return sorted(out)


def test_entities_match_the_patterns():
    rng = random.Random(7)
    alphabet = ["a", "B", "9", "1", "0", "@", ".", "-", "_", "%", "+", " ", "(", ")", "é", "\n", "4111111111111111", "255", "x@y.z", "+49 ", "0007"]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        assert [f[:3] for f in disclosure.entities(text)] == naive_spans(text), text


def test_long_runs_take_linear_time():
    for text in ("9" * 200_000, "a" * 200_000, "a." * 100_000 + "@", "1." * 100_000, "+" * 200_000, "@a" * 100_000):
        disclosure.entities(text)


def test_digest(docs, clashing, empty, texts):
    want = []
    for i, text, *_ in texts:
        found = naive_spans(text or "")
        base = ",".join(f"{disclosure.KINDS[k]}:{s}:{e}" for s, k, e in found)
        counts = [sum(k == n for _, k, _ in found) for n in range(4)]
        want.append((i, *counts, hashlib.sha256(base.encode()).hexdigest()))
    assert sum(map(sum, (w[1:5] for w in want))) > 20
    for table in (docs, clashing):
        assert rows_of(disclosure.pii_digest(table).drop("spans")) == sorted(want, key=repr)
    assert disclosure.pii_digest(empty).count() == 0


def test_disclosing_terms(spark):
    """A nickname stands by one address in different texts and nowhere else; its common neighbours do not tell."""
    rng = random.Random(3)
    common = ["alpha", "beta", "gamma", "delta", "omega"]
    rows = [(i, " ".join(rng.choice(common) for _ in range(12))) for i in range(200)]
    rows += [(200 + i, f"{rng.choice(common)} Zorro{'!' * i} {rng.choice(common)} bob@mail.example.com {' '.join(rng.choice(common) for _ in range(5))}") for i in range(4)]
    rows += [(300 + i, "copied lonely words ann@mail.example.com copied") for i in range(5)]
    got = {r["doc_id"]: r for r in disclosure.pii_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(4):
        start = rows[200 + i][1].index("Zorro")
        assert f"remove:{start}:{start + 5}" in got[200 + i]["spans"].split(",")
        assert got[200 + i]["spans"].count(":") == 4 and got[200 + i]["n_email"] == 1
    # copies of one passage are one context, so its words are no evidence
    assert all(got[300 + i]["spans"].startswith("email:") and got[300 + i]["spans"].count(":") == 2 for i in range(5))
    assert all(got[i]["spans"] == "" for i in range(200))


def test_terms_far_from_the_entity_count(spark):
    """A name in the heading and the address at the foot of a long text."""
    rng = random.Random(4)
    common = ["alpha", "beta", "gamma", "delta", "omega"]
    filler = lambda n: " ".join(rng.choice(common) for _ in range(n))
    rows = [(i, filler(12)) for i in range(200)]
    rows += [(200 + i, f"{filler(i + 1)} Zorro {filler(200)} bob@mail.example.com") for i in range(4)]
    copied = f"lonely heading {filler(200)} ann@mail.example.com"
    rows += [(300 + i, copied) for i in range(5)]
    got = {r["doc_id"]: r["spans"].split(",") for r in disclosure.pii_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(4):
        start = rows[200 + i][1].index("Zorro")
        assert got[200 + i][0] == f"remove:{start}:{start + 5}" and len(got[200 + i]) == 2
    assert all(len(got[300 + i]) == 1 for i in range(5))


def test_mutual_information_by_hand(spark):
    rows = [(0, "tell x@y.zz now"), (1, "tell x@y.zz later"), (2, "tell nobody"), (3, "now")] + [(i, "other") for i in range(4, 16)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = disclosure.find_entities(table)
    got = disclosure.disclosing_terms(found, disclosure.document_frequencies(table), generalise=0.0).collect()
    want = math.log2(2 * 16 / (2 * 3)) / math.log2(16 / 2)
    assert len(got) == 1 and abs(got[0]["share"] - want) < 1e-9 and got[0]["action"] == (5 if want >= disclosure.REMOVE else 4)


def test_sanitised_text():
    assert disclosure.sanitised("by Zorro x@y.z in Rome", [(3, "remove", 8), (9, "email", 14), (18, "generalise", 22)]) == "by  [email] in [term]"
    assert disclosure.sanitised("abcdef", [(0, "card", 4), (2, "phone", 6)]) == "[card]"


def test_alnum_words():
    assert alnum_words("Ab-C é9_x".encode()) == [b"ab", b"c", "é9".encode(), b"x"]


def test_entities_of_the_same_documents_are_one_class(spark):
    """Two directories with the same 300 addresses and words: rows grow with the words, not with both."""
    rng = random.Random(8)
    names = [f"p{i}@host{i}.example.org" for i in range(300)]
    words = [f"word{chr(97 + i % 26)}{i}" for i in range(300)]
    page = lambda: " ".join(x for pair in zip(rng.sample(names, 300), rng.sample(words, 300)) for x in pair)
    rows = [(0, page()), (1, page()), (2, f"{names[0]} {words[0]} once more")] + [(i, "plain text") for i in range(3, 40)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = disclosure.stored(disclosure.find_entities(table).withColumn("_row", disclosure.F.monotonically_increasing_id()), "found")
    frequencies = disclosure.stored(disclosure.document_frequencies(table), "frequencies")
    classes = disclosure.entity_classes(found)
    members = {}
    for r in classes.collect():
        members.setdefault(r["class"], []).append(r["de"])
    assert sorted((len(x), set(x)) for x in members.values()) == [(1, {3}), (299, {2})]
    held = disclosure.held_terms(found, frequencies, classes)
    assert held.count() <= 2 * 2 * 300 + 1 and held.agg(disclosure.F.max("df")).first()[0] == 3
    # every word of the directories tells the addresses, each in all documents that hold both
    got = {r["doc_id"]: r["spans"].split(",") for r in disclosure.pii_digest(table).collect()}
    assert [len([x for x in got[i] if x.startswith(("remove", "generalise"))]) for i in (0, 1)] == [300, 300]


def test_sanitised_tables(spark, docs, clashing, empty):
    rows = [(i, f"{'x ' * (i % 3)}Zorro told {'y ' * i}to bob@mail.example.com", i) for i in range(4)]
    rows += [(i, "told to x y", i) for i in range(4, 100)] + [(None, None, 1), (100, "", 2), (101, "at 10.0.0.1", 3), (101, "at 10.0.0.1", 4)]
    table = spark.createDataFrame(rows, "doc_id long, text string, `_key1` long")
    got = {(r["doc_id"], r["_key1"]): r["text"] for r in disclosure.sanitised_texts(table).collect()}
    assert len(got) == len(rows)
    assert got[(None, 1)] is None and got[(100, 2)] == "" and got[(101, 3)] == got[(101, 4)] == "at [ip]" and got[(50, 50)] == "told to x y"
    for i in range(4):
        assert got[(i, i)] == f"{'x ' * (i % 3)} told {'y ' * i}to [email]"
    assert disclosure.sanitised_texts(empty).count() == 0
    out = disclosure.sanitised_texts(clashing)
    assert out.columns == clashing.columns and out.count() == docs.count()
    assert not [r for r in out.select("text").collect() if r["text"] and "@example.com" in r["text"]]


def test_term_categories():
    assert [disclosure.term_category(x) for x in ("Rome", "rome", "12", "a1", "é")] == ["name", "word", "number", "code", "word"]
    assert disclosure.sanitised("in Rome at 12", [(3, "generalise", 7), (11, "generalise", 13)], disclosure.term_category) == "in [name] at [number]"
