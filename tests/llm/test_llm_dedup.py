"""Line, exact, near and byte-string deduplication against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
from helpers_llm import rows_of
from pyspark.sql import functions as F
from splitwright.llm import lines, near, recipes, repeats


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def line_brute(texts, least):
    split = [(i, (t or "").encode().split(b"\n")) for i, t, *_ in texts]
    key = lambda line: line.strip(b" \t\n\x0b\x0c\r").lower()
    count = collections.Counter(k for _, ls in split for k in {key(x) for x in ls} if k)
    out = []
    for i, ls in split:
        kept = [x for x in ls if count[key(x)] < least]
        out.append((i, len(ls), len(ls) - len(kept), sha(b"\n".join(kept))))
    return sorted(out, key=repr)


def test_lines(docs, clashing, texts):
    want = line_brute(texts, 5)
    assert any(r[2] for r in want)
    assert rows_of(lines.line_digest(docs, min_documents=5)) == want
    assert rows_of(lines.line_digest(clashing, min_documents=5)) == want


def test_lines_in_batches_need_no_order(spark, docs, texts, tmp_path):
    docs.repartition(7).write.parquet(str(tmp_path / "d"))
    read = spark.read.parquet(str(tmp_path / "d"))
    assert len(lines.file_batches(read, 5)) == 5
    assert rows_of(lines.line_digest(read, batches=5, min_documents=5)) == line_brute(texts, 5)


def test_lines_of_a_changed_table(spark, docs, texts, tmp_path):
    """Filters and new texts hold for the counts too; one file, and a file that is not Parquet, are dealt out as well."""
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    docs.select("doc_id", "text").coalesce(3).write.json(str(tmp_path / "j"))
    read = spark.read.parquet(str(tmp_path / "d"))
    assert len(lines.file_batches(read, 4)) == 4
    changed = read.where("doc_id < 40").withColumn("text", F.concat(F.lit("new "), F.regexp_replace("text", "\n", "\nnew ")))
    rows = [(i, "new " + t.replace("\n", "\nnew ")) for i, t, *_ in texts if i is not None and i < 40]
    for least in (3, 6, 7):
        assert rows_of(lines.line_digest(changed, min_documents=least)) == line_brute(rows, least)
    json = spark.read.schema("doc_id long, text string").json(str(tmp_path / "j"))
    assert rows_of(lines.line_digest(json, min_documents=5)) == line_brute(texts, 5)


def test_lines_of_an_empty_table(empty):
    assert rows_of(lines.line_digest(empty)) == []


def test_runs_are_compacted(spark):
    runs = lines.LineRuns(spark, min_documents=3)
    for _ in range(5):
        runs.add(spark.createDataFrame([("often\nrare" if _ == 0 else "often",)], "text string"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert runs.frequent().count() == 1


def exact_brute(texts):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, *_ in texts]
    groups = collections.defaultdict(list)
    for n, (i, *_) in zip(norm, texts):
        groups[n].append(i)
    keep = {n: min((i for i in ids if i is not None), default=None) for n, ids in groups.items()}
    return sorted(((i, keep[n], len(groups[n]), sha(n.encode())) for n, (i, *_) in zip(norm, texts)), key=repr)


def test_exact_groups(docs, clashing, texts):
    want = exact_brute(texts)
    for table in (docs, clashing):
        got = recipes.exact_groups(table).collect()
        assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == want
        assert collections.Counter(r["text_sha256"] for r in got if r["kept"]) == collections.Counter({w[3] for w in want})
        assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_without_copies_keeps_columns(clashing, empty, texts):
    kept = recipes.without_copies(clashing)
    assert kept.columns == clashing.columns
    assert kept.count() == len({w[3] for w in exact_brute(texts)})
    assert recipes.without_copies(empty).count() == 0


def test_chunks_are_content_defined_and_whole(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefmnop") for _ in range(5)) for _ in range(50)]
    body = " ".join(rng.choice(words) for _ in range(6000))
    table = spark.createDataFrame([(1, body), (2, "some words before it " + body), (3, "x" * 9000)], "doc_id long, text string")
    cut = {r["doc_id"]: r["_chunks"] for r in recipes.chunked(table).collect()}
    assert "".join(cut[1]) == body and "".join(cut[3]) == "x" * 9000
    assert len(cut[1]) > 10 and len(set(cut[1]) & set(cut[2])) > len(cut[1]) // 2


def test_chunks_follow_the_text_in_any_script(spark):
    rng = random.Random(3)
    scripts = {"cyrillic": "абвгдежзиклмнопрстуфхцчшщыэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "han": [chr(c) for c in range(0x4E00, 0x5200)]}
    bodies = {}
    for name, letters in scripts.items():
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(400)]
        bodies[name] = (" " if name != "han" else "").join(rng.choice(words) for _ in range(12_000))
    bodies["no blanks"] = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(100_000))
    bodies["hex"] = "".join(rng.choice("0123456789abcdef") for _ in range(100_000))
    rows = [(2 * i + k, "вставка" * k, b) for i, b in enumerate(bodies.values()) for k in (0, 1)]
    table = spark.createDataFrame([(i, more + body) for i, more, body in rows], "doc_id long, text string")
    cut = {r["doc_id"]: r["_chunks"] for r in recipes.chunked(table).collect()}
    for i, body in enumerate(bodies.values()):
        assert "".join(cut[2 * i]).encode("latin-1").decode() == body
        assert len(set(cut[2 * i]) & set(cut[2 * i + 1])) >= 0.9 * len(cut[2 * i]) > 50


def test_chunks_that_share_a_hash_stay_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    real = F.xxhash64
    # every single column hashes to its length: many chunks collide
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.length(c[0]).cast("long") if len(c) == 1 else real(*c))
    table = spark.createDataFrame([(1, "abc"), (2, "abd"), (3, "abc")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in recipes.exact_groups(table).collect()}
    assert got == {1: (1, 2), 2: (2, 1), 3: (1, 2)}


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_brute(texts):
    sets = [shingle_set(t) for _, t, *_ in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    head = collections.defaultdict(list)
    for a, (i, *_) in enumerate(texts):
        head[root(a)].append(i)
    smallest = {r: min((i for i in ids if i is not None), default=None) for r, ids in head.items()}
    return sorted(((i, len(sets[a]), smallest[root(a)]) for a, (i, *_) in enumerate(texts)), key=repr), len(head)


def test_near_groups(docs, clashing, empty, texts):
    want, groups = near_brute(texts)
    assert groups < len(texts) - 10
    for table in (docs, clashing):
        got = near.near_groups(table).collect()
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == want
        assert sum(r["kept"] for r in got) == groups
    assert near.near_groups(empty).count() == 0
    kept = near.without_near_copies(clashing)
    assert kept.columns == clashing.columns and kept.count() == groups


def test_chains_and_strays_of_one_family(spark):
    """Texts that drift away from a common origin: links hold along the chain, not to the origin."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    origin = [rng.choice(words) for _ in range(200)]
    rows, chain = [(0, " ".join(origin))], list(origin)
    for i in range(1, 60):
        if i % 2:
            other = list(origin)
            for _ in range(rng.randint(3, 12)):
                other[rng.randrange(200)] = rng.choice(words)
        else:
            for _ in range(3):
                chain[rng.randrange(200)] = rng.choice(words)
            other = chain
        rows.append((i, " ".join(other)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = near.near_groups(table).collect()
    want = near_brute([(i, t) for i, t in rows])[0]
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == want


def test_registers_and_estimate():
    rng = np.random.default_rng(4)
    pool = np.unique(rng.integers(1, 1 << 63, 3000, dtype=np.uint64))
    a, b = near.mixed(pool[:2000]), near.mixed(pool[500:2500])
    regs = near.registers([np.unique(a), np.unique(b)])
    found = near.estimate(np.array([(regs[0] == regs[1]).mean()]), np.array([2000]), np.array([2000]))[0]
    assert abs(found - 1500 / 2500) < 0.2
    low = np.array([[1 << 63, (1 << 63) | (1 << 62), 1 << 40]], np.uint64)
    assert near.compressed(low).tolist() == [[0, 512, 23 << 10]]
    assert 0 < near._chance(20, 20) < 0.01


def bytes_brute(texts):
    raw = [(i, (t or "").encode()) for i, t, *_ in texts]
    n = repeats.LENGTH
    seen = collections.Counter(b[k : k + n] for _, b in raw for k in range(len(b) - n + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                gone[k : k + n] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), len(b) - len(kept), int((np.diff(gone.astype(int)) == -1).sum()), sha(kept)))
    return sorted(out, key=repr)


def test_repeats(docs, clashing, empty, texts):
    want = bytes_brute(texts)
    assert any(r[3] for r in want)
    assert rows_of(repeats.repeat_digest(docs)) == want
    assert rows_of(repeats.repeat_digest(clashing)) == want
    assert rows_of(repeats.repeat_digest(empty)) == []


def test_repeats_of_runs_and_periods(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD_BYTES", 700)
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    core = noise(230)
    rows = [(1, "a" * 1000), (2, "ab" * 300), (3, noise(500) + "\0" * 250), (4, noise(150) + core + noise(150)), (5, noise(199))]
    rows += [(i, noise(180) + core[: 200 + i] + noise(90)) for i in range(6, 26)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(repeats.repeat_digest(table)) == bytes_brute(rows)


def test_empty_texts_between_copies_have_no_spans(spark):
    copy = "".join(random.Random(2).choice("abcdefgh") for _ in range(300))
    rows = [(1, copy), (2, ""), (3, None), (4, copy), (5, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert rows_of(repeats.repeat_digest(table)) == bytes_brute(rows)


def test_a_hot_anchor_is_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD_BYTES", 2_000)
    rng = random.Random(7)
    noise = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    core = noise(260)
    rows = [(i, noise(rng.randint(20, 90)) + core[rng.randrange(50) :] + noise(rng.randint(20, 90))) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen = []
    monkeypatch.setattr(repeats, "hot_repeats", lambda x, f=repeats.hot_repeats: seen.append(x) or f(x))
    assert rows_of(repeats.repeat_digest(table)) == bytes_brute(rows)
    shards = collections.Counter((r["key"], r["_shard"]) for r in seen[0].collect())
    assert len(shards) > 2 and max(shards.values()) < 30


def test_suffix_arrays():
    rng = random.Random(3)
    for _ in range(200):
        data = np.array([rng.choice([0, 1, 2, 255]) for _ in range(rng.randint(1, 60))], np.uint8)
        raw = data.tobytes()
        order = repeats.suffix_array(data)
        assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        shared = repeats.common_prefixes(data, order).tolist()
        for k in range(1, len(raw)):
            x, y = raw[order[k - 1] :], raw[order[k] :]
            assert x[: shared[k]] == y[: shared[k]] and x[shared[k] : shared[k] + 1] != y[shared[k] : shared[k] + 1]


def test_shards_are_merged(monkeypatch):
    rng = random.Random(6)
    core = bytes(rng.randrange(256) for _ in range(260))
    texts = [bytes(rng.randrange(256) for _ in range(rng.randint(1, 60))) + core[rng.randrange(40) :] for _ in range(12)]
    one = [f.tolist() for f in repeats.repeats_within(texts, np.ones(12))]
    monkeypatch.setattr(repeats, "SHARD_BYTES", 600)
    assert [f.tolist() for f in repeats.repeats_within(texts, np.ones(12))] == one and any(one)
