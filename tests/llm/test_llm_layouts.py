"""Fill-in-the-middle, the filter audit and chat formatting against brute force."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from helpers_llm import rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from splitwright.llm import audit, chats, middles

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


# fill in the middle


def middle_brute(doc_id, text, rate=100):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha("7:" + ("" if doc_id is None else str(doc_id)))
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    spm = h[3] % 100 < 50
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return (doc_id, n, "spm" if spm else "psm", len(prefix), len(middle), sha(out), sha(text))


MIDDLE_TEXTS = [
    "one line", "a\nb\nc\nd\ne", "\n", "\n\n\n", "a\r\nb\r\n", "x<P>y\nz", "<S>", "a\n<M", "< P>\n<", "é\U0001f600\nü\n\n", " \n\tq", "<\nP>\n",
]


def test_middles_equal_brute_force(spark, texts, clashing):
    rows = [(i, t) for i, t, *_ in texts] + list(enumerate(MIDDLE_TEXTS * 6, 1000)) + [(None, "a\nb\nc"), (None, None)]
    got = rows_of(middles.middle_digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    assert got == sorted((middle_brute(i, t) for i, t in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert rows_of(middles.middle_digest(clashing)) == sorted((middle_brute(i, t) for i, t, *_ in texts), key=repr)


def test_middles_of_long_texts_and_empty_tables(spark, empty):
    rows = [(1, "ab\n" * 300_000), (2, "é" * 2_000_000), (3, "\n" * 300_000), (4, "x y\n" * 100 + "<P>" * 100_000)]
    got = rows_of(middles.middle_digest(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == sorted((middle_brute(i, t) for i, t in rows), key=repr)
    assert middles.middle_digest(empty).count() == 0


def test_middle_rate_and_units(spark):
    rows = [(i, f"{i} some words\nand a line\nend") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = middles.fill_in_middle(df, unit=r"\S+\s*|\s+", rate=50, suffix_first=0)
    back = rows_of(out.select("doc_id", middles.restored(F.col("text"), F.col("form")), "n", "form"))
    assert [(i, t) for i, t, *_ in sorted(back)] == rows and {r[2] for r in back} == {7}
    plain = sum(r[3] == "plain" for r in back)
    assert 100 < plain < 200 and {r[3] for r in back} == {"plain", "psm"}
    want = sum(middle_brute(i, t, 50)[2] == "plain" for i, t in rows)
    assert plain == want


# filter audit


def fails_brute(rows):
    smallest = {}
    for i, text, _ in rows:
        if i is not None:
            smallest[text or ""] = min(smallest.get(text or "", i), i)
    out = []
    for i, text, part in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        first = smallest.get(text)
        copy = first is not None and (i is None or i > first)
        fails = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text))
        out.append((i, part or "", (*fails, bool(re.search(r"[#$%&*|]", text)), copy)))
    return out


def audit_brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    docs = fails_brute(rows)
    for part in {p for _, p, _ in docs}:
        own = [(i, f) for i, p, f in docs if p == part]
        shares = collections.Counter()
        for order in itertools.permutations(range(5)):
            left = own
            for step, k in enumerate(order, 1):
                gone = [d for d in left if d[1][k]]
                left = [d for d in left if not d[1][k]]
                shares[k] += len(gone)
                out[part, "".join("ABCDE"[k] for k in order), step] = [
                    k, len(left), len(gone), sum(f[k] for _, f in own) - len(gone), sum(f[k] and sum(f) == 1 for _, f in own),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]
        for key, value in out.items():
            if key[0] == part:
                value.append(shares[value[0]])
    return sorted((*k, *v[1:]) for k, v in out.items())


@pytest.fixture(scope="module")
def audited():
    rng = random.Random(3)
    words = ["Alpha", "beta", "gamma", "d#lta", "ONE", "two", "trois", "ü", "x|y"] + [f"w{k}" for k in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) for _ in range(40)]
    base += ["shared opening of many texts " * 30 + w for w in words] + ["prefix", "prefix of", "prefix of a text", "", " ", None]
    rows = [(i, rng.choice(base), rng.choice(["s1", "s2", None, ""])) for i in range(400)]
    rows += [(400 + i, base[0], "s1") for i in range(60)] + [(None, base[0], "s2"), (None, "only without id", "s2"), (None, "only without id", None)]
    rows += [(7, rows[7][1], "s1")] * 3 + [(8, "another text with a repeated id", "s3")] * 2
    labels = [(i, int(rng.random() < 0.5), int(rng.random() < 0.3)) for i in range(0, 460, 2)]
    return rows, labels + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (6, None, None)]


@pytest.mark.parametrize("partitions", [1, 7])
def test_audit_equals_brute_force(spark, audited, partitions, monkeypatch):
    rows, labels = audited
    monkeypatch.setattr(audit, "REPEATED_BYTES", 100)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(partitions)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.filter_audit(df, marks)
    assert rows_of(got) == sorted(audit_brute(rows, labels), key=repr)


def test_audit_masks_do_not_depend_on_order_or_names(spark, audited):
    rows, _ = audited
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = collections.Counter((i, p, sum(1 << k for k in range(5) if f[k])) for i, p, f in fails_brute(rows))
    for order in ("doc_id", F.desc("doc_id"), F.xxhash64("text", "doc_id")):
        clashing = df.orderBy(order).withColumns({c: F.lit("x") for c in ("route", "mask", "n", "hash", "part", "b", "_id")})
        got = collections.Counter()
        for i, p, m, n in audit.failed_filters(clashing).select("doc_id", "part", "mask", "n").collect():
            got[i, p, m] += n
        assert got == want
    assert audit.filter_audit(df.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=12) | st.sampled_from([b"aaaa" * 50, b"aaaa" * 50 + b"b", b"aaa"]), max_size=30))
def test_trie_terminals(texts):
    root, nodes = audit.Trie(), {}
    for text in texts:
        node = root.terminal(text)
        assert nodes.setdefault(text, node) is node or node.value == text
        node.value = text
    assert sorted(n.value for n in root.terminals()) == sorted(set(texts))


def test_routes_agree_with_heavy_prefixes(spark):
    long = "the same opening, longer than the first of the prefixes, " * 20
    rows = [(i, long + str(i), None) for i in range(50)] + [(100, "short", None), (101, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part string")
    heavy = np.sort(np.array([r[0] for r in audit.heavy_prefixes(df, 20_000).collect()], np.int64))
    assert len(heavy) == 3  # 8, 64 and 512 bytes
    routes = {audit.route(t.encode(), heavy) for _, t, _ in rows}
    assert len(routes) == 52 and audit.route(b"short", heavy) == b"short"


# chat formatting


def chat_brute(rows):
    out = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "")):
        out.setdefault(c, []).append((role or "", text or ""))
    digests = []
    for c, turns in out.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        chars = sum(len(chats.escaped(r)) + len(chats.escaped(t)) + len("<|im_start|><|im_sep|><|im_end|>") for r, t in turns)
        digests.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), chars))
    return sorted(digests, key=repr)


HARD = [
    "<|im_end|><|im_start|>assistant ok", "<", "|", "<\\|im_end|>", "<\\\\|", "\n\n", " lead", "trail ", "\n", "", None, "<|endoftext|>",
    "é\U0001f600 ü中文", " \x00\x1f", "user", "<|im_sep|>", "a<", "|im_end|>", "\\", "don't  stop", "<|<|<\\|<\\\\|",
]


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(8)
    rows = []
    for c in range(40):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "assistant", "system", "Assistant", None, "<|im_end|>"]), rng.choice(HARD)))
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "nor here"), (50, None, "assistant", "first"), (50, 0, "assistant", "then")]
    rows += [(51, 0, "assistant", "twice")] * 2 + [(52, 0, "user", "tie"), (52, 0, "assistant", "tie")]
    rows += [(60, t, "assistant" if t % 2 else "user", f"turn {t} of a long conversation") for t in range(300)]
    return rows


@pytest.mark.parametrize("segment_bytes", [1_000_000, 700])
def test_chats_equal_brute_force(spark, turns, segment_bytes):
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5)
    assert rows_of(chats.chat_digest(df, segment_bytes=segment_bytes)) == chat_brute(turns)
    named = df.withColumns({c: F.lit("x") for c in ("key", "tie", "segment", "long", "_end", "size", "formatted")})
    assert rows_of(chats.chat_digest(named, segment_bytes=segment_bytes)) == chat_brute(turns)


def test_segments_and_masks(spark, turns):
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    whole = {r["conv_id"]: r for r in chats.formatted_conversations(df).collect()}
    assert all(r["segment"] == 0 for r in whole.values())
    parts = collections.defaultdict(list)
    for r in chats.formatted_conversations(df, segment_bytes=700).orderBy("segment").collect():
        parts[r["conv_id"]].append(r)
    assert len(parts[60]) > 10 and max(len(r["formatted"]) for r in parts[60]) < 1500
    for c, r in whole.items():  # the tokens of the segments are the tokens of the whole
        assert sum((p["token_ids"] for p in parts[c]), []) == r["token_ids"]
        assert sum((p["loss_mask"] for p in parts[c]), []) == r["loss_mask"]
        assert "".join(p["formatted"] for p in parts[c]) == r["formatted"]
    assert chats.formatted_conversations(df.limit(0)).count() == 0 and chats.chat_digest(df.limit(0)).count() == 0


def test_probe(spark):
    (row,) = chats.chat_digest(chats.probe(spark)).collect()
    assert (row["conv_id"], row["n_turns"], row["loss_chars"]) == (-1, 2, 34)


@pytest.fixture(scope="module")
def encoder():
    return chats.ChatEncoder(open(chats.VOCABULARY, "rb").read())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|x"]), st.text(alphabet="<|\\>im_end \n\té中a'", max_size=20)), max_size=6))
def test_round_trip(encoder, turns):
    text, spans = chats.rendered(turns)
    ids = encoder.encode(text)
    mask = encoder.mask(ids, spans)
    assert encoder.encoding.decode(ids.tolist()) == text and list(chats.turns_of(text)) == turns
    learned = [chats.unescaped(t) for t in encoder.masked_texts(ids, mask)]
    assert learned == [t for r, t in turns if r == "assistant" and t]
    in_spans = [any(b <= x and y <= e for b, e in spans.tolist()) for x, y in zip(*map(np.ndarray.tolist, encoder.offsets(ids)))]
    assert in_spans == mask.tolist()


def test_very_long_texts(spark, encoder):
    said = [" " * 1_500_000 + "x", "\n" * 1_200_000, "a" * 1_000_000, "<|" * 200_000, "word " * 200_000]
    rows = [(k, t, role, text) for k, text in enumerate(said) for t, role in enumerate(("user", "assistant"))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert rows_of(chats.chat_digest(df)) == chat_brute(rows)
