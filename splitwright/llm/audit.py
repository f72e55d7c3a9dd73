"""Audit of filters that interact: what each removes at each place of each order.

Four filters look at one text; the fifth removes texts that a smaller id has too. Copies are found with
compressed tries over whole texts. Rows are range-partitioned by a prefix of the text that is as long as it
has to be: a prefix that stands before more than a partition's share of bytes is lengthened. Each partition
inserts its texts into a radix trie, whose terminals hold the smallest id; a row that loses at a terminal is a
copy. Of rows with one text only those that are the smallest of their task so far carry it across the network.

What fails which filters is a five-bit mask, and all reported numbers are sums over the counted masks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitwright.functions.names import spread_key
from splitwright.llm.text import bounded_batches, documents, texts_of
from splitwright.operators.checks import require_columns
from splitwright.session import lookup_side

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
#: Text bytes that one trie is meant for, and what a row counts besides its text.
TRIE_BYTES, ROW_BYTES = 32_000_000, 64
#: Lengths of prefixes in bytes. A text of at most one of them is its own prefix there.
PREFIXES = tuple(8 * 8**k for k in range(9))
#: Different texts that a task remembers to settle its own copies.
REMEMBERED = 500_000
REPEATED_BYTES = 8_000_000
_CAPITALS = bytes(range(65, 91))
_FOLLOWING = bytes(range(0x80, 0xC0))
_SIGNS = b"#$%&*|"
_PLAIN = "doc_id long, part string, mask int, n long"
_ROUTED = f"route binary, text binary, {_PLAIN}"


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()
    few = len(words) < MIN_WORDS
    repeated = 100 * len(set(words)) < DISTINCT_PERCENT * len(words)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    loud = 100 * capitals > CAPITAL_PERCENT * len(text.translate(None, _FOLLOWING))
    signs = len(text) != len(text.translate(None, _SIGNS))
    return few | repeated << 1 | loud << 2 | signs << 3


class Trie:
    """Compressed trie of byte strings. A terminal holds the value of the text that ends there."""

    __slots__ = ("label", "children", "value")

    def __init__(self, label: bytes = b"", value=None):
        self.label, self.value = label, value
        self.children: dict[int, Trie] = {}

    def terminal(self, text: bytes) -> Trie:
        """The node where ``text`` ends, made if there is none."""
        node, at = self, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                leaf = node.children[text[at]] = Trie(text[at:])
                return leaf
            if not text.startswith(child.label, at):
                child = node.split(child, _common(child.label, text, at))
            node, at = child, at + len(child.label)
        return node

    def split(self, child: Trie, length: int) -> Trie:
        """Put a node for the first ``length`` bytes of the child's label above the child."""
        upper = Trie(child.label[:length])
        child.label = child.label[length:]
        upper.children[child.label[0]] = child
        self.children[upper.label[0]] = upper
        return upper

    def terminals(self) -> Iterator[Trie]:
        """All nodes with a value, without recursion: a path may have as many nodes as a text has bytes."""
        todo = [self]
        while todo:
            node = todo.pop()
            if node.value is not None:
                yield node
            todo.extend(node.children.values())


def _common(label: bytes, text: bytes, at: int) -> int:
    """Length of the longest common prefix of ``label`` and ``text[at:]``, by bisection."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(label[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


def heavy_prefixes(rows: DataFrame, share: float) -> DataFrame:
    """``hash`` of the prefixes that stand before more than ``share`` bytes."""
    raw, size = F.col("text").cast("binary"), F.octet_length("text")
    own = F.filter(F.array(*map(F.lit, PREFIXES)), lambda n: (n == PREFIXES[0]) | (n / 8 < size))
    parts = rows.select(F.explode(F.transform(own, lambda n: F.xxhash64(F.substring(raw, F.lit(1), n)))).alias("hash"), (size + ROW_BYTES).alias("b"))
    return parts.groupBy("hash").agg(F.sum("b").alias("b")).where(F.col("b") > share).select("hash")


def route(text: bytes, heavy: np.ndarray) -> bytes:
    """Place in the order of ranges: the first bytes, then a hash of the shortest prefix that is not heavy."""
    first = text[: PREFIXES[0]]
    for n in PREFIXES:
        key = np.uint64(xxhash.xxh64_intdigest(text[:n], 42)).astype(np.int64)
        at = np.searchsorted(heavy, key)
        if at == len(heavy) or heavy[at] != key or n >= len(text):
            break
    return first if n == PREFIXES[0] else first + int(key).to_bytes(8, "big", signed=True)


def _batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    columns = list(zip(*rows))
    types = {"route": pa.binary(), "text": pa.binary(), "doc_id": pa.int64(), "part": pa.string(), "mask": pa.int32(), "n": pa.int64()}
    fields = [f.split()[0] for f in names.split(", ")]
    return pa.record_batch([pa.array(c, types[f]) for c, f in zip(columns, fields)], fields)


def _order(doc_id: int | None) -> tuple:
    return (doc_id is None, doc_id or 0)


def _candidates(heavy: np.ndarray):
    """Rows of ``doc_id, text, part``: the first of a text, and smaller ones after it, keep the text; others are copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lowest: dict[bytes, tuple] = {}
        again: dict[tuple, list] = {}  # rows that repeat an id and its text
        held = 0

        def repeated() -> list[tuple]:
            rows = [(route(text, heavy), text, *key[1:], 0, n) for key, (text, n) in again.items()]
            again.clear()
            return rows

        for batch in batches:
            out = []
            for doc_id, text, part in zip(batch["doc_id"].to_pylist(), texts_of(batch["text"]), batch["part"].to_pylist()):
                digest, order = hashlib.sha256(text).digest(), _order(doc_id)
                before = lowest.get(digest)
                if before is not None and before < order:
                    place = xxhash.xxh64_digest(b"%d/%a" % (len(out), doc_id))  # copies may go anywhere
                    out.append((place, None, doc_id, part, text_mask(text) | COPY, 1))
                    continue
                if before == order:
                    entry = again.setdefault((digest, doc_id, part), [text, 0])
                    entry[1] += 1
                    held += len(text) if entry[1] == 1 else 0
                    continue
                if len(lowest) >= REMEMBERED:
                    lowest.clear()
                lowest[digest] = order
                out.append((route(text, heavy), text, doc_id, part, 0, 1))
            if held > REPEATED_BYTES:
                out += repeated()
                held = 0
            if out:
                yield _batch(out, _ROUTED)
        if again:
            yield _batch(repeated(), _ROUTED)

    return run


def _inserted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Masks of one range of rows. A terminal's value is ``[order, {(doc_id, part): n}, mask]``."""
    root = Trie()
    for batch in batches:
        out = []
        rows = zip(*(batch[c].to_pylist() for c in ("text", "doc_id", "part", "mask", "n")))
        for text, doc_id, part, mask, n in rows:
            if text is None:
                out.append((doc_id, part, mask, n))
                continue
            node, order, key = root.terminal(text), _order(doc_id), (doc_id, part)
            if node.value is None:
                node.value = [order, {key: n}, text_mask(text)]
                continue
            least, held, mask = node.value
            if order > least:
                out.append((*key, mask | COPY, n))
            elif order == least:
                held[key] = held.get(key, 0) + n
            else:
                out += [(*k, mask | COPY, m) for k, m in held.items()]
                node.value = [order, {key: n}, mask]
        if out:
            yield _batch(out, _PLAIN)
    out = []
    for node in root.terminals():
        out += [(*k, node.value[2], m) for k, m in node.value[1].items()]
        if len(out) >= 10_000:
            yield _batch(out, _PLAIN)
            out = []
    if out:
        yield _batch(out, _PLAIN)


def failed_filters(docs: DataFrame, part_col: str = "source") -> DataFrame:
    """``doc_id, part, mask, n``: what each document fails, bit k for the k-th letter of ``FILTERS``.

    ``n`` rows that share id, part and text may come as one. A null text counts as empty and a null part as the
    empty string. A null id is larger than all others; rows with the smallest id of a text, several of them if ids repeat, are no
    copies. Other columns are not read; an empty table gives an empty one. Texts of any length are compared whole.
    """
    bounded_batches(docs.sparkSession)
    rows = documents(docs.withColumn("part", F.coalesce(F.col(part_col).cast("string"), F.lit(""))), "part")
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    total = rows.agg(F.sum(F.octet_length("text") + ROW_BYTES)).first()[0] or 0
    spark = docs.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TRIE_BYTES + 1)
    # at most as many as there are ranges, for each length of prefix
    heavy = np.sort(np.array([r[0] for r in heavy_prefixes(rows, total / ranges).collect()], np.int64))
    routed = rows.mapInArrow(_candidates(heavy), _ROUTED)
    return routed.repartitionByRange(ranges, "route").mapInArrow(_inserted, _PLAIN)


def failure_counts(docs: DataFrame, labels: DataFrame, part_col: str = "source") -> DataFrame:
    """``part, mask, n, good, toxic``: documents by mask, and how many of them are labelled so.

    A document is good or toxic if any label of its id says so; ids without labels, and null ids, are neither.
    """
    require_columns(labels, ["doc_id", "quality", "toxic"], "labels")
    flags = [F.max((F.col(c) == 1).cast("long")).alias(out) for c, out in (("quality", "good"), ("toxic", "toxic"))]
    known = lookup_side(labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("string").alias("_id")).agg(*flags))
    failed = failed_filters(docs, part_col)
    failed = failed.withColumn("_id", spread_key(F.col("doc_id").cast("string"), F.struct("part", "mask", "n")))
    joined = failed.join(known, "_id", "left")
    counted = [F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")]
    return joined.groupBy("part", "mask").agg(F.sum("n").alias("n"), *counted)


def filter_orders() -> list[tuple[str, int, int, int]]:
    """``filter_order, step, bit, before`` of every step of every order; 600 rows."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            out.append(("".join(order), step, bit, before))
            before |= bit
    return out


def filter_audit(docs: DataFrame, labels: DataFrame, part_col: str = "source") -> DataFrame:
    """One row for each part, order of the filters and step, zeros included.

    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``. A step
    depends only on its filter and the set of those before it, so sums are made for these 80 states and dealt out to
    the 600 steps. See :func:`failed_filters` and :func:`failure_counts` for nulls, repeated rows and ties; no documents, no rows.
    """
    spark = docs.sparkSession
    orders = filter_orders()
    states = F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(p).alias("before")) for b, p in sorted({o[2:] for o in orders})])
    rows = failure_counts(docs, labels, part_col).select("*", F.inline(states))
    mask, bit, before = F.col("mask"), F.col("bit"), F.col("before")
    fails, earlier = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) != 0
    total = lambda when, value: F.sum(F.when(when, F.col(value)).otherwise(F.lit(0)))
    # a filter is the first to fail a document in this many of the 120 orders
    firsts = (F.lit(120) / F.bit_count(mask)).cast("long")
    sums = rows.groupBy("part", "bit", "before").agg(
        total(~fails & ~earlier, "n").alias("kept"),
        total(fails & ~earlier, "n").alias("removed"),
        total(fails & earlier, "n").alias("redundant"),
        total(mask == bit, "n").alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"),
        total(fails & ~earlier, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, F.col("n") * firsts).otherwise(F.lit(0))).alias("shapley"),
    )
    steps = spark.createDataFrame(orders, "filter_order string, step int, bit int, before int")
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return sums.join(steps, ["bit", "before"]).select("part", "filter_order", "step", *names)


SQL = """
with d as (select doc_id, coalesce(text, '') as t, coalesce(source, '') as part from documents),
w as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as words, min(doc_id) over (partition by t) as first from d),
l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
m as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, [len(words) < 50,
  100 * len(list_distinct(words)) < 65 * len(words),
  100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
  regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > first, first is not null)] as f from w left join l on w.doc_id = l.doc_id),
c as (select part, f, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic from m group by part, f),
x as (select unnest(range(1, 6)) as i),
o as (select [a.i, b.i, c.i, d.i, e.i] as p from x a, x b, x c, x d, x e
  where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s as (select p, i as step, p[i] as own, p[1:i - 1] as before from o, x),
r as (select part, p, step, n, good, toxic, f[own] as fails,
  len(list_filter(before, lambda k: f[k])) > 0 as earlier, len(list_filter(f, lambda v: v)) as fails_of from c, s)
select part, array_to_string(list_transform(p, lambda k: substr('ABCDE', k, 1)), '') as filter_order, cast(step as integer) as step,
  cast(coalesce(sum(n) filter (where not fails and not earlier), 0) as bigint) as kept,
  cast(coalesce(sum(n) filter (where fails and not earlier), 0) as bigint) as removed,
  cast(coalesce(sum(n) filter (where fails and earlier), 0) as bigint) as redundant,
  cast(coalesce(sum(n) filter (where fails and fails_of = 1), 0) as bigint) as unique_fails,
  cast(coalesce(sum(good) filter (where fails and not earlier), 0) as bigint) as good_lost,
  cast(coalesce(sum(toxic) filter (where fails and not earlier), 0) as bigint) as toxic_lost,
  cast(coalesce(sum(n * 120 // nullif(fails_of, 0)) filter (where fails), 0) as bigint) as shapley
from r group by part, p, step
"""
