"""Removal of repeated byte strings with suffix arrays.

Every byte that a string of ``LENGTH`` bytes covers which also starts elsewhere is removed. To keep suffix
arrays for where they are needed, the strings are first dealt out by an anchor: of the ``GRAM``-byte pieces
inside a string the one with the smallest hash. Equal strings have equal anchors, and strings in a row that
share their anchor form a segment. A segment whose anchor stands nowhere else repeats nothing; of equal
segments every byte goes. What is left, different segments around one anchor, is gathered by anchor into
shards, and each shard is sorted: Larsson-Sadakane refinement in numpy gives its suffix array, Kasai's
theorem the common prefixes, and neighbours that share ``LENGTH`` bytes are repeats. An anchor with more
segments than a shard may hold gets several, in tasks of their own; the hashes of their strings are added up.

Texts are kept in slices of some megabytes, compressed, so that later steps find them by slice number.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splitwright.llm.text import arrow_map, bounded_batches, documents, mixed, texts_of
from splitwright.session import stored

LENGTH = 200
GRAM = 64
SLICE_BYTES = 2_000_000
#: Bytes of one suffix array.
SHARD_BYTES = 1_000_000
_CHUNK = 1 << 21
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % (1 << 64), np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_UP = _powers(_BASE, _CHUNK + 2 * LENGTH)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), _CHUNK + 2 * LENGTH)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes at every position, from prefix sums modulo ``2 ** 64``."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * _UP[: len(data)], out=sums[1:])
        return mixed((sums[size:] - sums[:-size]) * _DOWN[: len(data) - size + 1])


def _lowest(hashes: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest of ``width`` hashes from every position on, the first of equal ones."""
    bits = np.uint64(23)
    best = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while size * 2 <= width:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if size < width:
        best = np.minimum(best[: len(best) - (width - size)], best[width - size :])
    return (best & np.uint64((1 << 23) - 1)).astype(np.int64)


def segments(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``key, low, high`` of each segment: hash of the anchor, first and last start of its strings.

    ``starts`` are the bounds of the documents in ``data``; strings never cross them.
    """
    keys, lows, highs = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    ends = np.repeat(starts[1:], np.diff(starts))
    for at in range(0, len(data) - LENGTH + 1, _CHUNK):
        part = data[at : at + _CHUNK + LENGTH - 1]
        hashes = gram_hashes(part, GRAM)
        anchor = _lowest(hashes, LENGTH - GRAM + 1)
        place = np.flatnonzero(np.arange(at, at + len(anchor)) + LENGTH <= ends[at : at + len(anchor)])
        if len(place) == 0:
            continue
        own = anchor[place]
        first = np.concatenate([[True], (own[1:] != own[:-1]) | (place[1:] != place[:-1] + 1)])
        begin = np.flatnonzero(first)
        end = np.append(begin[1:], len(place)) - 1
        keys.append(hashes[own[begin]])
        lows.append(place[begin] + at)
        highs.append(place[end] + at)
    return np.concatenate(keys), np.concatenate(lows), np.concatenate(highs)


class Slice:
    """The segments of a slice and their distinct ``(key, print)`` pairs in order."""

    def __init__(self, blob: bytes, sizes: np.ndarray):
        self.raw = zstandard.ZstdDecompressor().decompress(blob)
        self.data = np.frombuffer(self.raw, np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        key, self.low, self.high = segments(self.data, self.starts)
        prints = np.fromiter((xxhash.xxh3_64_intdigest(self.raw[a : b + LENGTH]) for a, b in zip(self.low, self.high)), np.uint64, len(key))
        pairs = np.empty(len(key), [("key", np.uint64), ("print", np.uint64)])
        pairs["key"], pairs["print"] = key, prints
        self.pairs, self.first, self.number, self.count = np.unique(pairs, return_index=True, return_inverse=True, return_counts=True)


def slices(docs: DataFrame) -> DataFrame:
    """``_slice, doc_id, size, blob``: documents of some megabytes in one row, texts compressed."""

    def run(batches):
        ids, sizes, texts, total = [], [], [], 0
        press = zstandard.ZstdCompressor(level=1)

        def row():
            columns = [pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([press.compress(b"".join(texts))], pa.binary())]
            return pa.record_batch(columns, ["doc_id", "size", "blob"])

        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), texts_of(batch["text"])):
                ids.append(doc)
                sizes.append(len(text))
                texts.append(text)
                total += len(text)
                if total >= SLICE_BYTES:
                    yield row()
                    ids, sizes, texts, total = [], [], [], 0
        if ids:
            yield row()

    bounded_batches(docs.sparkSession)
    found = documents(docs).mapInArrow(run, "doc_id array<long>, size array<int>, blob binary")
    return stored(found.withColumn("_slice", F.monotonically_increasing_id()), "slices")


def _opened(batch: pa.RecordBatch):
    for i in range(batch.num_rows):
        yield i, Slice(batch["blob"][i].as_py(), batch["size"][i].values.to_numpy())


def repeated_segments(parts: DataFrame) -> DataFrame:
    """``_slice, at, key, sure, mixed, lead`` of distinct segments of a slice whose anchor stands elsewhere too.

    ``sure``: the same segment stands elsewhere; ``mixed``: so does another segment with this anchor;
    ``lead``: of equal segments, the one that stands for all. A slice holds an equal segment once, so a
    passage that is everywhere counts one row a slice.
    """

    def work():
        def step(batch: pa.RecordBatch):
            for i, part in _opened(batch):
                n = len(part.pairs)
                yield pa.record_batch(
                    [
                        pa.array(part.pairs["key"].view(np.int64)),
                        pa.array(part.pairs["print"].view(np.int64)),
                        pa.array(part.count.astype(np.int32)),
                        pa.array(np.full(n, batch["_slice"][i].as_py(), np.int64)),
                        pa.array(np.arange(n, dtype=np.int32)),
                    ],
                    ["key", "print", "n", "_slice", "at"],
                )

        return step

    rows = stored(arrow_map(parts.select("_slice", "size", "blob"), work, "key long, print long, n int, _slice long, at int"), "segment-rows")
    anchors = rows.groupBy("key").agg(F.sum("n").alias("_total"), (F.min("print") != F.max("print")).alias("mixed"))
    anchors = stored(anchors.where(F.col("_total") > 1).select("key", "mixed"), "anchors")
    by_print = Window.partitionBy("key", "print")
    # the exchange lets the join split a hot anchor; a print has one row a slice
    rows = rows.join(anchors.hint("merge"), "key").repartition("key", "print").withColumns(
        {"sure": F.sum("n").over(by_print) > 1, "lead": F.min("_slice").over(by_print) == F.col("_slice")}
    )
    return stored(rows.select("_slice", "at", "key", "sure", "mixed", "lead"), "segments")


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order, by Larsson-Sadakane refinement.

    Suffixes are sorted by their first eight bytes; then the groups that are not yet settled are refined
    by the rank of the suffix ``depth`` further on, with ``depth`` doubling, until every group is one.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    first = np.zeros(n, np.uint64)
    for i in range(8):
        first = (first << np.uint64(8)) | padded[i : i + n]
    order = np.argsort(first, kind="stable")
    new = np.concatenate([[True], first[order][1:] != first[order][:-1]])
    # the end of the text sorts before every byte, zeros included
    tail = np.zeros(n, bool)
    tail[max(0, n - 8) :] = True
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    depth = 8
    if tail.any():  # short suffixes may tie with zeros; begin from single bytes when the text has them
        if (data[max(0, n - 16) :] == 0).any():
            order = np.argsort(data, kind="stable")
            new = np.concatenate([[True], data[order][1:] != data[order][:-1]])
            rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            depth = 1
    slots = np.flatnonzero(_in_groups(new))
    while len(slots):
        at = order[slots]
        group = rank[at]
        after = np.where(at + depth < n, rank[np.minimum(at + depth, n - 1)] + 1, 0)
        turn = np.argsort((group.astype(np.uint64) << np.uint64(32)) | after.astype(np.uint64), kind="stable")
        at, group, after = at[turn], group[turn], after[turn]
        order[slots] = at
        begin = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
        rank[at] = np.maximum.accumulate(np.where(begin, slots, 0))
        slots = slots[_in_groups(begin)]
        depth *= 2
    return order


def _in_groups(begin: np.ndarray) -> np.ndarray:
    """Members of groups of more than one, from the marks where groups begin."""
    return ~(begin & np.append(begin[1:], True))


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the prefix that each suffix shares with the one before it in ``order``.

    By Kasai's theorem the shared length falls by at most one from a position to the next. So it is
    measured only where the bytes before the two suffixes differ, and follows elsewhere.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    back = data[np.maximum(before, 1) - 1]
    measure = (before < 1) | (at == 0) | (data[np.maximum(at, 1) - 1] != back)
    shared = np.zeros(n, np.int64)
    left = np.flatnonzero(measure & (before >= 0))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    done = 0
    while len(left):
        a, b = left + done, before[left] + done
        inside = (a < n) & (b < n)
        left, a, b = left[inside], a[inside], b[inside]
        same = words[a] == words[b]
        run = np.where(same.all(axis=1), 8, same.argmin(axis=1))
        shared[left] += np.minimum(run, n - np.maximum(a, b))
        left = left[run == 8]
        done += 8
    reach = np.maximum.accumulate(np.where(measure, shared + at, 0)) - at
    return np.where(measure, shared, reach)[order]


def sorted_strings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all strings of ``LENGTH`` bytes in the texts, in suffix order: text number, start, class."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    order = suffix_array(data)
    classes = np.cumsum(common_prefixes(data, order) < LENGTH)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)[order]
    whole = order + LENGTH <= ends[owner]
    return owner[whole], (order - (ends - sizes)[owner])[whole], classes[whole]


def repeats_within(texts: list[bytes], weights: np.ndarray) -> list[np.ndarray]:
    """Of each text the starts of strings that occur again; a text of weight 2 stands for several.

    Texts beyond ``SHARD_BYTES`` are cut into shards. Each shard's distinct strings are kept as sorted
    hashes with their weights, in which the strings of other shards are found by binary search.
    """
    shards, held, size = [], [], 0
    for i, text in enumerate(texts):
        if held and size + len(text) > SHARD_BYTES:
            shards.append(held)
            held, size = [], 0
        held.append(i)
        size += len(text)
    shards.append(held)
    found = []
    for shard in shards:
        owner, start, classes = sorted_strings([texts[i] for i in shard])
        numbers = np.cumsum(np.concatenate([[0], classes[1:] != classes[:-1]])) if len(classes) else classes
        weight = np.bincount(numbers, weights=weights[shard][owner]) if len(numbers) else np.empty(0)
        found.append([np.array(shard)[owner], start, numbers, weight])
    if len(shards) > 1:
        tables = []
        for owner, start, numbers, weight in found:
            one = np.unique(numbers, return_index=True)[1]
            keys = np.array([xxhash.xxh3_64_intdigest(texts[owner[j]][start[j] : start[j] + LENGTH]) for j in one], np.uint64)
            turn = np.argsort(keys)
            tables.append((keys, keys[turn], weight[turn]))
        for i, (own, _, _) in enumerate(tables):
            for j, (_, keys, weight) in enumerate(tables):
                if i != j and len(keys):
                    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    found[i][3] = found[i][3] + np.where(keys[at] == own, weight[at], 0)
    out = [np.empty(0, np.int64) for _ in texts]
    for owner, start, numbers, weight in found:
        again = weight[numbers] > 1
        owner, start = owner[again], start[again]
        turn = np.lexsort((start, owner))
        owner, start = owner[turn], start[turn]
        for piece in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(owner)) + 1):
            if len(piece):
                out[owner[piece[0]]] = start[piece]
    return out


def ranges(starts: np.ndarray) -> list[int]:
    """Covered ranges of strings that begin at the sorted ``starts``, as start, end, start, end and so on."""
    if len(starts) == 0:
        return []
    gap = np.flatnonzero(np.diff(starts) > LENGTH)
    begin, end = np.append(starts[0], starts[gap + 1]), np.append(starts[gap], starts[-1]) + LENGTH
    return np.stack([begin, end], axis=1).ravel().tolist()


def segment_texts(parts: DataFrame, marked: DataFrame) -> DataFrame:
    """``key, _slice, at, sure, bytes`` of the leading segments whose anchor has several."""

    def work():
        def step(batch: pa.RecordBatch):
            for i, part in _opened(batch):
                want = batch["want"][i].values
                at = want.field("at").to_numpy()
                first = part.first[at]
                texts = [part.raw[a : b + LENGTH] for a, b in zip(part.low[first], part.high[first])]
                number = pa.array(np.full(len(at), batch["_slice"][i].as_py(), np.int64))
                yield pa.record_batch([want.field("key"), number, want.field("at"), want.field("sure"), pa.array(texts, pa.binary())], ["key", "_slice", "at", "sure", "bytes"])

        return step

    want = marked.where("mixed and lead").groupBy("_slice").agg(F.collect_list(F.struct("at", "key", "sure")).alias("want"))
    joined = parts.join(want.hint("merge"), "_slice").select("_slice", "size", "blob", "want")
    return arrow_map(joined, work, "key long, _slice long, at int, sure boolean, bytes binary")


def shard_repeats(texts: DataFrame) -> DataFrame:
    """``_slice, at, cover``: what suffix arrays find repeated in segments that stand only once.

    Segments of an anchor meet in one partition, ordered by anchor; anchors are packed into shards. Those of an
    anchor beyond ``SHARD_BYTES`` are dealt over several tasks.
    """
    texts = stored(texts, "segment-texts")
    sizes = texts.groupBy("key").agg(F.sum(F.length("bytes")).alias("_size")).where(F.col("_size") > SHARD_BYTES)
    hot = stored(sizes.select("key", F.ceil(F.col("_size") / SHARD_BYTES).alias("_shards")), "hot-anchors")
    if hot.isEmpty():
        return _packed_repeats(texts)
    return _packed_repeats(texts.join(hot, "key", "left_anti")).unionByName(hot_repeats(hot_segments(texts, hot)))


def hot_segments(texts: DataFrame, hot: DataFrame) -> DataFrame:
    """Segments of the anchors in ``hot``, dealt over the ``_shards`` of each by a hash of their place."""
    shard = F.pmod(F.xxhash64("_slice", "at"), F.col("_shards")).alias("_shard")
    return texts.join(hot, "key").select("key", shard, "_slice", "at", "sure", "bytes")


def hot_repeats(segments: DataFrame) -> DataFrame:
    """``_slice, at, cover`` like ``shard_repeats``, of segments dealt out by ``key, _shard``.

    Each shard gives the hashes of its distinct strings and their weights; added up by anchor and hash they
    tell which strings are repeated, and these go back to the shards that hold them.
    """

    def strings(group: pa.Table) -> pa.Table:
        _, _, numbers, weight, keys = _hashed_strings(group)
        columns = [pa.array([group[c][0].as_py()] * len(keys), pa.int64()) for c in ("key", "_shard")]
        return pa.table([*columns, pa.array(keys.view(np.int64)), pa.array(weight, pa.float64())], ["key", "_shard", "string", "weight"])

    def covers(group: pa.Table, again: pa.Table) -> pa.Table:
        found = []
        if group.num_rows and again.num_rows:
            owner, start, numbers, _, keys = _hashed_strings(group)
            hit = np.isin(keys.view(np.int64), again["string"].to_numpy())[numbers]
            owner, start = owner[hit], start[hit]
            turn = np.lexsort((start, owner))
            owner, start = owner[turn], start[turn]
            sure = group["sure"].to_pylist()
            for piece in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(owner)) + 1):
                if len(piece) and not sure[i := int(owner[piece[0]])]:
                    found.append((group["_slice"][i].as_py(), group["at"][i].as_py(), ranges(start[piece])))
        columns = [pa.array([f[c] for f in found], kind) for c, kind in enumerate((pa.int64(), pa.int32(), pa.list_(pa.int32())))]
        return pa.table(columns, ["_slice", "at", "cover"])

    dealt = ["key", "_shard"]
    held = stored(segments.groupBy(*dealt).applyInArrow(strings, "key long, _shard long, string long, weight double"), "hot-strings")
    repeated = held.groupBy("key", "string").agg(F.sum("weight").alias("weight")).where(F.col("weight") > 1).select("key", "string")
    again = held.select("key", "_shard", "string").join(stored(repeated, "hot-repeats"), ["key", "string"])
    return segments.groupBy(*dealt).cogroup(again.groupBy(*dealt)).applyInArrow(covers, "_slice long, at int, cover array<int>")


def _hashed_strings(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segment number, start and string number of all strings; weight and hash of each distinct string."""
    texts = group["bytes"].to_pylist()
    owner, start, classes = sorted_strings(texts)
    numbers = np.cumsum(np.concatenate([[0], classes[1:] != classes[:-1]])) if len(classes) else classes
    weights = np.where(group["sure"].to_numpy(), 2.0, 1.0)
    one = np.unique(numbers, return_index=True)[1]
    keys = np.array([xxhash.xxh3_64_intdigest(texts[owner[j]][start[j] : start[j] + LENGTH]) for j in one], np.uint64)
    return owner, start, numbers, np.bincount(numbers, weights=weights[owner], minlength=len(one)), keys


def _packed_repeats(texts: DataFrame) -> DataFrame:
    def work():
        def solved(rows):
            found = repeats_within([r[3] for r in rows], np.array([2.0 if r[2] else 1.0 for r in rows]))
            cover = [(r[0], r[1], ranges(f)) for r, f in zip(rows, found) if not r[2] and len(f)]
            return pa.record_batch(
                [pa.array([c[0] for c in cover], pa.int64()), pa.array([c[1] for c in cover], pa.int32()), pa.array([c[2] for c in cover], pa.list_(pa.int32()))],
                ["_slice", "at", "cover"],
            )

        return solved

    def run(batches):
        solved = work()
        rows, size, last = [], 0, None
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("key", "_slice", "at", "sure", "bytes")]
            for key, number, at, sure, text in zip(*columns):
                if size >= SHARD_BYTES // 2 and key != last:
                    yield solved(rows)
                    rows, size = [], 0
                rows.append((number, at, sure, text))
                size += len(text)
                last = key
        if rows:
            yield solved(rows)

    dealt = texts.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "_slice long, at int, cover array<int>")


def repeat_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept`` of every document.

    ``spans`` are the removed runs in bytes, ``kept`` what is left, which may cut characters. Null and empty
    texts have no bytes. Repeated rows are documents of their own, so their strings repeat each other.
    Other columns are not read.
    """
    parts = slices(docs)
    marked = repeated_segments(parts)
    covers = stored(shard_repeats(segment_texts(parts, marked)), "covers")
    whole = marked.where("sure").select("_slice", "at", F.array().cast("array<int>").alias("cover"))
    found = whole.unionByName(covers).groupBy("_slice").agg(F.collect_list(F.struct("at", "cover")).alias("found"))
    joined = parts.join(found.hint("merge"), "_slice", "left").select("doc_id", "size", "blob", "found")

    def work():
        def step(batch: pa.RecordBatch):
            for i, part in _opened(batch):
                yield _removed(part, batch["doc_id"][i].values, batch["found"][i])

        return step

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>, kept binary"
    return arrow_map(joined, work, schema)


def _removed(part: Slice, ids: pa.Array, found: pa.Scalar) -> pa.RecordBatch:
    change = np.zeros(len(part.data) + 1, np.int32)
    if found.is_valid:
        cover = dict(zip(found.values.field("at").to_pylist(), found.values.field("cover").to_pylist()))
        hit = np.zeros(len(part.pairs), bool)
        hit[list(cover)] = True
        for i in np.flatnonzero(hit[part.number]):
            pieces = cover[part.number[i]] or (0, part.high[i] - part.low[i] + LENGTH)
            for a, b in zip(pieces[::2], pieces[1::2]):
                change[part.low[i] + a] += 1
                change[part.low[i] + b] -= 1
    gone = np.cumsum(change[:-1]) > 0
    edge = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    columns: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")}
    for a, b in zip(part.starts[:-1], part.starts[1:]):
        # a run that reaches over the end of a document is one run in each
        inside = slice(np.searchsorted(end, a, "right"), np.searchsorted(begin, b, "left"))
        spans = [{"start": int(max(s, a) - a), "end": int(min(e, b) - a)} for s, e in zip(begin[inside], end[inside]) if min(e, b) > max(s, a)]
        kept = part.data[a:b][~gone[a:b]].tobytes() if spans else part.raw[a:b]
        columns["n_bytes"].append(int(b - a))
        columns["n_removed"].append(int(b - a) - len(kept))
        columns["n_spans"].append(len(spans))
        columns["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        columns["spans"].append(spans)
        columns["kept"].append(kept)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.binary()]
    return pa.record_batch([ids, *[pa.array(v, k) for v, k in zip(columns.values(), kinds)]], ["doc_id", *columns])


def repeat_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    return repeat_rows(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
