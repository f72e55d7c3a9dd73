"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every word sequence of the items. A document streams through it word by word; the
longest match that ends at each word tells which windows of an item end there. Items are packed into
blocks of at most ``BLOCK_WORDS`` words, so an automaton has a fixed largest size (two states a word) and
may be broadcast; a benchmark of more words takes one pass over the documents per block. No document
is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitwright.llm.text import alnum_words, arrow_map, documents, texts_of, with_column
from splitwright.operators.checks import require_columns
from splitwright.session import stored

WINDOW = 10
#: Words of items in one automaton; a single longer item still gets one of its own.
BLOCK_WORDS = 50_000


class SuffixAutomaton:
    """Automaton of all substrings of the items, over word numbers.

    ``windows[state]`` lists ``(length, item ids)`` of the windows whose longest context is that state;
    an item shorter than the window is one window of its own length.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.longest, self.link, self.edges = [0], [-1], [{}]
        numbered = []
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            numbered.append((item, ids))
            last = 0
            for w in ids:
                last = self._extend(last, w)
        self.windows: dict[int, dict[int, set[str]]] = {}
        for item, ids in numbered:
            size = min(window, len(ids))
            state = 0
            for i, w in enumerate(ids):
                state = self.edges[state][w]
                if size and i + 1 >= size:
                    home = state
                    while self.longest[self.link[home]] >= size:
                        home = self.link[home]
                    self.windows.setdefault(home, {}).setdefault(size, set()).add(item)
        self._endings: dict[int, list[tuple[int, frozenset[str]]]] = {}

    def _state(self, longest: int, link: int, edges: dict[int, int]) -> int:
        self.longest.append(longest)
        self.link.append(link)
        self.edges.append(edges)
        return len(self.longest) - 1

    def _split(self, parent: int, word: int, child: int) -> int:
        """A state for the shorter suffixes of ``child``, those up to ``parent`` plus ``word``."""
        shorter = self._state(self.longest[parent] + 1, self.link[child], dict(self.edges[child]))
        self.link[child] = shorter
        while parent >= 0 and self.edges[parent].get(word) == child:
            self.edges[parent][word] = shorter
            parent = self.link[parent]
        return shorter

    def _extend(self, last: int, word: int) -> int:
        known = self.edges[last].get(word)
        if known is not None:  # another item has this prefix already
            return known if self.longest[known] == self.longest[last] + 1 else self._split(last, word, known)
        new = self._state(self.longest[last] + 1, 0, {})
        at = last
        while at >= 0 and word not in self.edges[at]:
            self.edges[at][word] = new
            at = self.link[at]
        if at >= 0:
            child = self.edges[at][word]
            self.link[new] = child if self.longest[child] == self.longest[at] + 1 else self._split(at, word, child)
        return new

    def endings(self, state: int) -> list[tuple[int, frozenset[str]]]:
        """Windows that end where ``state`` is reached, longest first."""
        found = self._endings.get(state)
        if found is None:
            at, found = state, []
            while at > 0:
                own = self.windows.get(at, {})
                found += [(size, frozenset(own[size])) for size in sorted(own, reverse=True)]
                at = self.link[at]
            self._endings[state] = found
        return found

    def hits(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged hit ranges ``[start, end)`` of word positions, and the items with occurring windows."""
        number, edges, link, longest = self.vocabulary.get, self.edges, self.link, self.longest
        state = size = 0
        spans: list[list[int]] = []
        items: set[str] = set()
        for i, word in enumerate(words):
            w = number(word)
            if w is None:
                state = size = 0
                continue
            after = edges[state].get(w)
            if after is None:
                while after is None:
                    state = link[state]
                    after = edges[state].get(w)
                size = longest[state]
            state = after
            size += 1
            for length, ids in self._endings[state] if state in self._endings else self.endings(state):
                if length <= size:
                    items |= ids
                    start = i + 1 - length
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append([start, i + 1])
        return spans, items


def merged(spans: list[list[int]]) -> list[list[int]]:
    """Union of ranges, touching ones joined."""
    out: list[list[int]] = []
    for start, end in sorted(map(list, spans)):
        if out and out[-1][1] >= start:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in blocks of a bounded number of words; the driver holds one partition and one block."""
    require_columns(benchmark, ["item_id", "text"], "benchmark")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").cast("string").alias("t"))
    block: list[tuple[str, list[bytes]]] = []
    size = 0
    for row in items.where(F.col("t").isNotNull()).toLocalIterator():
        words = alnum_words(row["t"].encode())
        if words:
            if block and size + len(words) > block_words:
                yield block
                block, size = [], 0
            block.append((row["i"], words))
            size += len(words)
    yield block


def _match(df: DataFrame, items: list[tuple[str, list[bytes]]], window: int) -> DataFrame:
    """``df`` with the ranges and items of one more block in ``_spans`` and ``_items``."""
    held = df.sparkSession.sparkContext.broadcast(items)

    def work():
        automaton = SuffixAutomaton(held.value, window)

        def step(batch: pa.RecordBatch):
            rows = zip(texts_of(batch["text"]), batch["_spans"].to_pylist(), batch["_items"].to_pylist())
            counts, spans, ids = [], [], []
            for text, before, known in rows:
                words = alnum_words(text)
                found, named = automaton.hits(words)
                counts.append(len(words))
                spans.append(merged(before + found) if before else found)
                ids.append(sorted(named.union(known)))
            yield with_column(
                batch,
                _words=pa.array(counts, pa.int64()),
                _spans=pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                _items=pa.array(ids, pa.list_(pa.string())),
            )

        return step

    return arrow_map(df, work, df.schema)


def matched(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows with a string ``text``, plus ``_words``, ``_spans`` (merged ranges of hit words) and ``_items``."""
    out = docs.withColumns(
        {
            "_words": F.lit(0).cast("long"),
            "_spans": F.array().cast("array<array<bigint>>"),
            "_items": F.array().cast("array<string>"),
        }
    )
    for n, items in enumerate(item_blocks(benchmark, block_words)):
        out = _match(stored(out, "matched") if n else out, items, window)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_hit`` of every document.

    Null and empty texts have no words and no hits. Null, empty and repeated items add no window of
    their own; rows that repeat an ``item_id`` count as one item, a null id is the empty text. Repeated
    documents each get a row. An empty benchmark leaves everything clean; other columns are not read.
    """
    found = matched(documents(docs), benchmark, window, block_words)
    widths = F.transform("_spans", lambda s: s[1] - s[0])
    hit = F.aggregate(widths, F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id",
        F.col("_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        F.coalesce(F.array_max(widths), F.lit(0)).cast("long").alias("longest_hit"),
    )


def cut_words(text: str, spans: list[list[int]]) -> str:
    """The text without the alphanumeric words of the ranges and what stands between them."""
    raw = text.encode()
    plain = raw.translate(_MARKS)
    at, starts, ends = 0, [], []
    for word in plain.split():
        at = plain.index(word, at)
        starts.append(at)
        at += len(word)
        ends.append(at)
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : starts[a]])
        last = ends[b - 1]
    return b"".join([*out, raw[last:]]).decode()


_MARKS = bytes(c if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def decontaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    max_length: int = 0,
    max_coverage: float = 0.5,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Documents without benchmark passages, all columns kept.

    Hit ranges of more than ``max_length`` words are cut from the text (``n_chars``, if there is such a
    column, is counted anew). A document of which more than ``max_coverage`` of the words is hit goes as
    a whole. Clean rows pass unchanged, null texts included. A range is cut once; words around it are not
    judged again.
    """
    others = [c for c in docs.columns if c != "text"]
    row = docs.select(F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"))
    found = matched(row, benchmark, window, block_words)
    widths = F.aggregate(F.transform("_spans", lambda s: s[1] - s[0]), F.lit(0).cast("long"), lambda a, x: a + x)
    found = found.where((widths == 0) | (widths <= F.col("_words") * F.lit(max_coverage)))

    def work():
        def step(batch: pa.RecordBatch):
            texts = []
            for text, spans in zip(batch["text"].to_pylist(), batch["_spans"].to_pylist()):
                spans = [s for s in spans if s[1] - s[0] > max_length]
                texts.append(cut_words(text, spans) if spans else text)
            yield with_column(batch, text=pa.array(texts, pa.string()))

        return step

    cut = arrow_map(found, work, found.schema)
    columns = []
    for field in docs.schema.fields:
        column = F.col("text") if field.name == "text" else F.col("_row").getField(field.name)
        if field.name == "n_chars":
            column = F.when(F.size("_spans") > 0, F.length("text")).otherwise(column)
        columns.append(column.cast(field.dataType).alias(field.name))
    return cut.select(*columns)



SQL = f"""
with dw as (
  select d.doc_id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')) as w,
    generate_subscripts(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')) as pos
  from documents d),
iw as (
  select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') as ws
  from benchmark),
win as (
  select distinct item_id, least(len(ws), {WINDOW}) as size, array_to_string(ws[s:s + least(len(ws), {WINDOW}) - 1], ' ') as gram
  from (select item_id, ws, unnest(range(1, greatest(len(ws) - {WINDOW} + 1, 1) + 1)) as s from iw where len(ws) > 0)),
sizes as (select distinct size from win),
grams as (
  select doc_id, pos, size, list(w) over (partition by doc_id, size order by pos rows between current row and {WINDOW - 1} following)[1:size] as ws
  from dw cross join sizes),
met as (
  select g.doc_id, g.pos, g.size, win.item_id from grams g join win on win.size = g.size and len(g.ws) = g.size and array_to_string(g.ws, ' ') = win.gram),
covered as (select distinct doc_id, pos + k as pos from (select distinct doc_id, pos, unnest(range(size)) as k from met)),
hit as (select doc_id, count(*) as n_hit from covered group by doc_id),
named as (select doc_id, count(*) as n_items, sha256(string_agg(item_id, ',' order by item_id)) as items_sha256
  from (select distinct doc_id, cast(item_id as varchar) as item_id from met) group by doc_id),
total as (select doc_id, count(*) as n_words from dw group by doc_id),
runs as (select doc_id, max(n) as longest_hit from (
  select doc_id, grp, count(*) as n from (select doc_id, pos - row_number() over (partition by doc_id order by pos) as grp from covered) group by doc_id, grp) group by doc_id)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(longest_hit, 0)::bigint as longest_hit
from documents d left join total using (doc_id) left join hit using (doc_id) left join named using (doc_id) left join runs using (doc_id)
"""
