"""Personal data and the terms that give it away.

Patterns find the protected entities. Corpus co-occurrence then estimates how much a term says about an entity
of its document: with ``N`` documents, ``df`` counting documents, and ``co`` those that hold both, the pointwise mutual information ``log2(co * N / (df(entity) * df(term)))`` is set against the
information content ``log2(N / df(entity))``. A term that reaches ``REMOVE`` of that content is removed, one
that reaches ``GENERALISE`` is replaced by its category. Evidence must come from ``MIN_CONTEXTS``
different contexts, so that copies of one passage do not make every word in it a disclosure.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitwright.llm.text import alnum_words, arrow_map, bounded_batches, documents, row_key, texts_of
from splitwright.operators.profiles import probed_rows
from splitwright.session import stored

KINDS = ("email", "ip", "card", "phone")
#: All kinds by rank: the entities, then what the statistics add.
ALL_KINDS = (*KINDS, "generalise", "remove")
GENERALISE, REMOVE = 0.7, 0.85
MIN_CONTEXTS = 2
KEYS = ("doc_id", "_key1", "_key2")
#: Words that lie whole within so many code points of an entity, or of a word, are its context.
CONTEXT = 150
#: Bytes of text whose words are held at once.
PART_BYTES = 500_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# a match cannot begin inside a run of digits, so runs are tried once
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches; every one holds exactly one ``@`` right after its local part."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            end = match.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def entities(text: str) -> list[tuple[int, int, int, str]]:
    """``(start, kind rank, end, value)`` of all entities, in order."""
    found = [(s, 0, e, text[s:e].lower()) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                found.append((m.start(), 1, m.end(), m.group()))
        for m in _CARD.finditer(text):
            digits = _NO_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end(), digits))
        if "+" in text:
            for m in _PHONE.finditer(text):
                digits = _NO_DIGIT.sub("", m.group())
                if 9 <= len(digits) <= 15:
                    found.append((m.start(), 3, m.end(), digits))
    return sorted(found)


def _hash(value: bytes) -> int:
    return xxhash.xxh3_64_intdigest(value) - (1 << 63)


def context_terms(text: str, found: list[tuple[int, int, int, str]]) -> list[dict]:
    """Terms near each entity: entity and term hash, the context's hash, place, and whether it is the
    first of its pair in the document. Words that touch an entity are no terms."""
    out, pairs = [], set()
    for start, kind, end, value in found:
        entity = _hash(f"{ALL_KINDS[kind]}:{value}".encode())
        low, high = max(0, start - CONTEXT), min(len(text), end + CONTEXT)
        words = []
        for m in _WORD.finditer(text, low, high):
            a, b = m.span()
            whole = (a > low or low == 0 or not _WORD.match(text[low - 1])) and (b < high or high == len(text) or not _WORD.match(text[high]))
            if whole and not any(a < e and b > s for s, _, e, _ in found if s < high and e > low):
                words.append((a, b, alnum_words(m.group().encode())[0]))
        context = _hash(b" ".join(w for _, _, w in words))
        for a, b, word in words:
            term = _hash(word)
            out.append({"entity": entity, "term": term, "context": context, "start": a, "end": b, "first": int((entity, term) not in pairs)})
            pairs.add((entity, term))
    return out


def document_terms(text: str, found: list[tuple[int, int, int, str]]) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """``(term, context, places)`` of every distinct word that touches no entity.

    The context is the hash of the words within ``CONTEXT`` code points of the word's first place.
    """
    words, starts, ends, places, i = [], [], [], {}, 0
    reach = list(accumulate((e for _, _, e, _ in found), max))
    for m in _WORD.finditer(text):
        a, b = m.span()
        while i < len(found) and found[i][0] < b:
            i += 1
        if i and reach[i - 1] > a:
            continue
        word = alnum_words(m.group().encode())[0]
        words.append(word)
        starts.append(a)
        ends.append(b)
        places.setdefault(word, []).append((a, b))
    out = []
    for word, at in places.items():
        low, high = bisect_left(starts, at[0][0] - CONTEXT), bisect_right(ends, at[0][1] + CONTEXT)
        out.append((_hash(word), _hash(b" ".join(words[low:high])), at))
    return out


_FOUND = (
    "doc_id long, _key1 long, _key2 long, spans array<struct<start:int,kind:int,end:int>>, entities array<long>, "
    "terms array<struct<entity:long,term:long,context:long,start:int,end:int,first:int>>, "
    "words array<struct<term:long,context:long,places:array<int>>>"
)
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_TERM = pa.list_(
    pa.struct([("entity", pa.int64()), ("term", pa.int64()), ("context", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("first", pa.int32())])
)


class _Words:
    """``words`` of consecutive rows in flat arrays, as a row may have very many."""

    def __init__(self):
        self.ends, self.terms, self.contexts, self.stops, self.places = array("i", [0]), array("q"), array("q"), array("i", [0]), array("i")

    def add(self, words: list) -> None:
        for term, context, at in words:
            self.terms.append(term)
            self.contexts.append(context)
            for span in at:
                self.places.extend(span)
            self.stops.append(len(self.places))
        self.ends.append(len(self.terms))

    def lists(self) -> pa.Array:
        places = pa.ListArray.from_arrays(*(pa.array(np.frombuffer(x, np.int32)) for x in (self.stops, self.places)))
        hashes = [pa.array(np.frombuffer(x, np.int64)) for x in (self.terms, self.contexts)]
        items = pa.StructArray.from_arrays([*hashes, places], ["term", "context", "places"])
        return pa.ListArray.from_arrays(pa.array(np.frombuffer(self.ends, np.int32)), items)


def find_entities(docs: DataFrame) -> DataFrame:
    """Entities and their context terms of every document, and all words of those that hold an entity."""

    def work():
        def step(batch: pa.RecordBatch):
            # some texts at a time: the words of a text take several times its bytes
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            low = 0
            while low < batch.num_rows:
                begun = sizes[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(sizes, begun + PART_BYTES, "right")))
                yield part(batch.slice(low, high - low))
                pa.default_memory_pool().release_unused()
                low = high

        def part(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys = [batch[c] for c in KEYS]
            spans, names, terms, words = [], [], [], _Words()
            for x in batch["text"]:
                text = x.as_py()
                found = entities(text) if text else []
                spans.append([{"start": s, "kind": k, "end": e} for s, k, e, _ in found])
                names.append(list({_hash(f"{ALL_KINDS[k]}:{v}".encode()) for _, k, _, v in found}))
                terms.append(context_terms(text, found) if found else [])
                words.add(document_terms(text, found) if found else [])
            return pa.record_batch(
                [*keys, pa.array(spans, _SPAN), pa.array(names, pa.list_(pa.int64())), pa.array(terms, _TERM), words.lists()],
                [*KEYS, "spans", "entities", "terms", "words"],
            )

        return step

    rows = documents(docs)
    return arrow_map(rows.select("doc_id", *row_key(rows), "text"), work, _FOUND)


def document_frequencies(docs: DataFrame) -> DataFrame:
    """``term, df``: number of documents of every word of the corpus."""

    def work():
        def step(batch: pa.RecordBatch):
            seen: Counter = Counter()
            for text in texts_of(batch["text"]):
                seen.update(set(alnum_words(text)))
            yield pa.record_batch(
                [pa.array([_hash(w) for w in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], ["term", "df"]
            )

        return step

    return arrow_map(documents(docs).select("text"), work, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _known(found: DataFrame) -> DataFrame:
    """``entity, de, x1, x2``: number of documents of every entity, and two hashes of the set of these documents."""
    rows = found.select("_row", F.explode("entities").alias("entity"))
    marks = [F.bit_xor(F.xxhash64("_row")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "_row")).alias("x2")]
    return rows.groupBy("entity").agg(F.count(F.lit(1)).alias("de"), *marks)


def entity_classes(found: DataFrame) -> DataFrame:
    """``entity, class, de``: entities of the same documents, more than one, form a class, named by its smallest entity.

    They meet every term equally often, so a class stands for all its entities: a list of addresses that is
    copied is one class, however many there are.
    """
    known = stored(_known(found).where(F.col("de") > 1), "known-entities")
    heads = stored(known.groupBy("de", "x1", "x2").agg(F.min("entity").alias("class")), "entity-classes")
    return stored(known.join(heads, ["de", "x1", "x2"]).select("entity", "class", "de"), "class-members")


def held_terms(found: DataFrame, frequencies: DataFrame, classes: DataFrame, generalise: float = GENERALISE) -> DataFrame:
    """``_row, entity, term, context, de, df``: the terms of each document by each class of its entities.

    Entities and terms of one document only are left to ``context_terms``: such a pair has one context here. As ``co``
    is at most ``de``, a term can reach the share ``generalise`` only while
    ``df <= N ** (1 - generalise) * de ** generalise``; the others are left out before terms and entities meet.
    """
    n = float(max(1, found.count()))
    heads = classes.where(F.col("entity") == F.col("class")).select("entity", "de")
    most = heads.agg(F.max("de")).first()[0] or 1
    bound = lambda de: n ** (1 - generalise) * F.pow(de, F.lit(generalise)) * (1 + 1e-9)
    rare = stored(frequencies.where((F.col("df") > 1) & (F.col("df") <= bound(F.lit(float(most))))), "rare-terms")
    entities_of = found.select("_row", F.explode("entities").alias("entity")).join(heads, "entity")
    terms_of = found.select("_row", F.explode("words").alias("t")).select("_row", "t.term", "t.context").join(rare, "term")
    return terms_of.join(entities_of, "_row").where(F.col("df") <= bound(F.col("de")))


def disclosing_terms(
    found: DataFrame,
    frequencies: DataFrame,
    generalise: float = GENERALISE,
    remove: float = REMOVE,
    classes: DataFrame | None = None,
    held: DataFrame | None = None,
) -> DataFrame:
    """``entity, term, share, action``: pairs whose mutual information reaches a threshold.

    A class of entities is one row, under its name. ``classes`` and ``held`` are those of ``found``, if they are at hand.
    """
    n = F.lit(float(max(1, found.count())))
    if held is None:
        found = found if "_row" in found.columns else stored(found.withColumn("_row", F.monotonically_increasing_id()), "entities")
        classes = entity_classes(found)
        held = held_terms(found, frequencies, classes, generalise)
    near = found.select(F.explode("terms").alias("t")).select("t.*")
    near = near.groupBy("entity", "term").agg(F.sum("first").alias("co"), F.count_distinct("context").alias("contexts"))
    near = near.where(F.col("contexts") >= MIN_CONTEXTS).join(frequencies, "term").join(classes, "entity", "left")
    near = stored(near.withColumn("de", F.coalesce("de", F.lit(1))), "near-pairs")
    pairs = held.groupBy("entity", "term", "de", "df").agg(F.count(F.lit(1)).alias("co"), F.count_distinct("context").alias("contexts"))
    marked = near.where(F.col("class").isNotNull()).select(F.col("class").alias("entity"), "term", F.lit(True).alias("_near")).distinct()
    both = pairs.join(marked, ["entity", "term"], "left").where((F.col("contexts") >= MIN_CONTEXTS) | F.col("_near"))
    # an entity or a term of one document: the windows have counted all there is
    single = near.where((F.col("de") == 1) | (F.col("df") == 1))
    columns = ["entity", "term", "co", "de", "df"]
    joined = both.select(*columns).unionByName(single.select(*columns))
    content = F.log2(n / F.col("de"))
    share = F.log2(F.col("co") * n / (F.col("de") * F.col("df"))) / content
    scored = joined.where(content > 0).select("entity", "term", share.alias("share"))
    action = F.when(F.col("share") >= remove, F.lit(5)).otherwise(F.lit(4))
    return scored.where(F.col("share") >= generalise).withColumn("action", action)


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    text = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
    return F.array_join(text, ",")


def personal_spans(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``doc_id, _key1, _key2, base, spans``: entity spans, and those with the disclosing terms, as sorted arrays.

    The keys are the ``row_key`` of the document; rows that share them have the same spans.

    Null and empty texts have none. Each row counts as a document, repeated rows too. An entity in every
    document carries no information and discloses nothing. Other columns are not read.
    """
    found = stored(find_entities(docs).withColumn("_row", F.monotonically_increasing_id()), "entities")
    frequencies = stored(document_frequencies(docs), "frequencies")
    classes = entity_classes(found)
    held = stored(held_terms(found, frequencies, classes, generalise), "held-terms")
    pairs = stored(disclosing_terms(found, frequencies, generalise, remove, classes, held), "disclosing")
    near = found.select("_row", F.explode("terms").alias("t")).select("_row", "t.entity", "t.term")
    hit = held.select("_row", "entity", "term").unionByName(near).join(pairs, ["entity", "term"]).groupBy("_row", "term").agg(F.max("action").alias("action"))
    added = hit.groupBy("_row").agg(F.collect_list(F.struct("term", "action")).alias("_added"))
    added = stored(added.withColumnRenamed("_row", "id"), "added-terms")
    # words travel for documents that something is added to; a sketch of their rows holds back the others
    words = probed_rows(found.select(F.col("_row").alias("id"), "words"), "id", added, "id").join(added, "id")
    joined = found.select("_row", *KEYS, "spans").join(words.withColumnRenamed("id", "_row"), "_row", "left")
    joined = joined.select(*KEYS, "spans", "words", "_added")

    def work():
        def step(batch: pa.RecordBatch):
            spans = []
            for i, own in enumerate(batch["spans"].to_pylist()):
                if batch["_added"][i].is_valid:
                    action = {x["term"]: x["action"] for x in batch["_added"][i].as_py()}
                    words = batch["words"][i].values
                    terms, places = words.field("term").to_numpy(), words.field("places")
                    for k in np.flatnonzero(np.isin(terms, list(action))):
                        at = places[int(k)].as_py()
                        own += [{"start": s, "kind": action[int(terms[k])], "end": e} for s, e in zip(at[::2], at[1::2])]
                    own.sort(key=lambda x: (x["start"], x["kind"], x["end"]))
                spans.append(own)
            keys = [batch[c] for c in KEYS]
            yield pa.record_batch([*keys, batch["spans"], pa.array(spans, _SPAN)], [*KEYS, "base", "spans"])

        return step

    kind = "array<struct<start:int,kind:int,end:int>>"
    return arrow_map(joined, work, f"doc_id long, _key1 long, _key2 long, base {kind}, spans {kind}")


def pii_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``."""
    found = personal_spans(docs)
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def term_category(term: str) -> str:
    """What kind of word a term is: ``number``, ``code`` (letters and digits), ``name`` (with a capital) or ``word``."""
    if any(c.isdigit() for c in term):
        return "code" if any(c.isalpha() for c in term) else "number"
    return "name" if term[:1].isupper() else "word"


def sanitised(text: str, spans: list[tuple[int, str, int]], category: Callable[[str], str] = lambda term: "term") -> str:
    """The text with entities and generalised terms replaced by ``[kind]`` or ``[category]`` and removed terms cut.

    ``spans`` holds ``(start, kind, end)``; where spans overlap, the one that starts first covers the rest.
    """
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if end <= at:
            continue
        if start >= at:
            shown = category(text[start:end]) if kind == "generalise" else kind
            out += [text[at:start], "" if kind == "remove" else f"[{shown}]"]
        at = end
    return "".join([*out, text[at:]])


def sanitised_texts(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """All rows and columns of ``docs`` with sanitised texts; a generalised term becomes its ``term_category``.

    Null stays null and empty stays empty. Repeated rows count as documents of their own and all stay. Rows without
    spans do not pass through Python. Columns may have any name.
    """
    found = personal_spans(docs, generalise, remove).where(F.size("spans") > 0)
    found = stored(found.select("_key1", "_key2", _written(F.col("spans")).alias("_spans")).dropDuplicates(["_key1", "_key2"]), "text-spans")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *row_key(docs))
    joined = whole.join(found, ["_key1", "_key2"], "left")
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(text: str | None, written: str | None) -> str | None:
            if not text or not written:
                return text
            parts = (x.split(":") for x in written.split(","))
            return sanitised(text, [(int(start), kind, int(end)) for kind, start, end in parts], term_category)

        return pd.Series([one(t, x) for t, x in zip(texts, spans, strict=True)], dtype=object)

    def columns(text: Column) -> list[Column]:
        return [(text if c == "text" else F.col("_doc")[c]).alias(c) for c in docs.columns]

    hit = F.col("_spans").isNotNull()
    touched = joined.where(hit).select(*columns(clean(F.col("_doc.text"), F.col("_spans"))))
    return touched.unionByName(joined.where(~hit).select(*columns(F.col("_doc.text"))))
