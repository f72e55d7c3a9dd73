"""Language-model scores from a subword lattice.

The pieces of an existing vocabulary, and all single bytes, span a lattice over every word: the word's
probability is the sum over all its segmentations, by a forward recursion in log space. The inventory of
pieces is taken as it is; its scores are the starting weights, which expectation-maximisation fits to the
words of the training documents. Three more kinds of edge span a whole word: what the training documents
count, what those of one language count (absolute discounting: each level leaves its discounted share to the
next, the lattice of pieces is the last), and what the document itself has said so far. The probability of
a text is the product over its words and its end, summed over the languages it may be in, so it is proper.

Documents are kept in blocks of some megabytes: token numbers and the block's distinct words. Counts and
word scores come back to a block by a join on words, one row for each word of a block, so neither the
vocabulary nor any document passes through the driver. Only the pieces' weights, of fixed number, do.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitwright.llm.text import arrow_map, bounded_batches, documents, remainder, space_words, texts_of
from splitwright.session import stored

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
HELD_OUT = (10, 0)
ROUNDS = 3
BLOCK_BYTES = 5_000_000
#: Lattices of so many words are worked on together.
WORDS_AT_ONCE = 40_000
#: Few words at once gain nothing from steps over all of them: up to so many are walked one by one.
WALKED = 8
#: Places of a walked word whose pieces are held at once.
WINDOW = 65_536
#: Stands for the mark of a word's begin, as one byte that no text has.
_MARK = b"\xff"
#: Code of the place after a word's last byte, and the number of codes.
STOP, WIDTH = 256, 257
#: Places of the words whose lattices are held together.
PLACES = 100_000
#: Natural log of the smallest probability that is calculated with as it is.
LEAST_LOG = -650.0
DISCOUNT = 0.6
#: Share of a word's probability that goes to the words before it, reached by half after so many of them.
CACHE, CACHE_HALF = 0.3, 100.0
#: Expected count that every piece has besides what is learned, so that no text is impossible.
FLOOR = 0.01


def load_pieces(path: str = PIECES) -> tuple[list[bytes], np.ndarray]:
    """Pieces that can occur in lower-cased text and all bytes, with starting weights from their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weights: dict[bytes, float] = {bytes([b]): 1e-4 for b in range(256)}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).encode().replace("▁".encode(), _MARK)
        if piece == piece.lower():
            weights[piece] = weights.get(piece, 0.0) + 1.0 / (10.0 - model.get_score(i))
    pieces = sorted(weights)
    return pieces, np.array([weights[p] for p in pieces])


class Lattice:
    """Segmentation lattices of many words at once.

    Pieces are found along a trie, so a substring that begins no piece is not looked at again. Node 0 is the
    root; as it is nobody's child it also stands for "no such node". Nodes with children have the smaller numbers.
    """

    def __init__(self, pieces: list[bytes], log_p: np.ndarray):
        self.log_p, self.p = log_p, np.exp(log_p)
        #: Words of so many bytes have no probability, of themselves or of a part, that a float cannot hold.
        self.plain = int(-LEAST_LOG / max(-log_p.min(), 1e-9))
        size = np.array([len(p) for p in pieces])
        self.longest = int(size.max())
        begin = np.cumsum(size) - size
        codes = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        node, known, edges = np.zeros(len(pieces), np.int64), 1, []
        for depth in range(self.longest):
            at = np.flatnonzero(size > depth)
            keys, new = np.unique(node[at] << 8 | codes[begin[at] + depth], return_inverse=True)
            node[at] = known + new
            edges.append((keys >> 8, keys & 255, known + np.arange(len(keys))))
            known += len(keys)
        parent, code, child = (np.concatenate(part) for part in zip(*edges))
        inner = np.zeros(known, bool)
        inner[parent] = True
        self.inner = int(inner.sum())
        number = np.empty(known, np.int64)
        number[inner], number[~inner] = np.arange(self.inner), np.arange(self.inner, known)
        self.child = np.zeros(self.inner * WIDTH, np.uint16 if known < 1 << 16 else np.int32)
        self.child[number[parent] * WIDTH + code] = number[child]
        self.piece = np.full(known, -1, np.int64)
        self.piece[number[node]] = np.arange(len(pieces))

    def _found(self, codes: np.ndarray, after: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(begins, ends, pieces)`` for each length of piece, of the pieces that begin at the places ``at``.

        ``after`` is the place that follows each place of ``codes``; a word's last place holds ``STOP``.
        """
        found = []
        node, cur = np.zeros(len(at), np.int64), at
        while len(at):
            node = self.child[node * WIDTH + codes[cur]]
            live = np.flatnonzero(node)
            at, cur, node = at[live], after[cur[live]], node[live].astype(np.int64)
            piece = self.piece[node]
            hit = np.flatnonzero(piece >= 0)
            found.append((at[hit], cur[hit], piece[hit]))
            deeper = np.flatnonzero(node < self.inner)
            at, cur, node = at[deeper], cur[deeper], node[deeper]
        return found

    def _window(self, codes: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``begin, end, piece`` of the pieces of one word that begin in a window, ordered by begin."""
        high = min(low + WINDOW, len(codes))
        part = np.append(codes[low : high + self.longest], STOP)
        found = self._found(part, np.arange(1, len(part) + 1), np.arange(high - low))
        begin, end, piece = (np.concatenate(part) for part in zip(*found))
        order = np.argsort(begin, kind="stable")
        return begin[order] + low, end[order] + low, piece[order]

    def _walk(self, codes: np.ndarray, backward: bool = False) -> np.ndarray:
        """Forward or backward log sums of one word, place by place; time in proportion to its length."""
        sums = [-math.inf] * (len(codes) + 1)
        sums[-1 if backward else 0] = 0.0
        starts = range(0, len(codes), WINDOW)
        for low in reversed(starts) if backward else starts:
            begin, end, piece = self._window(codes, low)
            if backward:
                begin, end, piece = end[::-1], begin[::-1], piece[::-1]
            for a, b, p in zip(begin.tolist(), end.tolist(), self.log_p[piece].tolist()):
                new, old = sums[a] + p, sums[b]
                if new > old:
                    new, old = old, new
                # old is the greater one
                sums[b] = old + math.log1p(math.exp(new - old)) if new > -math.inf else old
        return np.array(sums)

    def _uses(self, codes: np.ndarray, total: np.ndarray, count: float) -> None:
        """Add the expected uses of each piece in one word, ``count`` times."""
        alpha, beta = self._walk(codes), self._walk(codes, backward=True)
        for low in range(0, len(codes), WINDOW):
            begin, end, piece = self._window(codes, low)
            share = np.exp(alpha[begin] + self.log_p[piece] + beta[end] - alpha[-1]) * count
            total += np.bincount(piece, weights=share, minlength=len(total))

    def batches(self, words: list[bytes]):
        """Positions of words of similar length, the longest first, in parts of bounded size."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1  # with the mark
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        start = 0
        while start < len(order):
            part = sizes[start : start + max(1, PLACES // sizes[start])]
            # shorter words do not share the steps over the places of much longer ones
            end = start + int(np.searchsorted(-part, -(part[0] // 2), "right"))
            yield order[start : max(end, start + 1)]
            start = max(end, start + 1)

    def scores(self, words: list[bytes]) -> np.ndarray:
        """Natural log probability of each word over all its segmentations."""
        out = np.zeros(len(words))
        for at in self.batches(words):
            if len(at) <= WALKED:
                out[at] = [self._walk(_codes(words[i]))[-1] for i in at]
            else:
                grid = _Grid(self, [words[i] for i in at])
                out[at] = grid.logs(grid.forward()[grid.last])
        return out

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece in the words, each weighted by its count."""
        total = np.zeros(len(self.log_p))
        for at in self.batches(words):
            if len(at) <= WALKED:
                for i in at:
                    self._uses(_codes(words[i]), total, counts[i])
            else:
                _Grid(self, [words[i] for i in at]).uses(total, counts[at])
        return total


def _codes(word: bytes) -> np.ndarray:
    return np.frombuffer(_MARK + word, np.uint8).astype(np.int64)


class _Grid:
    """The lattices of words given from the longest to the shortest: first the begins of all, then their second places.

    Sums over segmentations are products of probabilities, or of their logs where the words are so long that
    a float could not hold them.
    """

    def __init__(self, lattice: Lattice, words: list[bytes]):
        size = np.fromiter(map(len, words), np.int64, len(words)) + 2  # with the mark and the place of the end
        self.places = int(size[0])
        #: So many words have a place; at a place, words stand in their order.
        self.n = len(words) - np.searchsorted(size[::-1], np.arange(self.places), "right")
        self.start = np.append(0, np.cumsum(self.n))
        word = np.repeat(np.arange(len(words)), size)
        first = np.cumsum(size) - size
        at = self.start[np.arange(len(word)) - first[word]] + word
        codes = np.empty(len(at), np.int64)
        codes[at] = np.frombuffer(b"".join(_MARK + w + b"\0" for w in words), np.uint8)
        self.last = at[first + size - 1]
        codes[self.last] = STOP
        after = np.arange(len(codes)) + np.repeat(self.n, self.n)
        self.edges = lattice._found(codes, after, np.arange(len(codes)))
        self.plain = self.places - 1 <= lattice.plain
        self.weight = [(lattice.p if self.plain else lattice.log_p)[piece] for _, _, piece in self.edges]
        # where the pieces of each length begin that begin at a place
        self.cuts = [np.searchsorted(begin, self.start) for begin, _, _ in self.edges]

    def _steps(self):
        """``begins, ends, weights`` of pieces of one length that end at one place, by that place."""
        for place in range(1, self.places):
            for length in range(1, min(place, len(self.edges)) + 1):
                cuts = self.cuts[length - 1]
                a, b = cuts[place - length], cuts[place - length + 1]
                if a < b:
                    begin, end, _ = self.edges[length - 1]
                    yield begin[a:b], end[a:b], self.weight[length - 1][a:b]

    def _sums(self, steps, known: np.ndarray | slice) -> np.ndarray:
        sums = np.full(self.start[-1], 0.0 if self.plain else -np.inf)
        sums[known] = 1.0 if self.plain else 0.0
        for source, target, weight in steps:
            # a place is at most once the target of one step
            if self.plain:
                sums[target] += sums[source] * weight
            else:
                sums[target] = np.logaddexp(sums[target], sums[source] + weight)
        return sums

    def forward(self) -> np.ndarray:
        return self._sums(self._steps(), slice(self.n[0]))

    def backward(self) -> np.ndarray:
        return self._sums(((end, begin, weight) for begin, end, weight in reversed(list(self._steps()))), self.last)

    def logs(self, sums: np.ndarray) -> np.ndarray:
        return np.log(sums) if self.plain else sums

    def uses(self, total: np.ndarray, counts: np.ndarray) -> None:
        """Add the expected uses of each piece in the words, each ``counts`` times."""
        alpha, beta = self.forward(), self.backward()
        whole = alpha[self.last]
        word = np.arange(len(alpha)) - np.repeat(self.start[:-1], self.n)
        for (begin, end, piece), weight in zip(self.edges, self.weight):
            of = word[begin]
            if self.plain:
                share = alpha[begin] * weight * beta[end] * (counts / whole)[of]
            else:
                share = np.exp(alpha[begin] + weight + beta[end] - whole[of]) * counts[of]
            total += np.bincount(piece, weights=share, minlength=len(total))


def token_blocks(docs: DataFrame, languages: list[str | None]) -> DataFrame:
    """Blocks of documents: ``doc_id, held, size`` arrays, and ``tokens`` numbering ``words``.

    ``place, n`` are the language of a word and its count there in training documents; ``more`` has the
    words' further languages.
    """
    modulus, out = HELD_OUT
    rows = _with_language(docs)
    rows = rows.withColumn("held", F.coalesce(remainder(F.col("doc_id"), modulus) == out, F.lit(False)))
    places = {language: i for i, language in enumerate(languages)}

    def run(batches):
        block = _Block(len(places))
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("doc_id", "held", "lang")]
            for doc, held, language, text in zip(*columns, texts_of(batch["text"])):
                block.add(doc, held, places.get(language, -1), text)
                if block.bytes >= BLOCK_BYTES:
                    yield block.row()
                    block = _Block(len(places))
            pa.default_memory_pool().release_unused()
        if block.ids:
            yield block.row()

    schema = "doc_id array<long>, held array<boolean>, size array<int>, tokens binary, words array<binary>, place array<int>, n array<long>, more array<struct<words:binary,place:int,n:long>>"
    bounded_batches(docs.sparkSession)
    found = rows.select("doc_id", "held", "lang", "text").mapInArrow(run, schema)
    return stored(found.withColumn("_block", F.monotonically_increasing_id()), "token-blocks")


def _with_language(docs: DataFrame) -> DataFrame:
    """A table without a ``lang`` column is in one, unknown language."""
    language = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return documents(docs.withColumn("_lang", language), "_lang").withColumnRenamed("_lang", "lang")


class _Block:
    def __init__(self, languages: int):
        self.ids, self.held, self.places, self.sizes, self.tokens, self.bytes = [], [], [], [], [], 0
        self.languages = languages
        self.numbers: defaultdict = defaultdict()
        self.numbers.default_factory = self.numbers.__len__

    def add(self, doc: int | None, held: bool, place: int, text: bytes) -> None:
        words = space_words(text)
        self.ids.append(doc)
        self.held.append(held)
        self.places.append(place)
        self.sizes.append(len(words))
        self.tokens.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.bytes += len(text)

    def row(self) -> pa.RecordBatch:
        tokens = np.concatenate(self.tokens)
        trained = np.repeat(~np.array(self.held), self.sizes)
        place = np.repeat(np.array(self.places), self.sizes)[trained]
        pairs, n = np.unique(tokens[trained].astype(np.int64) * self.languages + place, return_counts=True)
        word, place = pairs // self.languages, pairs % self.languages
        first = np.concatenate([[True], word[1:] != word[:-1]]) if len(word) else np.empty(0, bool)
        places, counts = np.zeros(len(self.numbers), np.int32), np.zeros(len(self.numbers), np.int64)
        places[word[first]], counts[word[first]] = place[first], n[first]
        words = list(self.numbers)
        more = [{"words": words[w], "place": int(p), "n": int(c)} for w, p, c in zip(word[~first], place[~first], n[~first])]
        columns = {
            "doc_id": pa.array([self.ids], pa.list_(pa.int64())),
            "held": pa.array([self.held], pa.list_(pa.bool_())),
            "size": pa.array([self.sizes], pa.list_(pa.int32())),
            "tokens": pa.array([packed(tokens)], pa.binary()),
            "words": pa.array([words], pa.list_(pa.binary())),
            "place": pa.ListArray.from_arrays(pa.array([0, len(places)], pa.int32()), pa.array(places)),
            "n": pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), pa.array(counts)),
            "more": pa.array([more], pa.list_(pa.struct([("words", pa.binary()), ("place", pa.int32()), ("n", pa.int64())]))),
        }
        return pa.record_batch(list(columns.values()), list(columns))


def packed(tokens: np.ndarray) -> bytes:
    """Token numbers, byte by byte of all of them, compressed: frequent words have small numbers."""
    return zstandard.ZstdCompressor(level=3).compress(tokens.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.int32).ravel()


def _weights(counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, float]:
    """Log probabilities of pieces that begin a word, of those that go on, and of a word's end."""
    begun = counts[first].sum()
    stop = begun / counts.sum()
    return np.where(first, np.log(counts / begun), np.log(counts / counts[~first].sum() * (1 - stop))), math.log(stop)


def fit_pieces(words: DataFrame, pieces: list[bytes], weights: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Natural log probabilities of the pieces and of a word's end, from the distinct training ``word``.

    Every word counts once: the pieces speak for the words that were not seen, which resemble the many
    that were seen once.
    """
    context = words.sparkSession.sparkContext
    first = np.array([p.startswith(_MARK) for p in pieces])
    log_p, log_stop = _weights(weights, first)
    for _ in range(rounds):
        held = context.broadcast((pieces, log_p))

        def work(held=held):
            lattice = Lattice(*held.value)

            def step(batch: pa.RecordBatch):
                found = lattice.expected(batch["word"].to_pylist(), np.ones(batch.num_rows))
                at = np.flatnonzero(found)
                yield pa.record_batch([pa.array(at, pa.int64()), pa.array(found[at], pa.float64())], ["piece", "uses"])

            return step

        # exact decimal sums do not depend on the order in which tasks end
        uses = F.sum(F.col("uses").cast("decimal(28,6)")).cast("double").alias("uses")
        table = arrow_map(words.select("word"), work, "piece long, uses double", WORDS_AT_ONCE).groupBy("piece").agg(uses).toArrow()
        counts = np.full(len(pieces), FLOOR)
        counts[table["piece"].to_numpy()] += table["uses"].to_numpy()
        log_p, log_stop = _weights(counts, first)
        held.unpersist()
    return log_p, log_stop


def language_scores(docs: DataFrame, pieces_path: str = PIECES, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document.

    Null and empty texts are the end alone. A null id is not held out and is learned from; repeated rows
    count each. Without training rows every count is 0 and the pieces keep their starting weights. A table
    may lack ``lang``; a null language counts as one of its own. Languages are taken to be few. Other
    columns are not read.
    """
    pieces, weights = load_pieces(pieces_path)
    modulus, out = HELD_OUT
    learned = _with_language(docs).where(F.coalesce(remainder(F.col("doc_id"), modulus), F.lit(1)) != out)
    per_language = {r["lang"]: r["n"] for r in learned.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(per_language, key=lambda x: (x is None, x or "")) or [None]
    blocks = token_blocks(docs, languages)
    # a word of a block is one row, with a row more for each further language it is learned in
    once = blocks.select(F.explode(F.arrays_zip("words", "place", "n")).alias("p"))
    seen = once.unionByName(blocks.select(F.explode("more").alias("p"))).select(F.col("p.words").alias("word"), "p.place", "p.n")
    sums = [F.sum(F.when(F.col("place") == i, F.col("n")).otherwise(0)).alias(f"c{i}") for i in range(len(languages))]
    words = seen.repartition("word").groupBy("word").agg(*sums)
    words = stored(words.select("word", F.array(*[f"c{i}" for i in range(len(languages))]).alias("c")), "words")
    total = F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x)
    sums = [f(F.get("c", i)).alias(f"{name}{i}") for i in range(len(languages)) for name, f in (("n", F.sum), ("v", lambda c: F.count_if(c > 0)))]
    counts = words.agg(F.sum(total).alias("n"), F.count_if(total > 0).alias("v"), *sums).first()
    ends = sum(per_language.values())
    known = words.where(total > 0)
    model = _Model(
        n=(counts["n"] or 0) + ends,
        v=counts["v"] + (ends > 0),
        ends=ends,
        n_words=counts["n"] or 0,
        v_words=counts["v"],
        languages=[(counts[f"n{i}"] or 0, counts[f"v{i}"], per_language.get(language, 0)) for i, language in enumerate(languages)],
    )
    if counts["v"]:
        log_p, log_stop = fit_pieces(known, pieces, weights, rounds)
    else:
        log_p, log_stop = _weights(weights, np.array([p.startswith(_MARK) for p in pieces]))
    held = docs.sparkSession.sparkContext.broadcast((pieces, log_p))

    def score_words():
        lattice = Lattice(*held.value)

        def step(batch: pa.RecordBatch):
            found = lattice.scores(batch["word"].to_pylist()) + log_stop
            counts = batch["c"].flatten().to_numpy(zero_copy_only=False).copy().reshape(batch.num_rows, -1)
            counts[(counts == 0).all(axis=1), 0] = -1  # a word that is not learned has one row too
            row, place = np.nonzero(counts)
            marks = (place.astype(np.int64) << 48) | np.maximum(counts[row, place], 0)
            yield pa.record_batch([batch["word"].take(pa.array(row)), pa.array(marks), pa.array(found.astype(np.float32)[row])], ["word", "c", "p"])

        return step

    scored = stored(arrow_map(words, score_words, "word binary, c long, p float", WORDS_AT_ONCE), "scored-words")
    asked = blocks.select("_block", F.posexplode("words").alias("at", "word"))
    # three lists of plain numbers, in the same order, are a third of a list of structs
    lists = [F.collect_list(c).alias(f"found_{c}") for c in ("at", "c", "p")]
    found = asked.join(scored.hint("merge"), "word").groupBy("_block").agg(*lists)
    joined = blocks.select("_block", "doc_id", "held", "size", "tokens").join(found.hint("merge"), "_block", "left")
    columns = ["doc_id", "held", "size", "tokens", "found_at", "found_c", "found_p"]

    def sums_of_blocks():
        def step(batch: pa.RecordBatch):
            for i in range(batch.num_rows):
                yield _block_scores({c: batch[c][i] for c in columns}, model)

        return step

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return arrow_map(joined.select(*columns), sums_of_blocks, schema)


@dataclass
class _Model:
    """Totals: tokens and types with and without the end, and ``(words, types, documents)`` by language."""

    n: int
    v: int
    ends: int
    n_words: int
    v_words: int
    languages: list[tuple[int, int, int]]

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.n + 0.1 * (self.v + 1)))

    def end(self) -> float:
        """Probability that a text ends, the same after every word."""
        return (self.ends + 0.5) / (self.n_words + self.ends + 1.0)

    def word_probabilities(self, counts: np.ndarray, log_lattice: np.ndarray) -> np.ndarray:
        """``[language, word]``, given that a word follows."""
        return np.exp(self.word_log_probabilities(counts, log_lattice))

    def word_log_probabilities(self, counts: np.ndarray, log_lattice: np.ndarray) -> np.ndarray:
        """Natural logs of ``word_probabilities``; those of long words are too small for a float."""
        log_p = _discounted(counts.sum(axis=1), self.n_words, self.v_words, log_lattice)
        return np.stack([_discounted(counts[:, i], n, v, log_p) for i, (n, v, _) in enumerate(self.languages)])


def _discounted(counts: np.ndarray, n: int, v: int, log_p: np.ndarray) -> np.ndarray:
    """Log of the discounted share of ``counts`` in ``n`` words of ``v`` types, the rest dealt out by ``log_p``."""
    if not n:
        return log_p
    out = math.log(DISCOUNT * v / n) + log_p
    seen = counts > 0
    out[seen] = np.logaddexp(np.log((counts[seen] - DISCOUNT) / n), out[seen])
    return out


def _block_scores(row: dict, model: _Model) -> pa.RecordBatch:
    sizes = row["size"].values.to_numpy().astype(np.int64)
    tokens = unpacked(row["tokens"].as_py())
    types = int(tokens.max(initial=-1)) + 1
    counts, log_lattice = np.zeros((types, len(model.languages)), np.int64), np.zeros(types)
    if types:
        at, marks, p = (row[f"found_{c}"].values.to_numpy() for c in ("at", "c", "p"))
        counts[at, marks >> 48] = marks & ((1 << 48) - 1)
        log_lattice[at] = p
    total = counts.sum(axis=1)
    log_p = model.word_log_probabilities(counts, log_lattice)
    p = np.exp(log_p)
    ends = np.cumsum(sizes)
    scores = np.empty(len(sizes))
    for a, b in _parts(ends):  # so many tokens at a time that their arrays stay small
        first = ends[a] - sizes[a]
        scores[a:b] = _log_probabilities(tokens[first : ends[b - 1]], sizes[a:b], model, p, log_p)
    columns = {
        "doc_id": row["doc_id"].values,
        "held_out": row["held"].values,
        "n_tokens": pa.array(sizes + 1),
        "n_known": pa.array(_by_document((total > 0).astype(np.int64)[tokens], sizes) + (model.ends > 0)),
        "train_tokens": pa.array(np.full(len(sizes), model.n, np.int64)),
        "base_score": pa.array(_by_document(model.base(total)[tokens], sizes) + float(model.base(np.array(model.ends)))),
        "score": pa.array(scores),
    }
    return pa.record_batch(list(columns.values()), list(columns))


def _parts(ends: np.ndarray, most: int = 200_000):
    """Ranges of documents of about ``most`` tokens."""
    a = 0
    while a < len(ends):
        begun = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, begun + most, "right")))
        yield a, b
        a = b


def _log_probabilities(tokens: np.ndarray, sizes: np.ndarray, model: _Model, p: np.ndarray, log_p: np.ndarray | None = None) -> np.ndarray:
    """log10 probability of each document, over the languages it may be in.

    ``log_p`` holds the logs of ``p`` where a ``p`` may be too small for a float.
    """
    log_p = np.log(p) if log_p is None else log_p
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    position = np.arange(len(tokens)) - begin
    # how often the document has used the word before
    order = np.argsort(begin.astype(np.int64) * (p.shape[1] + 1) + tokens, kind="stable")
    key = begin[order] * (p.shape[1] + 1) + tokens[order]
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.empty(0, bool)
    used = np.empty(len(tokens), np.int64)
    used[order] = np.arange(len(tokens)) - np.maximum.accumulate(np.where(new, np.arange(len(tokens)), 0))
    share = CACHE * position / (position + CACHE_HALF)
    cached = share * used / np.maximum(position, 1)
    again, rest = used > 0, np.log1p(-share)
    documents = sum(d for _, _, d in model.languages)
    each = []
    for place, (_, _, d) in enumerate(model.languages):
        prior = (d + 0.5) / (documents + 0.5 * len(model.languages))
        logs = rest + log_p[place][tokens]
        logs[again] = np.log((1 - share[again]) * p[place][tokens[again]] + cached[again])
        each.append(math.log(prior) + _by_document(logs, sizes))
    best = np.max(each, axis=0)
    total = best + np.log(np.exp(np.array(each) - best).sum(axis=0))
    return (total + sizes * math.log(1 - model.end()) + math.log(model.end())) / math.log(10)


def _by_document(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive values, ``sizes`` of them at a time."""
    out = np.zeros(len(sizes), values.dtype)
    full = sizes > 0
    if full.any():
        starts = (np.cumsum(sizes) - sizes)[full]
        out[full] = np.add.reduceat(values, starts)
    return out
