"""Line deduplication over levelled, sorted runs of line hashes.

Documents are dealt into batches by a hash of the row, whatever their source. A batch is reduced to one ``(line, n)`` row per line hash, ``n`` counting its
documents; hashes that are settled already (seen in enough documents) are taken out by a merge anti-join,
the rest become a new sorted run on level 0. A level with ``FANOUT`` runs is compacted into one run on the
next level: counts are added, and hashes that have reached the limit move to the settled run. So each hash
is rewritten once per level, a logarithm of the number of batches. Runs are tables in the shared folder.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitwright.llm.text import arrow_map, documents, row_key, texts_of, with_column
from splitwright.session import stored

MIN_DOCUMENTS = 10
FANOUT = 2
BATCHES = 4
_SPACES = b" \t\n\x0b\x0c\r"


def line_keys(text: bytes) -> list[bytes]:
    """Key of each line: outer white space stripped, A-Z lower-cased."""
    return [line.strip(_SPACES).lower() for line in text.split(b"\n")]


def line_counts(docs: DataFrame) -> DataFrame:
    """``line, n``: 128-bit hash of each key that is not empty, and its number of documents (rows)."""

    def work():
        def step(batch: pa.RecordBatch):
            seen: Counter = Counter()
            for text in texts_of(batch["text"]):
                seen.update(set(line_keys(text)))
            seen.pop(b"", None)
            lines = [xxhash.xxh3_128_digest(k) for k in seen]
            yield pa.record_batch([pa.array(lines, pa.binary()), pa.array(list(seen.values()), pa.int64())], ["line", "n"])

        return step

    return arrow_map(docs.select("text"), work, "line binary, n long").groupBy("line").agg(F.sum("n").alias("n"))


class LineRuns:
    """The runs of all batches so far."""

    def __init__(self, spark: SparkSession, min_documents: int = MIN_DOCUMENTS, fanout: int = FANOUT):
        self.spark, self.min_documents, self.fanout = spark, min_documents, fanout
        self.levels: list[list[DataFrame]] = []
        self.settled: list[DataFrame] = []

    def add(self, docs: DataFrame) -> None:
        """Count a batch of documents and keep what is not settled as a new run."""
        counts = line_counts(docs)
        if self.settled:
            known = reduce(DataFrame.unionByName, self.settled)
            counts = counts.join(known.hint("merge"), "line", "left_anti")
        self._push(0, counts)

    def _push(self, level: int, counts: DataFrame) -> None:
        run = stored(counts.sortWithinPartitions("line"), f"line-run-{level}")
        if level:
            self.settled.append(run.where(F.col("n") >= self.min_documents).select("line"))
            run = run.where(F.col("n") < self.min_documents)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._push(level + 1, self._summed(runs))

    def _summed(self, runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, runs).groupBy("line").agg(F.sum("n").alias("n"))

    def frequent(self) -> DataFrame:
        """``line`` of every hash that at least ``min_documents`` documents contain."""
        rest = [run for level in self.levels for run in level]
        found = list(self.settled)
        if rest:
            found.append(self._summed(rest).where(F.col("n") >= self.min_documents).select("line"))
        if not found:
            return self.spark.createDataFrame([], "line binary")
        return reduce(DataFrame.unionByName, found).distinct()


def dealt(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``doc_id, text, _batch``: the rows of ``docs`` as they are given, written once, dealt by a hash of id and text."""
    rows = documents(docs)
    return stored(rows.withColumn("_batch", F.pmod(row_key(rows)[0], F.lit(batches))), "line-documents")


def file_batches(docs: DataFrame, batches: int = BATCHES) -> list[DataFrame]:
    """The rows of ``docs`` in batches."""
    return _batches_of(dealt(docs, batches), batches)


def _batches_of(rows: DataFrame, batches: int) -> list[DataFrame]:
    return [rows.where(F.col("_batch") == i).drop("_batch") for i in range(batches)]


def drop_lines(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped``: documents without the lines whose hashes are in ``frequent``."""

    def explode():
        def step(batch: pa.RecordBatch):
            first, second, lines = [], [], []
            for text, a, b in zip(texts_of(batch["text"]), batch["_key1"].to_pylist(), batch["_key2"].to_pylist()):
                own = set(line_keys(text)) - {b""}
                first += [a] * len(own)
                second += [b] * len(own)
                lines += map(xxhash.xxh3_128_digest, own)
            yield pa.record_batch([pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(lines, pa.binary())], ["_key1", "_key2", "line"])

        return step

    def rewrite():
        def step(batch: pa.RecordBatch):
            texts, counts, dropped = [], [], []
            for text, gone in zip(batch["text"].to_pylist(), batch["_gone"].to_pylist()):
                raw = (text or "").encode()
                counts.append(raw.count(b"\n") + 1)
                if not gone:
                    texts.append(text)
                    dropped.append(0)
                    continue
                gone = set(gone)
                kept = [
                    line
                    for line, key in zip(raw.split(b"\n"), line_keys(raw))
                    if not key or xxhash.xxh3_128_digest(key) not in gone
                ]
                texts.append(b"\n".join(kept).decode())
                dropped.append(counts[-1] - len(kept))
            yield with_column(
                batch.select(["doc_id"]),
                text=pa.array(texts, pa.string()),
                n_lines=pa.array(counts, pa.int64()),
                n_dropped=pa.array(dropped, pa.int64()),
            )

        return step

    rows = documents(docs)
    keyed = rows.select("doc_id", "text", *row_key(rows))
    lines = arrow_map(keyed.select("text", "_key1", "_key2"), explode, "_key1 long, _key2 long, line binary")
    gone = lines.join(stored(frequent, "frequent-lines"), "line").groupBy("_key1", "_key2").agg(F.collect_set("line").alias("_gone"))
    joined = keyed.join(stored(gone, "dropped-lines"), ["_key1", "_key2"], "left").select("doc_id", "text", "_gone")
    return arrow_map(joined, rewrite, "doc_id long, text string, n_lines long, n_dropped long")


def deduplicated_lines(docs: DataFrame, batches: int = BATCHES, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped`` of every document.

    A line whose key stands in at least ``min_documents`` documents goes everywhere. A line counts once
    per document; each row is a document, repeated rows too. Empty lines stay. A null text is one empty
    line and stays null; an empty table gives an empty one. Other columns are not read.
    """
    runs = LineRuns(docs.sparkSession, min_documents)
    rows = dealt(docs, batches)
    for batch in _batches_of(rows, batches):
        runs.add(batch)
    return drop_lines(rows, runs.frequent())


def line_digest(docs: DataFrame, batches: int = BATCHES, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256``."""
    kept = deduplicated_lines(docs, batches, min_documents)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = f"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
k as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key from k where key <> '' group by key having count(distinct doc_id) >= {MIN_DOCUMENTS})
select doc_id, count(*) as n_lines, count(f.key) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where f.key is null), '')) as kept_sha256
from k left join f on k.key = f.key group by doc_id
"""
