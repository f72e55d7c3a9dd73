"""Exact deduplication by content-defined chunk recipes, with DataFrame functions only.

A normalised text is cut after places that its own UTF-8 bytes choose, whatever the script, so texts that
share a passage share its chunks. Each distinct chunk crosses the network once per task that holds it, to be verified: a chunk
identifier is the hash of the chunk, with a variant number where different chunks share a hash. Documents
are then compared by their ordered identifier lists, which are about a hundredth of the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitwright.llm.text import SPACES, documents, row_key
from splitwright.session import stored



def _bytes(rest: int, more: str = "") -> str:
    """Class of the bytes below 0xC0 that leave ``rest`` modulo 4."""
    return "[" + "".join(f"\\x{b:02X}" for b in range(rest, 0xC0, 4)) + more + "]"


#: A chunk has at least 256 bytes and ends with four bytes of two alternating classes, or after 4096. The first
#: class takes all bytes that begin a character outside ASCII, so both letters of a two-byte script are looked at.
LEAST, MOST = 256, 4096
_EDGE = (_bytes(1, r"\xC0-\xFF") + _bytes(0)) * 2
CHUNK = f"(?s).{{{LEAST - 4},{MOST - 4}}}?{_EDGE}|.{{1,{MOST}}}"


def normalised(text: Column) -> Column:
    """White space runs as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES + "+", " ")


def chunked(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` as ``doc_id, _key1, _key2, _text, _chunks``; chunks spell bytes as characters below 256."""
    rows = documents(docs)
    rows = rows.select("doc_id", *row_key(rows), normalised(F.col("text")).alias("_text"))
    # one character a byte, so that the pattern's classes are sets of bytes
    octets = F.decode(F.col("_text").cast("binary"), "ISO-8859-1")
    return rows.withColumn("_chunks", F.regexp_extract_all(octets, F.lit(CHUNK), 0))


def chunk_variants(chunks: DataFrame) -> DataFrame:
    """``hash, chunk, variant`` of the chunks whose hash another chunk has too.

    Equal chunks meet before the exchange, so a chunk that stands in every document arrives once per task.
    """
    distinct = chunks.select(F.explode("_chunks").alias("chunk")).select(F.xxhash64("chunk").alias("hash"), "chunk").distinct()
    shared = distinct.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.collect_list("chunk").alias("all"))
    variants = shared.where(F.col("n") > 1).select("hash", F.posexplode(F.array_sort("all")).alias("variant", "chunk"))
    return variants.where(F.col("variant") > 0)


def recipes(docs: DataFrame) -> DataFrame:
    """``doc_id, _key1, _key2, text_sha256, recipe, _row``: verified chunk identifiers in order.

    An identifier is ``hash`` or, for the second and later chunks that share it, a hash with the variant.
    """
    cut = chunked(docs)
    variants = stored(chunk_variants(cut), "chunk-variants")
    rows = cut.select(
        "doc_id", "_key1", "_key2", F.sha2("_text", 256).alias("text_sha256"), F.transform("_chunks", lambda c: F.xxhash64(c)).alias("recipe")
    )
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "recipes")
    if variants.isEmpty():
        return rows
    named = cut.select("_key1", "_key2", F.posexplode("_chunks").alias("at", "chunk")).withColumn("hash", F.xxhash64("chunk"))
    named = named.join(variants, ["hash", "chunk"]).select("_key1", "_key2", "at", F.xxhash64("hash", F.col("variant")).alias("id"))
    changes = named.distinct().groupBy("_key1", "_key2").agg(F.map_from_entries(F.collect_list(F.struct("at", "id"))).alias("_ids"))
    joined = rows.join(stored(changes, "recipe-changes"), ["_key1", "_key2"], "left")
    verified = F.transform("recipe", lambda h, i: F.coalesce(F.element_at("_ids", i), h))
    return joined.withColumn("recipe", F.when(F.col("_ids").isNull(), F.col("recipe")).otherwise(verified)).drop("_ids")


def copies(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, _key1, _key2`` of every document.

    Of equal texts the smallest ``doc_id`` stays; a null id stays only where no row has one, and of rows
    that repeat an id one stays. Null counts as empty text, all empty texts are equal. Other columns are
    not read.
    """
    rows = recipes(docs)
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    groups = rows.groupBy("recipe").agg(F.min(first).alias("_first"), F.count(F.lit(1)).alias("group_size"))
    # written, so that a group with a third of all rows can be split in the join
    joined = rows.join(stored(groups, "recipe-groups"), "recipe")
    return joined.select(
        "doc_id",
        F.col("_first.id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_first.row")).alias("kept"),
        "text_sha256",
        "_key1",
        "_key2",
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """:func:`copies` without the row keys."""
    return copies(docs).drop("_key1", "_key2")


def without_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with all its columns."""
    kept = copies(docs).where("kept").select("_key1", "_key2")
    return keep_rows(docs, kept)


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``row_key`` is in ``kept``, repeated rows once, with all columns."""
    plain = documents(docs.withColumn("_row", F.struct("*")), "_row")
    keyed = plain.select(*row_key(plain), "_row")
    return keyed.join(stored(kept, "kept-rows"), ["_key1", "_key2"], "left_semi").dropDuplicates(["_key1", "_key2"]).select("_row.*")


SQL = """
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as t from documents),
g as (select t, min(doc_id) as keep_id, count(*) as group_size from n group by t)
select n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id as kept, sha256(n.t) as text_sha256 from n join g on n.t = g.t
"""
