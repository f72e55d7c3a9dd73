"""Mixing sources to target weights, with DataFrame functions only.

Documents are cut into blocks of ``BLOCK`` words. The target of a source fixes how many blocks it gives:
every block once for each full pass and, of a last pass, the first blocks of a random order. These exact
quotas are split among the output shards by a binary tree: each node deals half of its blocks to the left
by a multivariate hypergeometric draw over the sources, so a shard holds what a random deal would give it.
Each shard then takes its own range of each source's random order, disjoint from all others, and orders
its blocks by a hash. Only block rows move, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitwright.llm.text import SPACES, documents
from splitwright.session import stored

BLOCK = 64
SHARDS_LOG2 = 4
SEED = 17
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Blocks of a source in one sorted bin, on average.
BIN = 4096
_WORD = "[^" + SPACES[1:] + "+"


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, _mark, _row``: words and hash of each document, written once."""
    rows = documents(docs, "source")
    size = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long")
    source = F.col("source").cast("string").alias("source")
    return stored(rows.select("doc_id", source, size.alias("size"), F.xxhash64("text").alias("_mark"), F.monotonically_increasing_id().alias("_row")), "sizes")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size, blocks, target, passes, need`` of each source.

    Sources by code point, null last, take the weights in turn. ``share`` times all words is shared by
    weight; a target stops at ``most`` times its source and the excess goes to the others by weight until
    none is above. ``passes`` full passes and ``need`` words of one more make up the target. The table has
    one row a source, so its windows stay small whatever the input.
    """
    blocks = F.ceil(F.col("size") / BLOCK)
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(blocks).alias("blocks"))
    everything = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("source").isNull(), "source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place - 1, F.lit(len(weights))) + 1)
    rows = totals.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    before = Window.partitionBy(F.lit(1)).orderBy(F.col("_cap") / F.col("_weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    left = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    rows = rows.withColumn("_level", (F.sum("source_size").over(everything) * F.lit(share) - spent) / left)
    # sources stand by how soon they are full; the level of the first that is not holds for all after it
    open_level = F.min(F.when(F.col("_cap") / F.col("_weight") > F.col("_level"), F.struct(F.col("_cap") / F.col("_weight"), "_level"))).over(everything)
    target = F.least("_cap", F.coalesce(open_level["_level"] * F.col("_weight"), F.col("_cap")))
    rows = rows.select("source", "source_size", "blocks", target.alias("target"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return rows.withColumn("passes", passes).withColumn("need", F.col("target") - F.col("passes") * F.col("source_size"))


def permuted(sizes: DataFrame, sources: DataFrame, seed: int = SEED) -> DataFrame:
    """Every block with its 0-based ``rank`` in the random order of its source and the words up to it.

    The order is that of a hash of seed, id (of the text where the id is null) and block; rows that repeat
    an id follow by their texts. Rows equal in id, source and text are interchangeable. The hash's leading bits deal the blocks of a source over bins of about ``BIN``
    rows, which are sorted one by one; sums over whole bins give their offsets. So a source with a third
    of all rows is sorted by as many tasks as it has bins.
    """
    blocks = sizes.where(F.col("size") > 0).select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / BLOCK) - 1)).alias("block"))
    words = F.least(F.lit(BLOCK), F.col("size") - F.col("block") * BLOCK).cast("long")
    text = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("_mark"))), F.col("block"))
    mark = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    bits = sources.select(F.col("source").alias("_s"), F.greatest(F.lit(0), F.ceil(F.log2(F.col("blocks") / BIN))).cast("int").alias("_bits"))
    blocks = blocks.select("doc_id", "source", "_mark", "_row", "block", words.alias("words"), mark.alias("mark"))
    blocks = blocks.join(bits, F.col("source").eqNullSafe(F.col("_s"))).withColumn("bin", F.expr("shiftright(mark, 60 - _bits)")).drop("_s", "_bits")
    sums = blocks.groupBy("source", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("w"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("source").alias("_s"),
        F.col("bin").alias("_b"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n"),
        F.coalesce(F.sum("w").over(before), F.lit(0)).alias("_w"),
    )
    inside = Window.partitionBy("source", "bin").orderBy("mark", "doc_id", "block", "_mark", "_row")
    ranked = blocks.withColumns({"_at": F.row_number().over(inside) - 1, "_sum": F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    joined = ranked.join(stored(offsets, "bins"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("bin") == F.col("_b")))
    return joined.select(
        "doc_id", "source", "_mark", "_row", "block", "words", (F.col("_n") + F.col("_at")).alias("rank"), (F.col("_w") + F.col("_sum")).alias("up_to")
    )


def hypergeometric(good: Column, total: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` out of ``total`` fall on ``good``: inverse of the distribution at ``u``.

    Weights run from the mode outwards by their exact ratios, over ten standard deviations on either side.
    """
    low = F.greatest(F.lit(0.0), draws + good - total)
    high = F.least(draws, good)
    middle = F.least(high, F.greatest(low, F.floor((draws + 1) * (good + 1) / (total + 2)).cast("double")))
    variance = draws * good / total * (1 - good / total) * (total - draws) / F.greatest(F.lit(1.0), total - 1)
    reach = F.ceil(F.sqrt(F.greatest(F.lit(0.0), variance)) * 10) + 20

    def steps(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))

    def up(k: Column) -> Column:  # weight of k + 1 over that of k
        return (good - k) * (draws - k) / ((k + 1) * (total - good - draws + k + 1))

    def walk(count: Column, step) -> Column:
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"))
        return F.aggregate(steps(count), start, lambda a, i: _bound(a["w"] * step(i), lambda w: F.struct(w.alias("w"), (a["s"] + w).alias("s"))))

    def sums(b):
        above = walk(b["last"] - b["mode"], lambda i: up(b["mode"] + i - 1))
        below = walk(b["mode"] - b["first"], lambda i: 1 / up(b["mode"] - i))
        return _bound(F.struct(above["s"].alias("above"), below.alias("below")), lambda c: search(b, c))

    def search(b, c):
        start = F.struct(b["first"].alias("k"), c["below"]["w"].alias("w"), c["below"]["w"].alias("s"))
        return _bound(u * (1 + c["above"] + c["below"]["s"]), lambda wanted: F.aggregate(steps(b["last"] - b["first"]), start, lambda a, i: reached(a, wanted))["k"])

    def reached(a, wanted):
        after = _bound(a["w"] * up(a["k"]), lambda w: F.struct((a["k"] + 1).alias("k"), w.alias("w"), (a["s"] + w).alias("s")))
        return F.when(a["s"] >= wanted, a).otherwise(after)

    ends = F.struct(middle.alias("mode"), F.greatest(low, middle - reach).alias("first"), F.least(high, middle + reach).alias("last"))
    return F.when((total <= 0) | (high <= low), low).otherwise(_bound(ends, sums))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: a lambda of one element."""
    return F.transform(F.array(value), use)[0]


def shard_quotas(quotas: DataFrame, levels: int = SHARDS_LOG2, seed: int = SEED) -> DataFrame:
    """``source, pass, shard, low, high``: the range of ranks of each shard, from ``source, pass, quota``.

    One row a node holds the quotas of all sources; a level splits every node. Half of a node's blocks go
    left: sources are drawn in turn, each from what the earlier ones left over.
    """
    listed = F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("none"), "source", "pass", F.col("quota").cast("double").alias("quota"))))
    nodes = quotas.groupBy().agg(listed.alias("all"))
    nodes = nodes.select(F.lit(0).cast("long").alias("shard"), "all", F.transform("all", lambda r: r["quota"]).alias("q"))
    for level in range(levels):
        total = F.aggregate("q", F.lit(0.0), lambda a, x: a + x)

        uniform = _uniform(seed, level)

        def draw(a, r):
            return _bound(
                hypergeometric(r["q"], a["total"], a["draws"], uniform(r["i"])),
                lambda d: F.struct(F.concat(a["taken"], F.array(d)).alias("taken"), (a["total"] - r["q"]).alias("total"), (a["draws"] - d).alias("draws")),
            )

        numbered = F.transform("q", lambda x, i: F.struct(x.alias("q"), i.alias("i")))
        start = F.struct(F.array().cast("array<double>").alias("taken"), F.col("_t").alias("total"), F.floor(F.col("_t") / 2).cast("double").alias("draws"))
        split = nodes.withColumn("_t", total).withColumn("_left", F.aggregate(numbered, start, draw)["taken"])
        halves = F.array(
            F.struct((F.col("shard") * 2).alias("shard"), F.col("_left").alias("q")),
            F.struct((F.col("shard") * 2 + 1).alias("shard"), F.zip_with("q", "_left", lambda a, b: a - b).alias("q")),
        )
        nodes = split.select("all", F.explode(halves).alias("h")).select("h.shard", "all", "h.q")
        nodes = stored(nodes, "tree-level")
    rows = nodes.select("shard", F.explode(F.arrays_zip("all", "q")).alias("r")).select("shard", "r.all.source", "r.all.pass", F.col("r.q").cast("long").alias("n"))
    up_to = Window.partitionBy("source", "pass").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("high", F.sum("n").over(up_to)).select("source", "pass", "shard", (F.col("high") - F.col("n")).alias("low"), "high").where(F.col("high") > F.col("low"))


def _uniform(seed: int, level: int):
    """A number between 0 and 1 for each node of a level and each source in it."""
    return lambda i: (F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.col("shard"), i), F.lit(1 << 52)) + 0.5) / (1 << 52)


def mixed_blocks(sizes: DataFrame, sources: DataFrame, levels: int = SHARDS_LOG2, seed: int = SEED) -> DataFrame:
    """The mix: ``doc_id, source, _mark, _row, block, words, pass, shard, place``, a row for each block it takes.

    ``place`` orders the blocks of a shard at random.
    """
    blocks = stored(permuted(sizes, sources, seed), "blocks")
    wanted = sources.select(F.col("source").alias("_s"), "blocks", "passes", "need")
    last = blocks.join(wanted, F.col("source").eqNullSafe(F.col("_s"))).where(F.col("up_to") <= F.col("need"))
    partial = last.groupBy("source").agg(F.count(F.lit(1)).alias("quota"), F.first("passes").alias("pass"))
    whole = sources.where(F.col("passes") > 0).select("source", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)).alias("pass"), F.col("blocks").alias("quota"))
    quotas = whole.unionByName(partial.select("source", "pass", "quota"))
    ranges = stored(shard_quotas(stored(quotas, "quotas"), levels, seed), "shard-ranges").withColumnRenamed("source", "_s")
    within = F.col("source").eqNullSafe(F.col("_s")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    place = F.xxhash64(F.lit(seed), "shard", "pass", "doc_id", "block", "_mark")
    return blocks.join(ranges, within).select("doc_id", "source", "_mark", "_row", "block", "words", "pass", "shard", place.alias("place"))


def mixed(docs: DataFrame, levels: int = SHARDS_LOG2, seed: int = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document.

    Null and empty texts have size 0 and are never taken; a source without words has target 0. Repeated
    rows are documents of their own. Reruns agree, in any partitioning: the order depends on ids, texts, blocks
    and the seed only, so that merely rows with the same id, source and text may change places.
    Other columns are not read.
    """
    sizes = sized(docs)
    sources = stored(targets(sizes), "targets")
    taken = mixed_blocks(sizes, sources, levels, seed).groupBy(F.col("_row").alias("_r")).agg(F.sum("words").alias("taken"))
    named = sources.select(F.col("source").alias("_s"), "source_size", "target")
    rows = sizes.join(named, F.col("source").eqNullSafe(F.col("_s"))).join(taken, F.col("_row") == F.col("_r"), "left")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def block_texts(docs: DataFrame, levels: int = SHARDS_LOG2, seed: int = SEED) -> DataFrame:
    """``shard, place, doc_id, source, text`` of the mix, each shard in its random order.

    Blocks find their text by id and hash, so ids may be null or repeat.
    """
    sizes = sized(docs)
    mix = mixed_blocks(sizes, stored(targets(sizes), "targets"), levels, seed)
    texts = documents(docs).select(F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_m"), "text").dropDuplicates(["_d", "_m"])
    texts = texts.select("_d", "_m", F.regexp_extract_all("text", F.lit(_WORD), 0).alias("_w"))
    cut = F.array_join(F.slice("_w", F.col("block") * BLOCK + 1, F.lit(BLOCK)), " ")
    same = (F.col("_mark") == F.col("_m")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    rows = mix.join(texts, same).select("shard", "place", "doc_id", "source", cut.alias("text"))
    return rows.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place")


SQL = f"""
with s as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents),
t as (select source, sum(size)::bigint as source_size, list_extract([3.0, 1.0, 2.0]::double[], ((row_number() over (order by source is null, source) - 1) % 3 + 1)::bigint) as weight from s group by source),
c as (select *, source_size * 2.0::double as cap, (source_size * 2.0::double) / weight as ratio from t),
l as (select *, (sum(source_size) over () * 1.5::double - coalesce(sum(cap) over w, 0)) / (sum(weight) over () - coalesce(sum(weight) over w, 0)) as level
  from c window w as (order by ratio, source is null, source rows between unbounded preceding and 1 preceding)),
o as (select min_by(level, ratio) as level from l where ratio > level),
g as (select l.source, source_size, least(cap, coalesce(o.level * weight, cap)) as target from l left join o on true),
p as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as passes from g),
b as (select doc_id, source, size, k as block, least({BLOCK}, size - k * {BLOCK}) as words,
    substr(md5('{SEED}:' || doc_id || ':' || k), 1, 15) as mark
  from (select *, unnest(range(0, (size + {BLOCK} - 1) // {BLOCK})) as k from s)),
r as (select *, sum(words) over (partition by source order by mark, doc_id, block rows between unbounded preceding and current row) as up_to from b),
d as (select r.doc_id, sum(words) as part from r join p on r.source is not distinct from p.source where up_to <= target - passes * source_size group by r.doc_id)
select s.doc_id, s.size, p.source_size, p.target, (s.size * p.passes + coalesce(d.part, 0))::bigint as taken
from s join p on s.source is not distinct from p.source left join d on s.doc_id = d.doc_id
"""
