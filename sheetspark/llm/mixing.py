"""Mixing sources to target weights, with DataFrame functions only.

Each source's words, document after document, are packed into blocks of a fixed number of words. Output shards
draw how many of their slots each source gets, multinomially by target; the draws are then settled, surplus slots
going to the sources that fell short, so that a source's slots add up to its target. Slot k of a source reads block
perm(k mod blocks), with another keyed Feistel permutation of the block indices for each pass, and slots and blocks
are joined by index. The last slot of a source reads only the words that its target still lacks.

Documents of a source are laid out by salt, a hash of the document: sums for each salt, a running sum over salts,
then a running sum inside each salt. So no source has to fit one task, whatever its share.

Defined results: null text has no words; null source is a source of its own, the last; sources without words have
target 0; documents without words are returned with taken 0; repeated rows are documents of their own; a very long
text spans many blocks, each taken or not; an empty table gives an empty table; columns other than the three named are kept only by `mix_documents`. Every choice is a
hash of the rows and the seed: reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, free_name, n_words

#: Rounds of the index permutation, and the most times that an index outside the blocks is permuted again.
ROUNDS, WALKS = 6, 16
#: Parts that a source's documents are laid out in; a task orders one part.
SALTS, BUCKETS = 4096, 1024
#: Shards in one part of the running sum over shards.
SPAN = 4096
WEIGHTS = (1, 2, 3)


@dataclass
class Mix:
    sources: DataFrame
    documents: DataFrame
    slots: DataFrame
    taken: DataFrame


def _targets(sizes: DataFrame) -> DataFrame:
    """key, source, source_size -> with weight and target: lambda * weight, at most 3 * size, adding up to the sum of sizes."""
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weights = F.array(*map(F.lit, WEIGHTS))
    ranked = ranked.withColumn("weight", F.element_at(weights, (F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("int")).cast("double"))
    cap = 3.0 * F.col("source_size")
    order = Window.orderBy((cap / F.col("weight")).asc(), "rank")
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(below), F.lit(0.0))
    level = left / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    fits = ranked.withColumn("level", F.when(level * F.col("weight") <= cap, level))
    # capped sources come first; the first level that its own source does not cap holds for all
    return fits.withColumn("level", F.min_by("level", F.when(F.col("level").isNotNull(), cap / F.col("weight"))).over(Window.partitionBy(F.lit(0)))).withColumn("target", F.least(F.col("level") * F.col("weight"), cap)).drop("level", "rank")


def _index(slot, key, blocks, seed):
    """Block of a source's slot: a pseudorandom permutation of the indices for each source and pass.

    A Feistel network over pairs (x, y) of a grid with a columns and b rows that just holds the blocks; each round adds
    a keyed hash of one half to the other. An index that falls outside the blocks is permuted again until it is inside
    (cycle walking). The grid has less than a places outside, so WALKS is enough for certain up to 256 blocks; beyond,
    a walk that long has a chance below 1e-18.
    """
    turn = F.floor(slot / blocks)
    a = F.ceil(F.sqrt(blocks)).cast("long")
    b = F.ceil(blocks / a).cast("long")
    keyed = F.xxhash64(F.lit(seed), key, turn)

    def mixed(v, j, size):
        return F.pmod(F.xxhash64(keyed, j, v), size)

    def permuted(i):
        half = lambda s, j: F.struct(s["y"].alias("x"), F.pmod(s["x"] + mixed(s["y"], j, F.when(j % 2 == 1, a).otherwise(b)), F.when(j % 2 == 1, a).otherwise(b)).alias("y"))
        # after an even number of rounds the halves are in their places again
        end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(F.pmod(i, a).alias("x"), F.floor(i / a).alias("y")), half)
        return end["y"] * a + end["x"]

    # the loop's own variable keeps each pass from being written out again for the test
    walk = lambda i, n: F.when((n > 0) & (i < blocks), i).otherwise(permuted(i))
    return F.aggregate(F.sequence(F.lit(0), F.lit(WALKS)), slot - turn * blocks, walk)


def plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block_words: int = 64, shard_slots: int = 4096, seed: int = 17) -> Mix:
    """The mix: sources with targets, documents with offsets, slots by output shard, and words taken of each document."""
    spark = docs.sparkSession
    text, source = F.col(text_col), F.col(source_col).cast("string")
    sized = docs.select(F.col(id_col).alias("id"), source.alias("source"), n_words(text).alias("size"), F.xxhash64(text).alias("print"))
    sized = sized.withColumn("key", F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), "source")))
    sized = cut(sized.withColumn("salt", F.pmod(F.xxhash64("id", "print", F.lit(seed)), F.lit(SALTS)).cast("int")), "mix-sizes")

    salts = sized.groupBy("key", "source", "salt").agg(F.sum("size").alias("words"))
    sources = _targets(salts.groupBy("key", "source").agg(F.sum("words").alias("source_size")))
    size, target = F.col("source_size"), F.col("target")
    turns = F.when(size > 0, F.floor(target / size)).otherwise(0).cast("long")
    blocks = F.ceil(size / block_words).cast("long")
    sources = sources.withColumns({"turns": turns, "blocks": blocks}).withColumn("rest", F.greatest(F.lit(0), F.round(target - F.col("turns") * size)).cast("long"))
    sources = sources.withColumn("last_words", F.pmod("rest", F.lit(block_words)))
    sources = sources.withColumn("n_slots", F.col("turns") * F.col("blocks") + F.floor(F.col("rest") / block_words) + (F.col("last_words") > 0).cast("long"))
    sources = cut(sources.withColumn("upto", F.sum("n_slots").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0))), "mix-sources")

    running = Window.partitionBy("key").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salts.select("key", "salt", F.coalesce(F.sum("words").over(running), F.lit(0)).alias("base"))
    inside = Window.partitionBy("key", "salt").orderBy("id", "print", "size").rowsBetween(Window.unboundedPreceding, 0)
    documents = sized.withColumn("before", F.sum("size").over(inside) - F.col("size")).join(bases, ["key", "salt"])
    documents = documents.select("id", "print", "key", "size", (F.col("before") + F.col("base")).alias("start"))

    slots = _slots(spark, sources, shard_slots, seed)
    read = slots.join(sources.select("key", "blocks", "n_slots", "last_words"), "key")
    read = read.withColumn("block", _index(F.col("slot"), F.col("key"), F.col("blocks"), seed))
    part = F.when((F.col("slot") == F.col("n_slots") - 1) & (F.col("last_words") > 0), F.col("last_words"))
    uses = read.groupBy("key", "block").agg(F.count_if(part.isNull()).alias("full"), F.coalesce(F.max(part), F.lit(0)).alias("part"))

    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    pieces = documents.where("size > 0").withColumn("block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    lo = F.greatest(F.col("start"), F.col("block") * block_words) - F.col("block") * block_words
    hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words) - F.col("block") * block_words
    taken = pieces.join(uses, ["key", "block"], "left").select("id", "print", "key", "size", "start", "block", F.coalesce("full", F.lit(0)).alias("full"), F.coalesce("part", F.lit(0)).alias("part"), lo.alias("lo"), hi.alias("hi"))
    words = F.col("full") * (F.col("hi") - F.col("lo")) + F.greatest(F.lit(0), F.least("part", "hi") - F.col("lo"))
    return Mix(sources, documents, read, taken.withColumn("words", words))


def _slots(spark, sources: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """shard, key, slot: multinomial draws of each shard, settled so that each source has its n_slots exactly."""
    total = sources.agg(F.coalesce(F.max("upto"), F.lit(0)).cast("long")).first()[0]
    unit = 1.0 / (1 << 53)
    draws = spark.range(total).select(F.floor(F.col("id") / shard_slots).alias("shard"), (F.pmod(F.xxhash64(F.lit(seed + 2), "id"), F.lit(1 << 53)) * unit).alias("u"))
    draws = draws.withColumn("bucket", F.floor(F.col("u") * BUCKETS))
    lo, hi = (F.col("upto") - F.col("n_slots")) / F.lit(float(max(1, total))), F.col("upto") / F.lit(float(max(1, total)))
    bands = sources.where("n_slots > 0").select("key", "n_slots", lo.alias("lo"), F.when(F.col("upto") == total, 1.0).otherwise(hi).alias("hi"))
    bands = bands.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") * BUCKETS), F.least(F.lit(BUCKETS - 1), F.floor(F.col("hi") * BUCKETS)).cast("long"))))
    drawn = draws.join(bands, "bucket").where("u >= lo and u < hi").groupBy("shard", "key", "n_slots").agg(F.count(F.lit(1)).alias("n"))
    # a running sum over shards: over spans of them first, then inside each span, so no task has all shards of a source
    drawn = cut(drawn.withColumn("span", F.floor(F.col("shard") / SPAN)), "mix-shards")
    spans = drawn.groupBy("key", "span").agg(F.sum("n").alias("in_span"))
    before = F.sum("in_span").over(Window.partitionBy("key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select("key", "span", F.coalesce(before, F.lit(0)).alias("base"))
    inside = Window.partitionBy("key", "span").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    drawn = drawn.withColumn("from", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(spans, ["key", "span"])
    drawn = cut(drawn.withColumn("from", F.col("from") + F.col("base")).drop("span", "base"), "mix-draws")
    own = drawn.withColumn("to", F.least(F.col("from") + F.col("n"), "n_slots")).where(F.col("from") < F.col("to"))
    own = own.select("shard", "key", F.explode(F.sequence("from", F.col("to") - 1)).alias("slot"))
    surplus = drawn.select("shard", "key", (F.col("from") + F.col("n") - F.greatest("from", "n_slots")).alias("more")).where("more > 0")
    lack = sources.where("n_slots > 0").select("key", "n_slots").join(drawn.groupBy("key").agg(F.sum("n").alias("had")), "key", "left")
    lack = lack.select("key", F.coalesce("had", F.lit(0)).alias("had"), "n_slots").where("had < n_slots")
    upto = lambda df, n, *order: df.withColumn("g0", F.sum(n).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - n)  # noqa: E731  a row for each source, or for the last shards: surplus grows with the root of a source's slots
    given = upto(surplus, F.col("more"), "shard", "key").select("shard", F.explode(F.sequence("g0", F.col("g0") + F.col("more") - 1)).alias("g"))
    wanted = upto(lack, F.col("n_slots") - F.col("had"), "key").select("key", F.posexplode(F.sequence("had", F.col("n_slots") - 1)).alias("i", "slot"), "g0")
    settled = given.join(wanted.select("key", "slot", (F.col("g0") + F.col("i")).alias("g")), "g").select("shard", "key", "slot")
    return own.unionByName(settled)


def mix_counts(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Per row of docs: id, size, source_size, target, taken."""
    m = plan(docs, id_col, **options)
    some = m.taken.groupBy("id", "key", "start", "size").agg(F.sum("words").alias("taken")).select("id", "key", "size", "taken")
    none = m.documents.where("size = 0").select("id", "key", "size", F.lit(0).cast("long").alias("taken"))
    both = some.unionByName(none).join(m.sources.select("key", "source_size", "target"), "key")
    return both.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", length_col: str = "n_chars", block_words: int = 64, **options) -> DataFrame:
    """The mix as documents: a row for each time that words of a document are taken, with the words taken that time.

    A document of which a slot takes part is cut at block borders; white space stays with the word before it.
    length_col, where docs have it, becomes the new text's length.
    """
    m = plan(docs, id_col, source_col, text_col, block_words, **options)
    masks = m.taken.groupBy("id", "print", "key", "start").agg(F.sort_array(F.collect_list(F.struct("block", "full", "part"))).alias("uses"), F.max(F.col("full") + (F.col("part") > F.col("lo")).cast("int")).alias("most"))
    masks = masks.where("most > 0").groupBy("id", "print").agg(F.collect_list(F.struct("start", "uses", "most")).alias("copies"))  # one for each repeated row
    k, p, copies, times, turn, made = (free_name(docs.columns, n) for n in ("_key", "_print", "_copies", "_times", "_turn", "_made"))
    key = lambda c: F.when(c.isNull(), "0").otherwise(F.concat(F.lit("1"), c.cast("string")))
    masks = masks.select(key(F.col("id")).alias(k), F.col("print").alias(p), F.col("copies").alias(copies))
    text = F.col(text_col)
    # repeated rows are told apart by number; the window's order of rows serves the join too
    one = docs.withColumns({k: key(F.col(id_col)), p: F.xxhash64(text)})
    one = one.withColumn(turn, F.row_number().over(Window.partitionBy(k, p).orderBy(F.lit(0))))
    joined = one.join(masks, [k, p]).withColumn(copies, F.get(copies, F.col(turn) - 1)).where(F.col(copies).isNotNull())
    joined = joined.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(copies)["most"].cast("int"))))
    words = F.regexp_extract_all(text, F.lit(rf"([\x20\x09-\x0D]*{WORD}[\x20\x09-\x0D]*)"), F.lit(1))
    start = F.col(copies)["start"]

    def is_taken(_, n):
        at = start + n
        use = F.get(F.col(copies)["uses"], (F.floor(at / block_words) - F.floor(start / block_words)).cast("int"))
        return use["full"] + (F.pmod(at, F.lit(block_words)) < use["part"]).cast("int") >= F.col(times)

    joined = joined.withColumn(made, F.array_join(F.filter(words, is_taken), ""))
    columns = [F.col(made).alias(c) if c == text_col else F.length(made).cast(docs.schema[c].dataType).alias(c) if c == length_col else F.col(c) for c in docs.columns]
    return joined.select(*columns)
