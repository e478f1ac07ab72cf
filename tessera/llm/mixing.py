"""Mixing sources to target weights, in blocks of words.

Every source's texts, one after another, make a stream of words that is cut into equal blocks of ``BLOCK`` words
at most. A source fills as many slots of the mixture as its target holds blocks of its own; of a part of a slot a
draw decides, so what is taken is within a block of the target, and on average meets it. The slots are dealt to
output shards of ``SHARD`` slots by a pseudorandom permutation of all slots: the counts of the sources in a shard are
multinomial draws with the targets' weights, given that all shards together meet the targets (free multinomial
draws would miss those of small sources by their whole size). A source's slots are numbered through all shards;
number k takes block pi(k mod n) of the source's n blocks, pi being a pseudorandom permutation of the block indexes
(a swap-or-not network, computed row by row for any n), and a new one for each pass over the source. Blocks and
slots are joined by index, and a document takes the words of its that lie in blocks, as often as those are taken.

The targets: sources in code point order (null last) weigh 1, 2, 3 in turn and share all words; none gets
more than ``PASSES`` times its size, and what is over is shared again by weight.

Defined results: null or blank text has size 0 and takes 0; null is a source of its own; rows with null or
repeated doc_id are rows like any other, ordered by their text's hash; an empty table gives no rows. The
same table gives the same mixture. All of it is DataFrame functions; texts are only read where they lie. What grows
with the number of sources is broadcast up to a counted number of rows and joined by key beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import KEY, bounded, cut, numbered, partitions

BLOCK, SHARD, PASSES, BUCKETS, ROUNDS = 128, 4096, 3, 1024, 12


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]++")), F.lit(0)).cast("long")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def permuted(k: Column, n: Column, *key: Column) -> Column:
    """The place of index k in a permutation of 0 .. n - 1 that ``key`` decides (swap-or-not rounds)."""

    def swap(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(r, *key), n) - x, n)
        return F.when(F.pmod(F.xxhash64(r, F.greatest(x, partner), F.lit("swap"), *key), F.lit(2)) == 1, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), k.cast("long"), swap)


def targets(sizes: DataFrame) -> DataFrame:
    """Rows (source, source_size, target) from rows (source, source_size), a row for each source."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    cap = F.lit(float(PASSES)) * F.col("source_size")
    weighed = sizes.withColumn("weight", (F.pmod(F.row_number().over(order) - 1, F.lit(3)) + 1).cast("double"))
    # the common rate at which words are shared by weight: sources whose cap comes first leave the rest to the others
    whole = Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    upto = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    capped = weighed.withColumn("cap", cap).withColumn("all", F.sum("source_size").over(whole).cast("double"))
    capped = capped.withColumn("rate", (F.col("all") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))))
    capped = capped.withColumn("k", F.row_number().over(by_cap))
    rate = F.min_by("rate", F.when(F.col("rate") * F.col("weight") <= F.col("cap"), F.col("k"))).over(whole)  # of the first that stays below its cap
    return capped.withColumn("level", rate).select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def streams(sized: DataFrame) -> DataFrame:
    """Adds start, the number of words of the source before the document; ``sized`` has uid, doc_id, source
    and size. Sums within slices of a source, and over slices."""
    dealt = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit("stream")), F.lit(BUCKETS)).cast("int"))
    sums = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = sums.withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before")
    within = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("doc_id", "text_hash", "uid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    joined = dealt.withColumn("within", within).join(bounded(before), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return joined.withColumn("start", F.col("before") + F.col("within")).drop("s", "b", "bucket", "before", "within")


def blocks_of(size: Column, block: int = BLOCK) -> Column:
    """How many blocks a source of ``size`` words has: equal ones, but for a word, of ``block`` words at most."""
    return F.ceil(size / block)


def block_start(index: Column, size: Column) -> Column:
    """The first word of a block: of n blocks the first size mod n have a word more than the others."""
    n = blocks_of(size)
    return index * F.floor(size / n) + F.least(index, F.pmod(size, n))


def block_at(word: Column, size: Column) -> Column:
    """The block that holds a word of the stream."""
    n = blocks_of(size)
    least, longer = F.floor(size / n), F.pmod(size, n)
    return F.when(word < longer * (least + 1), F.floor(word / (least + 1))).otherwise(longer + F.floor((word - longer * (least + 1)) / least))


def draws(goal: DataFrame, shard: int = SHARD) -> DataFrame:
    """Rows (source, source_size, base, total, first, count): runs of a source's slots, ``shard`` slots at most,
    numbered from ``first``; ``base`` slots belong to the sources before it, ``total`` to all. ``goal`` is a row for
    each source."""
    # a slot gives the words of a block, so the target is counted in the source's own blocks
    slots = F.col("target") / F.col("source_size") * blocks_of(F.col("source_size"))
    own = goal.where("target > 0").withColumn("all", F.floor(slots + uniform(F.coalesce("source", F.lit("\n")), F.lit("draw"))).cast("long")).where("all > 0")
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    own = own.withColumn("base", F.sum("all").over(order) - F.col("all")).withColumn("total", F.sum("all").over(Window.partitionBy()))
    runs = own.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("all") - 1, F.lit(shard).cast("long"))))
    return runs.select("source", "source_size", "base", "total", "first", F.least(F.lit(shard).cast("long"), F.col("all") - F.col("first")).alias("count"))


def slots_of(drawn: DataFrame) -> DataFrame:
    """Rows (source, n, k, epoch, index): which of a source's n blocks fills its slot k."""
    n = blocks_of(F.col("source_size"))
    # few rows make many: they are dealt out first, and Spark is kept from taking the result for small
    drawn = drawn.repartition(partitions(drawn.sparkSession), "source", "first")
    slots = drawn.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)))
    slots = slots.withColumn("epoch", F.floor(F.col("k") / F.col("n"))).where(F.col("epoch") < PASSES)
    return slots.withColumn("index", permuted(F.pmod(F.col("k"), F.col("n")), F.col("n"), F.coalesce("source", F.lit("\n")), F.col("epoch")))


def layout(goal: DataFrame, shard: int = SHARD) -> DataFrame:
    """Rows (shard, place, source, epoch, index): the mixture's output shards, slot by slot. The permutation of all
    slots deals each shard its counts of the sources."""
    slots = slots_of(draws(goal, shard)).withColumn("slot", permuted(F.col("base") + F.col("k"), F.col("total"), F.lit("shards")))
    return slots.select(F.floor(F.col("slot") / shard).alias("shard"), F.pmod(F.col("slot"), F.lit(shard)).alias("place"), "source", "epoch", "index")


def _parts(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (with a key of their own) and their place in the streams; targets; blocks taken of each source with
    their epochs."""
    sized = docs.select(F.col(KEY).alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_in(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    placed = cut(streams(sized), "streams")
    goal = cut(targets(placed.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    blocks = layout(goal).groupBy("source", "index").agg(F.collect_list("epoch").alias("epochs"))  # PASSES at most
    of = goal.select(F.col("source").alias("s"), "source_size")
    placed = placed.join(bounded(of), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    return placed, goal, blocks


def _pieces(placed: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows (uid, source, size, from, upto, epochs): parts of documents in blocks that are taken; word numbers in
    the document."""
    end = F.col("start") + F.col("size")
    of = F.col("source_size")
    spans = placed.where("size > 0").select("uid", "size", "start", "source", "source_size", F.explode(F.sequence(block_at(F.col("start"), of), block_at(end - 1, of))).alias("index"))
    joined = spans.join(blocks.select(F.col("source").alias("s"), F.col("index").alias("i"), "epochs").hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("index") == F.col("i")))
    begin = F.greatest(F.col("start"), block_start(F.col("index"), of)) - F.col("start")
    stop = F.least(end, block_start(F.col("index") + 1, of)) - F.col("start")
    return joined.select("uid", "size", begin.alias("from"), stop.alias("upto"), "epochs")


def mix(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken) of every document."""
    placed, goal, blocks = _parts(numbered(docs))
    taken = _pieces(placed, blocks).groupBy("uid").agg(F.sum((F.col("upto") - F.col("from")) * F.size("epochs")).alias("taken"))
    rows = placed.join(taken.hint("merge"), "uid", "left").join(bounded(goal.select(F.col("source").alias("s"), "target")), F.col("source").eqNullSafe(F.col("s")))
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixture(docs: DataFrame) -> DataFrame:
    """The mixture as documents: a row for each document and pass that takes words of it, with the columns
    of ``docs``. The text is whole where all of it is taken, else the taken stretches, joined by line ends;
    n_chars, if there is one, is counted anew."""
    keyed = numbered(docs)
    placed, _, blocks = _parts(keyed)
    pieces = _pieces(placed, blocks).select("uid", "size", "from", "upto", F.explode("epochs").alias("epoch"))
    passes = pieces.groupBy("uid", "epoch").agg(F.first("size").alias("size"), F.sum(F.col("upto") - F.col("from")).alias("words"), F.sort_array(F.collect_list(F.struct("from", "upto"))).alias("at"))
    passes = passes.withColumn("at", F.when(F.col("words") < F.col("size"), F.col("at"))).select("uid", F.struct("epoch", "at").alias("pass"))
    passes = passes.groupBy("uid").agg(F.sort_array(F.collect_list("pass")).alias("passes"))  # PASSES at most
    joined = keyed.join(passes.hint("merge"), keyed[KEY] == passes["uid"]).withColumn("__pass", F.explode("passes"))
    words = F.regexp_extract_all(F.col("text"), F.lit("[^\\x20\\x09-\\x0D]++[\\x20\\x09-\\x0D]*+"), F.lit(0))
    stretches = F.transform(F.col("__pass.at"), lambda x: F.rtrim(F.array_join(F.slice(words, (x["from"] + 1).cast("int"), (x["upto"] - x["from"]).cast("int")), "")))
    text = F.when(F.col("__pass.at").isNull(), F.col("text")).otherwise(F.array_join(stretches, "\n"))
    new = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return joined.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
