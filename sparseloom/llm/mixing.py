"""Mixing sources to target weights.

* Targets: shares of all words by weight, stopped at ``MOST`` times a source's own words, the
  excess reshared by weight among the others (water filling over the table of sources).
* Blocks: a source's documents, in order, form one stream of words that is cut into blocks of
  a fixed length (the last one is shorter). A document's place in the stream comes from prefix
  sums that never need a source in one task.
* Slots: a source gets as many slots as its target has blocks. The slots of all sources are
  dealt over output shards by one pseudorandom bijection of all slots, so that the counts per
  shard are a multinomial draw conditioned on the targets' totals. (Independent draws would
  miss the targets by their noise, and could pass the limit of ``MOST`` passes.)
* Each source's slot number k is pass k // blocks, and a bijection of the block indices, another
  one for each pass, maps k % blocks to a block. Blocks join documents by (source, block).
  The last slot of a source takes only the words still missing.

Bijections are swap-or-not shuffles (Hoang, Morris, Rogaway 2012): they fit any number of
indices, cost no memory and give the same result on every run.

Cases: a null text has no words and takes none; a null source is a source of its own, weighed
last; repeated rows are rows of their own, in the order of their files' hashes where ids tie; a very long
text spans many blocks; an empty table, or one without words, takes nothing; other columns are
passed through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FILE, ROW, WORD, prefix_sums, spool, spread, with_locator, word_count

WEIGHTS = (5, 2, 1)
MOST = 3
#: Words in a block, slots in an output shard, and slots that one row of the slot plan unfolds to.
BLOCK, SHARD_SLOTS, CHUNK = 128, 4096, 16384
ROUNDS = 12

SRC, UID = "_sl_source", [FILE, ROW]


def shuffled(index: Column, n: Column, *salt: Column) -> Column:
    """The image of ``index`` under a pseudorandom bijection of 0..n-1 that ``salt`` picks."""

    def one_round(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*salt, r), n) - x, n)
        flip = F.pmod(F.xxhash64(F.greatest(x, other), *salt, r + ROUNDS), F.lit(2)) == 1
        return F.when(flip, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, one_round)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """Per source (SRC, source_size): its rank by code point, weight and target, in double."""
    ranked = sizes.withColumn("_sl_rank", F.row_number().over(Window.orderBy(F.col(SRC).asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_sl_rank"), F.lit(len(weights))) + 1).cast("int"))
    limit = F.col("source_size") * MOST
    rows = ranked.withColumn("_sl_weight", weight).withColumn("_sl_ratio", limit / F.col("_sl_weight"))
    # Sources reach their limit in the order of limit / weight. Before each: the words and weights left.
    by_ratio = Window.orderBy("_sl_ratio", "_sl_rank")
    everything = Window.partitionBy()
    filled = F.coalesce(F.sum(limit).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("_sl_weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) - filled) / left
    rows = rows.withColumn("_sl_level", level)
    # The first source whose limit lies above its level fixes the level for all that follow.
    fixed = F.min(F.when(F.col("_sl_ratio") > F.col("_sl_level"), F.struct("_sl_ratio", "_sl_rank", "_sl_level"))).over(everything)
    share = F.coalesce(fixed["_sl_level"] * F.col("_sl_weight"), limit.cast("double"))
    return rows.select(SRC, "source_size", "_sl_rank", F.least(limit.cast("double"), share).alias("target"))


def plan_slots(goals: DataFrame, block: int, seed: int) -> DataFrame:
    """One row per slot: (SRC, pass, block, words, shard); words: how many of the block's words it takes."""
    size, goal = F.col("source_size"), F.round("target").cast("long")
    passes = F.when(size > 0, F.floor(goal / size)).otherwise(F.lit(0)).cast("long")
    rest = goal - passes * size
    # A source may be small, so the rows of sources unfold in chunks: no task gets all slots of one.
    rows = goals.withColumn("_sl_blocks", F.ceil(size / block)).withColumn("_sl_rest", rest).withColumn("_sl_slots", passes * F.col("_sl_blocks") + F.ceil(rest / block))
    before = Window.orderBy("_sl_rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_sl_before", F.coalesce(F.sum("_sl_slots").over(before), F.lit(0))).withColumn("_sl_all", F.sum("_sl_slots").over(Window.partitionBy()))
    chunks = rows.filter("_sl_slots > 0").withColumn("_sl_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_sl_slots") - 1) / CHUNK))))
    chunks = chunks.repartition(spread(goals.sparkSession), "_sl_rank", "_sl_chunk")
    first = F.col("_sl_chunk") * CHUNK
    slots = chunks.withColumn("_sl_k", F.explode(F.sequence(first, F.least(first + CHUNK, F.col("_sl_slots")) - 1)))
    k, n = F.col("_sl_k"), F.col("_sl_blocks")
    last = (k == F.col("_sl_slots") - 1) & (F.pmod("_sl_rest", F.lit(block)) != 0)
    return slots.select(
        SRC,
        F.floor(k / n).alias("pass"),
        shuffled(F.pmod(k, n), n, F.lit(seed), F.col("_sl_rank"), F.floor(k / n)).alias("block"),
        F.when(last, F.pmod("_sl_rest", F.lit(block))).otherwise(F.lit(block)).cast("long").alias("words"),
        F.floor(shuffled(F.col("_sl_before") + k, F.col("_sl_all"), F.lit(seed)) / SHARD_SLOTS).alias("shard"),
    )


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, block: int = BLOCK, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, pieces, slots).

    rows: every document's id, place, source, size, source_size and target; pieces: the parts
    (SRC, block, FILE, ROW, from, to, at) of documents in blocks, where from and to count the document's words and
    at is the block's word where the piece begins; slots: as of plan_slots().
    """
    located = with_locator(docs, [F.col(id_col).alias("_sl_id"), F.col(source_col).alias(SRC), word_count(F.col(text_col)).alias("size")])
    order = [F.col("_sl_id").asc_nulls_last(), F.xxhash64(FILE), F.col(ROW)]  # short keys: range partitioning samples them to the driver
    placed = spool(prefix_sums(located, [SRC], order, "size", "_sl_start"), "streams")
    goals = spool(targets(placed.groupBy(SRC).agg(F.sum("size").alias("source_size")), weights), "targets")
    start, size, b = F.col("_sl_start"), F.col("size"), F.col("block")
    blocks = F.sequence(F.floor(start / block), F.floor((start + size - 1) / block))
    pieces = placed.filter("size > 0").withColumn("block", F.explode(blocks)).select(
        SRC, "block", *UID, "size",
        F.greatest(b * block - start, F.lit(0)).alias("from"),
        F.least((b + 1) * block - start, size).alias("to"),
        F.greatest(start - b * block, F.lit(0)).alias("at"),
    )
    rows = placed.join(goals.select(F.col(SRC).alias("_sl_s"), "source_size", "target"), F.col(SRC).eqNullSafe(F.col("_sl_s"))).drop("_sl_s")
    return rows, pieces, plan_slots(goals, block, seed)


def join_blocks(pieces: DataFrame, slots: DataFrame) -> DataFrame:
    """Blocks by index: each slot with the pieces of documents that lie in its block."""
    # Slots unfold from a tiny table of sources, whose size would make the optimizer broadcast them.
    named = slots.withColumnRenamed(SRC, "_sl_s").withColumnRenamed("block", "_sl_b").hint("merge")
    return pieces.join(named, F.col(SRC).eqNullSafe(F.col("_sl_s")) & (F.col("block") == F.col("_sl_b"))).drop("_sl_s", "_sl_b")


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """The registered query's columns, and the first output shard that takes words of the document."""
    rows, pieces, slots = mix(docs, **options)
    # The slots of a block are summed first: its full passes, and a last slot's words.
    short = F.col("words") < options.get("block", BLOCK)
    blocks = slots.groupBy(SRC, "block").agg(F.sum(F.when(short, 0).otherwise(1)).alias("full"), F.max(F.when(short, F.col("words"))).alias("words"), F.min("shard").alias("shard"))
    length = F.col("to") - F.col("from")
    part = F.greatest(F.least(F.coalesce("words", F.lit(0)) - F.col("at"), length), F.lit(0))
    taken = join_blocks(pieces, blocks).groupBy(*UID).agg(F.sum(length * F.col("full") + part).alias("taken"), F.min("shard").alias("first_shard"))
    return rows.join(taken, UID, "left").select(
        F.col("_sl_id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.when(F.col("taken") > 0, F.col("first_shard")).alias("first_shard")
    )


def mixed_documents(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mix as documents: a row for each pass in which a document's words are taken, with
    the words of that pass as its text (the text itself where all are taken)."""
    rows, pieces, slots = mix(docs, text_col=text_col, **options)
    to = F.least(F.col("to"), F.col("from") + F.col("words") - F.col("at"))
    parts = join_blocks(pieces, slots).withColumn("to", to).filter(F.col("to") > F.col("from"))
    # A document has at most size / block + 2 parts in a pass, and MOST passes.
    each = parts.groupBy(*UID, "size", "pass").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("parts"), F.sum(F.col("to") - F.col("from")).alias("taken"))
    each = each.withColumn("whole", F.col("taken") == F.col("size"))
    passes = each.groupBy(F.col(FILE).alias("_sl_f"), F.col(ROW).alias("_sl_r")).agg(F.collect_list(F.struct("pass", "whole", F.when(~F.col("whole"), F.col("parts")).alias("parts"))).alias("_sl_passes"))
    # The text is split once, however many passes take a part of it.
    split = F.when(F.exists("_sl_passes", lambda p: ~p["whole"]), F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)))
    found = with_locator(docs).join(passes, (F.col(FILE) == F.col("_sl_f")) & (F.col(ROW) == F.col("_sl_r")))
    out = found.select(*docs.columns, "_sl_passes", split.alias("_sl_words")).select(*docs.columns, "_sl_words", F.explode("_sl_passes").alias("_sl_pass"))
    cut = F.array_join(F.flatten(F.transform("_sl_pass.parts", lambda p: F.slice("_sl_words", (p["from"] + 1).cast("int"), (p["to"] - p["from"]).cast("int")))), " ")
    out = out.withColumn("_sl_new", F.when(F.col("_sl_pass.whole"), F.col(text_col)).otherwise(cut))
    kept = [F.col("_sl_new").alias(c) if c == text_col else F.length("_sl_new").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*kept)
