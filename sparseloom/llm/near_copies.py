"""Near copies: documents whose sets of word shingles have a Jaccard similarity of 4/5 or more.

Candidates come from SimHash and tables of distances to pivots, as in simhash.py, with PRINTS fingerprints
of 64 bits instead of one: at a similarity of 4/5 some ten of 64 bits differ, which no radius tells from chance in one
fingerprint. Each is cut into BLOCKS blocks, and documents that agree on a whole block share a bucket. There the
largest difference of distances to the pivots discards pairs, and all 64 bits verify those left, at RADIUS bits or less.
One fingerprint brings a pair at 4/5, of whose bits 0.15 differ, together with a probability of 0.2, all of them
miss it with 0.0002. A shingle votes on a bit with one of four weights, since plain signs tie in sets of a few shingles,
whose bits then differ more often than the similarity says.

The groups that these links connect are then verified exactly, on the whole shingle sets, each document in
its one group. What a task emits is a spanning forest of the links it verified, not the pairs. A group of more
than PART documents is cut into parts, each with the group's least document; where that leaves a group in
pieces, each pair of parts is a task of its own. Equal sets are one row of the buckets. No group has to fit one
task, and no candidate is left out. Comparisons of
fingerprints grow with the square of the documents, by 2**BITS buckets a block.

Cases: a text of fewer than WORDS words is one shingle; null and empty texts, like any without words, have the
empty shingle and are near copies of each other; a null id is never kept before another; repeated rows
are near copies, and of rows with one id the first by file and place stays; a very long text is compared whole; an
empty table gives no rows; other columns are passed through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparseloom.plans.hot import hot_limit, join_hot

from .common import FILE, ROW, drop_spooled, map_batches, spool, spread, texts, with_locator
from .simhash import BUCKET, SEED, bucket_links, components

WORDS, PRINTS, BLOCKS, RADIUS = 5, 36, 4, 9
BITS = 64 // BLOCKS
PART, CHUNK = 256, 1 << 12
#: Of so many sets one is counted to tell which buckets are so large that they are split; all are compared.
COUNTED = 16
#: Similarity from which on documents are linked, as a fraction.
ABOVE, BELOW = 4, 5


def shingles(text: bytes, width: int = WORDS) -> np.ndarray:
    """The set of a UTF-8 text's shingles as sorted 64-bit hashes; words as in simhash.fingerprint."""
    words = text.lower().split()
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)])
    return np.unique(np.frombuffer(hashes, ">u8").astype(np.uint64))


def multipliers() -> np.ndarray:
    """For each fingerprint and weight: what is mixed into a shingle's hash, and two odd factors."""
    drawn = np.random.default_rng(SEED).integers(0, 1 << 64, (3, 2, PRINTS), np.uint64, endpoint=False)
    drawn[1:] |= np.uint64(1)
    return drawn


def drawn_words(found: np.ndarray, mix: np.ndarray, odd: np.ndarray, other: np.ndarray) -> np.ndarray:
    """64 bits for every shingle and fingerprint."""
    words = (found[:, None] ^ mix) * odd
    words ^= words >> np.uint64(32)
    words *= other
    return words ^ (words >> np.uint64(29))


def add_bits(planes: list[np.ndarray]) -> list[np.ndarray]:
    """Numbers written bit by bit, added: planes[k] has rows of bits that count 2**k; in the result it has one row at most."""
    out, carried = [], []
    while len(out) < len(planes) or carried:
        rows = np.concatenate([*(planes[len(out) : len(out) + 1]), *carried])
        carried = []
        while len(rows) > 1:
            k = max(1, len(rows) // 3)
            a, b, c = rows[:k], rows[k : 2 * k], rows[2 * k : 3 * k]
            half = a ^ b
            if len(c):
                carried.append((a & b) | (half & c))
                half ^= c
            else:
                carried.append(a & b)
            rows = np.concatenate([half, rows[3 * k :]]) if len(rows) > 3 * k else half
        out.append(rows)
    return out


def prints(found: np.ndarray, mixers: np.ndarray) -> np.ndarray:
    """The PRINTS fingerprints of a shingle set. A shingle's weight on a bit is -3, -1, 1 or 3; the bit is set if their sum is over 0."""
    planes: list[np.ndarray] = []
    for at in range(0, len(found), CHUNK):
        low, high = (drawn_words(found[at : at + CHUNK], *mixers[:, k]) for k in range(2))
        fresh = [low, high]
        planes = add_bits([np.concatenate([p for p in (*planes[k : k + 1], *fresh[k : k + 1])]) for k in range(max(len(planes), 2))])
    # Weights 0 to 3 were added: those above half of the most that there could be.
    half, above, equal = 3 * len(found) // 2, np.zeros(PRINTS, np.uint64), np.full(PRINTS, np.iinfo(np.uint64).max, np.uint64)
    for k in reversed(range(len(planes))):
        bit = planes[k][0] if len(planes[k]) else np.zeros(PRINTS, np.uint64)
        if half >> k & 1:
            equal &= bit
        else:
            above |= equal & bit
            equal &= ~bit
    return above


def fingerprinted(located: DataFrame) -> DataFrame:
    """(_sl_id, FILE, ROW, whole, fps) for every row of (_sl_id, _sl_text, FILE, ROW); whole is a hash of the shingle set."""
    schema = located.drop("_sl_text").withColumn("whole", F.lit(0).cast("long")).withColumn("fps", F.array(F.lit(0).cast("long"))).schema
    mixers = multipliers()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t) for t in texts(b["_sl_text"])]
            whole = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            fps = np.array([prints(x, mixers) for x in sets], np.uint64).reshape(len(sets), PRINTS).view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, fps.size + 1, PRINTS, dtype=np.int32), pa.array(fps.ravel()))
            yield pa.RecordBatch.from_arrays([b["_sl_id"], b[FILE], b[ROW], pa.array(whole), lists], names=["_sl_id", FILE, ROW, "whole", "fps"])

    return map_batches(located, work, schema)


def alike(kinds: DataFrame) -> DataFrame:
    """(a, b): links among the nodes of ``kinds`` (node, fps) within the radius in a bucket of any of the blocks."""

    def placed(of: DataFrame) -> DataFrame:
        each = of.select("node", F.posexplode("fps").alias("k", "fp"))
        blocks = [(F.col("k") * BLOCKS + j).cast("long") * (1 << BITS) + F.shiftrightunsigned("fp", j * BITS).bitwiseAND(F.lit((1 << BITS) - 1)) for j in range(BLOCKS)]
        return each.select("node", "fp", F.explode(F.array(*blocks)).alias("bucket"))

    every = max(1, min(COUNTED, BUCKET // 64))
    counted = kinds.filter(F.pmod(F.xxhash64("node"), F.lit(every)) == 0)
    return bucket_links(placed(kinds), placed(counted).groupBy("bucket").agg((F.count(F.lit(1)) * every).alias("count")), RADIUS)


def candidates(rows: DataFrame) -> DataFrame:
    """(node, FILE, ROW, bucket): the rows of (node, FILE, ROW, whole, fps) that have others in their group, and the group."""
    kinds = spool(rows.groupBy("whole").agg(F.first("fps").alias("fps"), F.count(F.lit(1)).alias("n")).withColumn("node", F.monotonically_increasing_id()), "kinds")
    found = components(alike(kinds))
    tied = found.unionByName(found.select(F.col("root").alias("node"), "root")).distinct()
    groups = kinds.select("whole", "n", "node").join(tied, "node", "left").filter("root IS NOT NULL OR n > 1").select("whole", "n", F.coalesce("root", "node").alias("bucket"))
    # One set may have most rows of all.
    out = spool(join_hot(rows.select("node", FILE, ROW, "whole"), groups, "whole", "n", hot_limit(rows.sparkSession, rows.count())).select("node", FILE, ROW, "bucket"), "candidates")
    drop_spooled(found)
    drop_spooled(kinds)
    return out


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (i, j) that connect just the sets that pairs of enough similarity connect."""
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    every, place = np.unique(np.concatenate(sets), return_inverse=True)
    root, mark, out = np.arange(len(sets)), np.zeros(len(every), np.int32), []
    for i in range(len(sets) - 1):
        apart = (root != root[i]) & (np.arange(len(sets)) > i)
        apart &= BELOW * np.minimum(sizes, sizes[i]) >= ABOVE * np.maximum(sizes, sizes[i])
        if not apart.any():
            continue
        own = place[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        common = np.add.reduceat(mark[place], starts)
        mark[own] = 0
        near = np.flatnonzero(apart & (BELOW * common >= ABOVE * (sizes + sizes[i] - common)))
        names, first = np.unique(root[near], return_index=True)
        out += [(i, int(j)) for j in near[first]]
        root[np.isin(root, names)] = root[i]
    return out


def verified(tasks: DataFrame) -> DataFrame:
    """(a, b, bucket): forests over each (bucket, task) of (node, _sl_text, bucket, task)."""
    dealt = tasks.repartition(spread(tasks.sparkSession), "bucket", "task").sortWithinPartitions("bucket", "task", "node")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, sets = None, [], []

        def emit() -> pa.RecordBatch:
            found = forest(sets)
            columns = [pa.array([nodes[x[k]] for x in found], pa.int64()) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([group[0]] * len(found), pa.int64())], names=["a", "b", "bucket"])

        for batch in batches:
            for node, bucket, task, text in zip(*[batch[c].to_pylist() for c in ("node", "bucket", "task")], texts(batch["_sl_text"]), strict=True):
                if (bucket, task) != group:
                    if len(sets) > 1:
                        yield emit()
                    group, nodes, sets = (bucket, task), [], []
                nodes.append(node)
                sets.append(shingles(text))
        if len(sets) > 1:
            yield emit()

    return map_batches(dealt, work, "a long, b long, bucket long")


def links(located: DataFrame, placed: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b): links among the nodes of ``placed`` (node, FILE, ROW, bucket), whose texts are in ``located``;
    and the written tables that they are read from."""
    buckets = spool(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("least")).withColumn("parts", F.ceil(F.col("size") / PART).cast("long")), "buckets")
    own = located.select(F.col(FILE).alias("_sl_f"), F.col(ROW).alias("_sl_r"), "_sl_text")
    limit = hot_limit(placed.sparkSession, placed.count())

    def members(of: DataFrame, task) -> DataFrame:
        found = join_hot(placed, of, "bucket", "size", limit).select("node", FILE, ROW, "bucket", F.explode(task).alias("task"))
        return own.join(found, (F.col(FILE) == F.col("_sl_f")) & (F.col(ROW) == F.col("_sl_r"))).select("node", "_sl_text", "bucket", "task")

    part, last = F.pmod(F.xxhash64("node"), F.col("parts")), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    found = first = spool(verified(members(buckets, F.when(F.col("node") == F.col("least"), last).otherwise(F.array(part)))), "links")
    whole = found.groupBy("bucket").count().withColumnRenamed("count", "n")
    pieces = spool(buckets.filter("parts > 1").join(whole, "bucket", "left").filter(F.coalesce("n", F.lit(0)) < F.col("size") - 1).select("bucket", "size", "parts"), "pieces")
    used = [buckets, pieces, first]
    if not pieces.isEmpty():
        pairs = F.transform(last, lambda o: F.least(part, o) * F.col("parts") + F.greatest(part, o))
        # The pairs within its own part were verified before.
        others = F.filter(pairs, lambda p: p != part * F.col("parts") + part)
        used.append(spool(verified(members(pieces, others)), "links"))
        found = found.unionByName(used[-1])
    return found.select("a", "b").distinct(), used


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the row of least id of each group, all columns kept."""
    everything = with_locator(docs)
    located = everything.select(F.col(id_col).alias("_sl_id"), F.col(text_col).alias("_sl_text"), FILE, ROW)
    rows = spool(fingerprinted(located).withColumn("node", F.monotonically_increasing_id()), "fingerprints")
    placed = candidates(rows)
    pairs, used = links(located, placed)
    found = components(pairs)
    for table in [*used, placed]:
        drop_spooled(table)
    named = found.unionByName(found.select(F.col("root").alias("node"), "root")).distinct()
    rank = F.struct(F.col("_sl_id").isNull().alias("none"), F.col("_sl_id").alias("id"), F.col(FILE).alias("file"), F.col(ROW).alias("row"))
    ranked = spool(rows.join(named, "node").select("root", rank.alias("rank")), "groups")
    drop_spooled(found)
    drop_spooled(rows)
    # One group may hold most rows of all.
    heads = ranked.groupBy("root").agg(F.min("rank").alias("keep"), F.count(F.lit(1)).alias("n"))
    each = join_hot(ranked, heads, "root", "n", hot_limit(docs.sparkSession, ranked.count()))
    gone = each.filter((F.col("rank.file") != F.col("keep.file")) | (F.col("rank.row") != F.col("keep.row"))).select(F.col("rank.file").alias("_sl_f"), F.col("rank.row").alias("_sl_r"))
    # Written, so that its size is known when the join is planned: few gone rows need no shuffle of all texts.
    gone = spool(gone, "gone")
    drop_spooled(ranked)
    return everything.join(gone, (F.col(FILE) == F.col("_sl_f")) & (F.col(ROW) == F.col("_sl_r")), "left_anti").select(*docs.columns)
