"""SimHash near-duplicates, found with tables of distances to pivots.

Fingerprints: 64 bits from all word shingles of the whole text, one pass, a row per document.

Links join distinct fingerprints that differ in at most ``radius`` bits. For every
fingerprint the Hamming distances to PIVOTS reference fingerprints are tabulated. By the
triangle inequality two fingerprints within the radius differ by no more than the radius in any
of these coordinates, so a pair is discarded by its largest coordinate difference; survivors
are verified on all 64 bits.

Distances to pivots alone leave more than half of random pairs per coordinate, so pairs are
only formed inside buckets that no true pair can miss: the bits are cut into radius + 2 blocks,
and two fingerprints within the radius agree on at least two whole blocks. Each pair of blocks
gives one table of buckets. In a bucket, rows are sorted by their first coordinate, and a row meets
only those within the radius there. What a task emits is a spanning forest of the links it
verified, not the pairs: each tree as a star about its least member, the same whichever bucket
it is found in. A bucket of more than BUCKET rows is cut into parts, and each pair of parts is a
task of its own: no group has to fit one task, and no pair is left out.

Components come from alternating large and small stars over the forests (operators/stars.py). Fingerprints
that very many rows share, and groups of very many fingerprints, are broadcast to their rows instead of dealt to one task.

Cases: null and empty texts, like any without words, have fingerprint zero, which links like any other; equal
texts share a fingerprint; a null id never becomes a component's id unless all of them are null; rows repeated
with their id stay rows of their own; a very long text is hashed in chunks, whole; an empty table gives no
rows; other columns are not read (or passed through, by one_of_each_group), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparseloom.operators.stars import star_components
from sparseloom.plans.hot import hot_limit, join_hot

from .common import FILE, ROW, drop_spooled, map_batches, spool, spread, texts, with_locator

WORDS, SEED, RADIUS = 4, 42, 4
PIVOTS, BUCKET, CHUNK = 24, 2048, 1 << 15


def fingerprint(text: bytes, width: int = WORDS) -> int:
    """SimHash of a UTF-8 text: bit i is set if more than half of the shingles' hashes have it."""
    words = text.lower().split()  # bytes: lower() touches A-Z only, split() the six ASCII spaces
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest, counts, n = xxhash.xxh64_digest, np.zeros(64, np.int64), len(words) - width + 1
    for at in range(0, n, CHUNK):
        stop = min(n, at + CHUNK)
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at:stop].tolist(), ends[at + width - 1 : stop + width - 1].tolist(), strict=True)])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS) -> DataFrame:
    """(_sl_id, FILE, ROW, fp) for every row; fp is the fingerprint's bits as a signed long."""
    located = with_locator(docs, [F.col(id_col).alias("_sl_id"), F.col(text_col).alias("_sl_text")])
    schema = located.drop("_sl_text").withColumn("fp", F.lit(0).cast("long")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t, width) for t in texts(b["_sl_text"])], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["_sl_id"], b[FILE], b[ROW], pa.array(found)], names=["_sl_id", FILE, ROW, "fp"])

    return map_batches(located, work, schema)


def pivots(n: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 64, n, np.uint64, endpoint=False)


def block_masks(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of radius + 2 blocks of the 64 bits."""
    edges = [round(64 * i / (radius + 2)) for i in range(radius + 3)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of i and j; root[x] is always the least index of x's set."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def forest(bucket: np.ndarray, fp: np.ndarray, radius: int, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (place, place) that connect just what is within the radius in the same bucket."""
    table = np.bitwise_count(fp[None, :] ^ refs[:, None]).astype(np.int8)  # the pivot distance table
    order = np.lexsort((fp, table[0], bucket))
    bucket, fp, table = bucket[order], fp[order], table[:, order]
    root = np.arange(len(fp))
    live, step = root[:-1], 1
    while len(live):
        live = live[live + step < len(fp)]
        far = live + step
        near = (bucket[far] == bucket[live]) & (table[0, far] - table[0, live] <= radius)
        live = live[near]  # sorted by the coordinate: what is too far off now is so at each larger step
        i = live[root[live] != root[live + step]]  # pairs that are connected already tell nothing new
        j = i + step
        for row in table[1:]:
            close = np.abs(row[i] - row[j]) <= radius
            i, j = i[close], j[close]
        true = np.bitwise_count(fp[i] ^ fp[j]) <= radius
        merge(root, i[true], j[true])
        step += 1
    tied = np.flatnonzero(root != np.arange(len(fp)))
    return order[tied], order[root[tied]]


def stars(tied: np.ndarray, root: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (place, root's place) of forest() as links (id, least id of its tree).

    A group that meets in many buckets thus gives the same links in each, which distinct() makes one.
    """
    least = ids.copy()
    np.minimum.at(least, root, ids[tied])
    places = np.concatenate([tied, np.unique(root)])
    low = least[np.concatenate([root, np.unique(root)])]
    apart = ids[places] != low
    return ids[places[apart]], low[apart]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links among the distinct values of ``fps.fp`` whose components are those of all pairs within the radius."""
    blocks, tables = block_masks(radius), []
    for t, pair in enumerate(combinations(blocks, 2)):
        key = F.lit(t).cast("long")
        for at, bits in pair:
            key = F.shiftleft(key, bits).bitwiseOR(F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << bits) - 1)))
        tables.append(key)
    rows = fps.select("fp", F.explode(F.array(*tables)).alias("bucket"))
    return bucket_links(rows, rows.groupBy("bucket").count(), radius)


def bucket_links(rows: DataFrame, counts: DataFrame, radius: int) -> DataFrame:
    """(a, b): links among the rows (fp, bucket) that connect what is within the radius in a bucket: values of
    ``node`` if ``rows`` has that column, else of fp. ``counts`` (bucket, count) tells which buckets to split."""
    spark, ids = rows.sparkSession, "node" if "node" in rows.columns else "fp"
    columns = list(dict.fromkeys(["fp", "bucket", ids]))
    large = spool(counts.filter(F.col("count") > BUCKET).select(F.col("bucket").alias("_sl_b"), F.ceil(F.col("count") / BUCKET).cast("long").alias("parts")), "large")
    if not large.isEmpty():
        part = F.pmod(F.xxhash64(ids), F.col("parts"))
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: F.least(part, o) * F.col("parts") + F.greatest(part, o))
        # With its own part a row is in a task anyway, through any other part.
        others = F.filter(pairs, lambda p: p != part * F.col("parts") + part)
        rows = rows.join(large, F.col("bucket") == F.col("_sl_b"), "left").select(*columns, F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(others)).alias("task"))
    else:
        rows = rows.select(*columns, F.lit(-1).cast("long").alias("task"))
    dealt = rows.repartition(spread(spark), "bucket", "task").sortWithinPartitions("bucket", "task")
    refs = pivots()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def emit(rows: np.ndarray) -> pa.RecordBatch:
            new = np.r_[False, (rows[1:, 1:3] != rows[:-1, 1:3]).any(axis=1)]
            a, b = stars(*forest(np.cumsum(new), rows[:, 0].copy().view(np.uint64), radius, refs), rows[:, 3])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            held.append(np.stack([batch[c].to_numpy(zero_copy_only=False) for c in ("fp", "bucket", "task", ids)], axis=1))
            size += len(held[-1])
            if size >= CHUNK:
                rows = np.concatenate(held)
                last = np.flatnonzero((rows[:, 1:3] != rows[-1, 1:3]).any(axis=1))
                cut = int(last[-1]) + 1 if len(last) else 0  # the last bucket may go on in the next batch
                if cut:
                    yield emit(rows[:cut])
                held, size = [rows[cut:]], len(rows) - cut
        if size:
            yield emit(np.concatenate(held))

    return map_batches(dealt, work, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b) that are not their own root, the least node of the component."""
    found, _ = star_components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return found.select(F.col("vid").alias("node"), "root")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """Per row of ``docs``: (_sl_id, FILE, ROW, fp, keep); keep (null, id, file, row) is the row of least id that it is linked with."""
    rows = spool(fingerprints(docs, id_col, text_col, width), "fingerprints")
    rank = F.struct(F.col("_sl_id").isNull().alias("none"), F.col("_sl_id").alias("id"), F.col(FILE).alias("file"), F.col(ROW).alias("row"))
    fps = spool(rows.groupBy("fp").agg(F.min(rank).alias("least"), F.count(F.lit(1)).alias("rows")), "distinct")
    found = components(links(fps.select("fp"), radius))
    named = spool(fps.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root")), "named")
    drop_spooled(found)
    drop_spooled(fps)
    # One group may hold most fingerprints, and one fingerprint most rows.
    sizes = named.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    heads = named.groupBy("root").agg(F.min("least").alias("keep"), F.count(F.lit(1)).alias("n"))
    kept = join_hot(named.drop("least"), heads, "root", "n", hot_limit(docs.sparkSession, sizes[0]))
    return join_hot(rows, kept.select("fp", "keep", "rows"), "fp", "rows", hot_limit(docs.sparkSession, sizes[1])).drop("rows")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """The registered query's columns."""
    return near_groups(docs).select(F.col("_sl_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("keep.id").alias("component_id"))


def one_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the row of least id of each group, all columns kept."""
    rows = near_groups(docs, **options).filter((F.col("keep.file") == F.col(FILE)) & (F.col("keep.row") == F.col(ROW)))
    keepers = rows.select(F.col(FILE).alias("_sl_f"), F.col(ROW).alias("_sl_r"))
    located = with_locator(docs)
    return located.join(keepers, (F.col(FILE) == F.col("_sl_f")) & (F.col(ROW) == F.col("_sl_r"))).select(*[located[c] for c in docs.columns])
