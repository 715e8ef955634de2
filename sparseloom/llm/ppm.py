"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts up to ORDER bytes, trained on the corpus. A text's code
length is summed over its bytes and an end symbol (0xFF, which UTF-8 never has; it also
fills the context before a text). A byte is predicted from the longest context that
the trie knows, with escape estimation by method C, T / (N + T) for T distinct of N symbols
seen; after an escape, symbols of the longer context are excluded from the shorter one's counts. Below
order 0 all symbols that are left are equally likely. So each text's probability is that of a
proper distribution over texts.

Exclusion needs no lists of symbols: what a context saw, its shorter context saw as often or more, so
a context keeps its total, its number of symbols, and the mass that its symbols have in
the shorter context. All grams of a batch are then scored as arrays.

Training counts (ORDER+1)-grams and word tokens over all training texts in one pass, combined
per task and then by key; shorter grams are sums of longer ones. All grams are kept, as a table. Each
distinct gram of the corpus is scored once: one that training saw by its context's totals, any other by
joins of its shorter grams and contexts; only those of up to LOW bytes, at most 65,792, are looked up in
memory. The TRIE most frequent scored grams are broadcast and the others joined by gram. Likewise the HEAD most frequent tokens are broadcast for the base
score, and the others are joined by token. Both broadcasts have their size from the constant, not from the data.

Cases: null and empty texts hold just the end; without training texts all bytes are equally
likely and the base score is 0; null ids are not held out; repeated rows are scored each; which of equally
frequent grams or tokens are broadcast changes no score; a very long text is scored whole, in a run of its own; an empty
table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_spooled, map_batches, spool, texts
from .quality import held_out

ORDER, SYMBOLS, END = 5, 256, 0xFF
#: Most scored grams, and tokens, in the broadcast heads. Neither changes a score.
TRIE, HEAD = 2_000_000, 200_000
BUCKET_BITS = 20
#: Distinct entries that a training task gathers before it hands them on, and bytes that are counted or scored at once.
GATHER, CHUNK = 500_000, 1 << 20
#: Bytes of the longest grams that are looked up in memory.
LOW = 2
STEPS = 16  # of a threshold, per doubling


def grams(batch: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(keys, firsts): each byte of the texts and their ends with the ``order`` bytes before; where each text's begin."""
    pad = bytes([END]) * order
    stream = np.frombuffer(pad + (bytes([END]) + pad).join(batch) + bytes([END]), np.uint8)
    sizes = np.array([len(t) + 1 for t in batch], np.int64)
    firsts = np.cumsum(sizes) - sizes
    keys = np.zeros(len(stream) - order, np.int64)
    for k in range(order + 1):
        keys <<= 8
        keys |= stream[k : len(stream) - order + k]
    # Places inside the padding between texts are no symbols.
    coded = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(batch)) * order, sizes)
    return keys[coded], firsts


def chunks(batch: list[bytes], most: int = CHUNK) -> Iterator[list[bytes]]:
    """Runs of texts of about ``most`` bytes."""
    held, size = [], 0
    for t in batch:
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def sum_by_key(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, c = k[order], c[order]
    if not len(k):
        return k, c
    new = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[new], np.add.reduceat(c, new)


def gathered(docs: DataFrame, text_col: str, order: int = ORDER) -> DataFrame:
    """(gram, token, n): counts of grams (token is null) and of tokens (gram is null) over all ``docs``."""
    read = docs.select(F.col(text_col).alias("_sl_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        words: Counter[bytes] = Counter()

        def of(k: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(k), pa.nulls(len(k), pa.binary()), pa.array(c)], names=["gram", "token", "n"])

        def of_words() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.nulls(len(words), pa.int64()), pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], names=["gram", "token", "n"])

        for b in batches:
            for some in chunks(texts(b["_sl_text"])):
                k, c = np.unique(grams(some, order)[0], return_counts=True)
                keys.append(k)
                counts.append(c)
                held += len(k)
                if held > GATHER:
                    k, c = sum_by_key(keys, counts)
                    if len(k) > GATHER // 2:
                        yield of(k, c)
                        k, c = k[:0], c[:0]
                    keys, counts, held = [k], [c], len(k)
                for t in some:
                    words.update(t.lower().split())
                words[b""] += len(some)  # the end, which no word equals
                if len(words) > GATHER:
                    yield of_words()
                    words.clear()
        if keys:
            yield of(*sum_by_key(keys, counts))
        if words:
            yield of_words()

    return map_batches(read, work, "gram long, token binary, n long").groupBy("gram", "token").agg(F.sum("n").alias("n"))


def step(n: Column) -> Column:
    return F.floor(F.log2(n) * STEPS).cast("int")


def threshold(rows: DataFrame, most: int) -> int:
    """The least step of ``n`` from which on there are at most ``most`` rows; steps are a few hundred at any size."""
    left, found = most, 1 << 20
    for r in rows.groupBy(step(F.col("n")).alias("s")).count().orderBy(F.desc("s")).collect():
        left -= r["count"]
        if left < 0:
            return found
        found = r["s"]
    return 0


@dataclass
class Level:
    """Contexts of one length: sorted gram keys with counts; sorted contexts with totals,
    numbers of symbols, and their symbols' mass in the shorter context."""

    keys: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    distinct: np.ndarray
    below: np.ndarray

    def look(self, key: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, ...]:
        """(known, total, distinct, below) of the keys' contexts; (hit, count) of the keys."""
        at, known = find(self.contexts, key >> 8)
        gram, hit = find(self.keys, key)
        of = lambda x, i, ok: x[i] * ok if len(x) else np.zeros(len(key))
        return known, *(of(x, at, known) for x in (self.total, self.distinct, self.below)), hit, of(self.counts, gram, hit)


@dataclass
class Joined:
    """What joins found for each gram at one level; NaN where nothing."""

    n: np.ndarray
    total: np.ndarray
    distinct: np.ndarray
    below: np.ndarray

    def look(self, key: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, ...]:
        known, hit = ~np.isnan(self.total[live]), ~np.isnan(self.n[live])
        return known, *(np.nan_to_num(x[live]) for x in (self.total, self.distinct, self.below)), hit, np.nan_to_num(self.n[live])


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def build(levels: list[tuple[np.ndarray, np.ndarray]]) -> list[Level]:
    """The trie from (keys, counts) of each context length, from 0 up."""
    out: list[Level] = []
    for j, (keys, counts) in enumerate(levels):
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order].astype(np.float64)
        contexts = keys >> 8
        new = np.flatnonzero(np.r_[True, contexts[1:] != contexts[:-1]]) if len(keys) else np.zeros(0, np.int64)
        mass = np.ones(len(keys))
        if j and len(keys):
            at, _ = find(out[-1].keys, keys & (1 << 8 * j) - 1)
            mass = out[-1].counts[at]
        add = (lambda x: np.add.reduceat(x, new)) if len(keys) else (lambda x: np.zeros(0))
        out.append(Level(keys, counts, contexts[new], add(counts), add(np.ones(len(keys))), add(mass)))
    return out


def log10_probability(trie: list[Level | Joined], keys: np.ndarray) -> np.ndarray:
    """Of each gram's last byte after the others."""
    out = np.zeros(len(keys))
    live = np.arange(len(keys))
    mass, seen = np.zeros(len(keys)), np.zeros(len(keys))  # of symbols excluded, at this level
    for j in range(len(trie) - 1, -1, -1):
        key = keys[live] & (1 << 8 * (j + 1)) - 1
        known, total, distinct, below, hit, count = trie[j].look(key, live)
        if known.any():
            left = np.where(known, distinct - seen, 0)
            all_ = np.where(known, total - mass, 0) + left
            out[live[hit]] += np.log10(count[hit] / all_[hit])
            escape = ~hit & (left > 0)
            out[live[escape]] += np.log10(left[escape] / all_[escape])
            mass, seen = np.where(known, below, 0), np.where(known, distinct, 0)
            live, mass, seen = live[~hit], mass[~hit], seen[~hit]
        if not len(live):
            return out
    out[live] -= np.log10(SYMBOLS - seen)
    return out


@dataclass
class Head:
    """Scored grams by bucket: a hash's first BUCKET_BITS bits; in a bucket, the most frequent gram comes first."""

    starts: np.ndarray  # of each bucket, and the end of the last
    keys: np.ndarray
    logs: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, logs: np.ndarray, uses: np.ndarray) -> Head:
        bucket = buckets(keys)
        order = np.lexsort((-uses, bucket))
        starts = np.zeros((1 << BUCKET_BITS) + 1, np.int32)
        starts[1:] = np.cumsum(np.bincount(bucket, minlength=1 << BUCKET_BITS))
        return cls(starts, keys[order], logs[order])

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hit, log) of each key; 0 where it is not here."""
        hit, logs = np.zeros(len(keys), bool), np.zeros(len(keys))
        bucket = buckets(keys)
        at, end, live = self.starts[bucket], self.starts[1:][bucket], np.arange(len(keys))
        while len(live := live[at < end]):
            at, end = at[at < end], end[at < end]
            found = self.keys[at] == keys[live]
            hit[live[found]], logs[live[found]] = True, self.logs[at[found]]
            live, at, end = live[~found], at[~found] + 1, end[~found]
        return hit, logs


def buckets(keys: np.ndarray) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def text_scores(known: Head, batch: list[bytes], order: int = ORDER) -> tuple[np.ndarray, ...]:
    """Sums over each text of the logs that ``known`` has; (text, gram, tf) of the other grams."""
    keys, firsts = grams(batch, order)
    hit, logs = known.look(keys)
    lost = np.flatnonzero(~hit)
    text, gram = np.searchsorted(firsts, lost, "right") - 1, keys[lost]
    by = np.lexsort((gram, text))
    text, gram = text[by], gram[by]
    new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (gram[1:] != gram[:-1])]) if len(by) else by
    return np.add.reduceat(logs, firsts), text[new], gram[new], np.diff(np.r_[new, len(by)])


def scored(asked: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, uses, log) of every gram of ``asked`` (gram, n, m): n times in training, m times elsewhere."""
    spark = asked.sparkSession
    learned, uses = asked.filter("n > 0"), (F.col("n") + F.col("m")).alias("uses")
    context = Window.partitionBy(F.shiftright("gram", 8))
    direct = learned.select("gram", uses, F.log10(F.col("n") / (F.sum("n").over(context) + F.count(F.lit(1)).over(context))).alias("log"))
    suffix = F.expr("gram & (shiftleft(1L, 8 * (length + 1)) - 1)").alias("key")
    lengths = lambda first: F.explode(F.sequence(F.lit(first), F.lit(order))).alias("length")
    every = spool(learned.select("gram", "n", lengths(0)).groupBy("length", suffix).agg(F.sum("n").alias("n")), "grams")
    low = every.filter(F.col("length") < LOW).toArrow()
    length, key, n = (low[c].to_numpy() for c in ("length", "key", "n"))
    trie = spark.sparkContext.broadcast(build([(key[length == j], n[length == j]) for j in range(LOW)]))
    shorter = every.select((F.col("length") + 1).alias("_sl_l"), F.col("key").alias("_sl_k"), F.col("n").alias("less"))
    high = every.filter(F.col("length") >= LOW)
    in_shorter = (F.col("length") == F.col("_sl_l")) & (F.expr("key & (shiftleft(1L, 8 * length) - 1)") == F.col("_sl_k"))
    contexts = high.join(shorter, in_shorter).groupBy("length", F.shiftright("key", 8).alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"), F.sum("less").alias("below"))
    steps = asked.filter("n = 0").select("gram", uses, lengths(LOW)).select("*", suffix).withColumn("context", F.shiftright("key", 8))
    steps = steps.join(high, ["length", "key"], "left").join(contexts, ["length", "context"], "left")
    names = [(j, c) for j in range(LOW, order + 1) for c in ("n", "total", "distinct", "below")]
    wide = steps.groupBy("gram", "uses").agg(*[F.max(F.when(F.col("length") == j, F.col(c).cast("double"))).alias(f"{c}{j}") for j, c in names])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = {c: b[c].to_numpy(zero_copy_only=False).astype(float) for c in b.schema.names[2:]}
            joined = [Joined(*(columns[f"{c}{j}"] for c in ("n", "total", "distinct", "below"))) for j in range(LOW, order + 1)]
            logs = log10_probability([*trie.value, *joined], b["gram"].to_numpy())
            yield pa.RecordBatch.from_arrays([b["gram"], b["uses"], pa.array(logs, pa.float64())], names=["gram", "uses", "log"])

    found = spool(direct.unionByName(map_batches(wide, work, "gram long, uses long, log double")), "scored")
    drop_spooled(every)
    return found


_HEADS: dict[str, dict[bytes, float]] = {}


def head_logs(shared, key: str) -> dict[bytes, float]:
    """token -> log10(count + 0.5), made once in a worker; ``key`` names the broadcast for good."""
    if key not in _HEADS:
        _HEADS.clear()
        tokens, logs = shared.value
        _HEADS[key] = dict(zip(tokens.split(b" "), logs.tolist(), strict=True)) if len(logs) else {}
    return _HEADS[key]


def score(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """The registered query's columns; ``held`` tells the rows that are not learned from."""
    spark = docs.sparkSession
    counts = spool(gathered(docs.filter(~held), text_col, order), "counts")
    zero = F.lit(0).cast("long")
    asked = counts.filter("gram is not null").select("gram", "n", zero.alias("m"))
    asked = asked.unionByName(gathered(docs.filter(held), text_col, order).filter("gram is not null").select("gram", zero.alias("n"), F.col("n").alias("m")))
    asked = spool(asked.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "asked")
    logs = scored(asked, order)
    drop_spooled(asked)
    frequent = threshold(logs.withColumnRenamed("uses", "n"), TRIE)
    found = logs.filter(step(F.col("uses")) >= frequent).toArrow()
    known = spark.sparkContext.broadcast(Head.of(*(found[c].to_numpy() for c in ("gram", "log", "uses"))))
    del found
    tokens = counts.filter("token is not null").select("token", "n")
    n, v = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    norm = math.log10(n + 0.5 * (v + 1))
    least = threshold(tokens, HEAD)
    common = tokens.filter(step(F.col("n")) >= least).toArrow()
    head = spark.sparkContext.broadcast((b" ".join(common["token"].to_pylist()), np.log10(common["n"].to_numpy() + 0.5)))
    read = docs.select(F.col(id_col).alias("_sl_id"), held.alias("held_out"), F.col(text_col).alias("_sl_text"))
    kind = read.schema["_sl_id"].dataType.simpleString()
    gram_type = pa.list_(pa.struct([("gram", pa.int64()), ("times", pa.int64())]))
    rare_type = pa.list_(pa.struct([("token", pa.binary()), ("tf", pa.int64())]))
    key = uuid.uuid4().hex

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = head_logs(head, key).get
        end = get(b"")
        for b in batches:
            found = texts(b["_sl_text"])
            rows, rare = [], []
            for t in found:
                words = t.lower().split()
                logs = list(map(get, words))
                new = Counter([w for w, x in zip(words, logs, strict=True) if x is None]) if None in logs else {}
                logs = [x for x in logs if x is not None] if new else logs
                if end is None:
                    new[b""] = 1
                else:
                    logs.append(end)
                rows.append((len(words) + 1, len(logs), math.fsum(logs)))
                rare.append([{"token": w, "tf": c} for w, c in new.items()])
            sums, unknown, size = [], [], 0
            for some in chunks(found):
                total, text, *others = text_scores(known.value, some, order)
                sums.append(total)
                unknown.append((text + size, *others))
                size += len(some)
            total = np.concatenate(sums or [np.zeros(0)])
            text, gram, times = (np.concatenate(x) for x in zip(*unknown, strict=True)) if unknown else [np.zeros(0, np.int64)] * 3
            pairs = pa.StructArray.from_arrays([pa.array(gram, pa.int64()), pa.array(times, pa.int64())], fields=list(gram_type.value_type))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(size + 1)), pa.int32()), pairs, type=gram_type)
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [b["_sl_id"], b["held_out"], pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()), pa.array(total, pa.float64()), pa.array(rare, rare_type), lists],
                names=["doc_id", "held_out", "n_tokens", "known", "logs", "score", "rare", "grams"],
            )

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, known long, logs double, score double, rare array<struct<token:binary,tf:long>>, grams array<struct<gram:long,times:long>>"
    rows = spool(map_batches(read, work, schema).withColumn("_sl_row", F.monotonically_increasing_id()), "scores")
    each = rows.select("_sl_row", F.explode("rare").alias("r")).select("_sl_row", "r.*")
    others = tokens.filter(step(F.col("n")) < least)
    log = F.when(F.col("n").isNull(), F.lit(math.log10(0.5))).otherwise(F.log10(F.col("n") + 0.5))
    rest = each.join(others, "token", "left").groupBy(F.col("_sl_row").alias("_sl_r")).agg(F.sum(F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0)).alias("more"), F.sum(F.col("tf") * log).alias("rest"))
    used = rows.select("_sl_row", F.explode("grams").alias("g")).select("_sl_row", "g.*")
    further = used.join(logs.filter(step(F.col("uses")) < frequent).select("gram", "log"), "gram").groupBy(F.col("_sl_row").alias("_sl_g")).agg(F.sum(F.col("times") * F.col("log")).alias("further"))
    out = rows.drop("rare", "grams").join(rest, F.col("_sl_row") == F.col("_sl_r"), "left").join(further, F.col("_sl_row") == F.col("_sl_g"), "left")
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more", zero)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("rest", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (F.col("score") + F.coalesce("further", F.lit(0.0))).alias("score"),
    )


def model_scores(docs: DataFrame) -> DataFrame:
    return score(docs, held_out(F.col("doc_id"), 5, 1))
