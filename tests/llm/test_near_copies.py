"""Near copies against exact Jaccard similarities of all pairs."""

import random
from collections import Counter
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest
from sparseloom.llm import near_copies, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edited(words, rng, changes):
    """``words`` with that many of them replaced, far enough apart from each other and the ends."""
    out = list(words)
    for at in rng.sample(range(5, len(words) - 5, 7), changes):
        out[at] = f"edit{rng.randrange(10**9)}"
    return out


def table():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(400)}"
    texts = []
    for n, changes in ((100, 1), (100, 2), (200, 3), (200, 4), (400, 7), (400, 8), (100, 3), (200, 9)):
        for _ in range(8):
            base = [word() for _ in range(n)]
            texts += [" ".join(base), " ".join(edited(base, rng, changes))]
    base = [word() for _ in range(300)]
    texts += [" ".join(edited(base, rng, k % 4 + 1)) for k in range(60)]
    passage = [word() for _ in range(60)]  # in many texts that are no copies
    texts += [" ".join([*passage, *[word() for _ in range(20)]]) for _ in range(40)]
    texts += [None, "", " \t", "one two", "ONE two", "one two three", "re re re re re", "re re re re re re"]
    rng.shuffle(texts)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, (None, texts[0], None, None, 1), rows[1]]


def shingle_set(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def kept(rows):
    sets, root = [shingle_set(r[1]) for r in rows], list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            root[top(i)] = top(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(top(i), []).append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


@pytest.mark.parametrize("part", [256, 16])
def test_near_dedup_reaches_a_similarity_of_four_fifths(spark, tmp_path, monkeypatch, part):
    monkeypatch.setattr(near_copies, "PART", part)
    rows = table()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    found = stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()
    assert Counter(map(tuple, found)) == Counter(kept(rows))


def test_near_dedup_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert near_copies.one_of_each_group(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect() == []


def test_candidates_come_from_pivot_tables_only(spark, tmp_path, monkeypatch):
    rows = table()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(near_copies, "bucket_links", lambda rows, counts, radius: rows.selectExpr("node AS a", "node AS b").limit(0))
    found = near_copies.one_of_each_group(spark.read.parquet(f"{tmp_path}/documents.parquet")).count()
    assert found == len({shingle_set(r[1]) for r in rows})  # without their links only equal sets meet


def test_a_group_gives_the_same_links_in_each_of_its_buckets(spark):
    rng = random.Random(9)
    fps = rng.sample([1 << a | 1 << b for a, b in combinations(range(12), 2)], 50)  # four bits apart at most
    rows = spark.createDataFrame([(i, f, bucket) for bucket in range(20) for i, f in enumerate(fps)], "node long, fp long, bucket long")
    found = simhash.bucket_links(rows, rows.groupBy("bucket").count(), 4).collect()
    assert sorted(map(tuple, found)) == [(i, 0) for i in range(1, 50)]
    # Some of the group in each bucket: what connects them is of the group's size still, not of the buckets'.
    some = rows.filter("(node * 31 + bucket * 17) % 10 > 0 OR node = 0")
    assert simhash.bucket_links(some, some.groupBy("bucket").count(), 4).count() == 49


def test_fingerprints_are_weighted_votes_and_reach_four_fifths():
    rng, mixers = np.random.default_rng(5), near_copies.multipliers()
    bits = lambda words: np.unpackbits(words.astype("<u8").view(np.uint8).reshape(len(words), -1), axis=1).astype(int)
    draw = lambda n: rng.integers(0, 1 << 64, n, np.uint64, endpoint=False)
    for n in (1, 2, 4, 5, 100, 2 * near_copies.CHUNK + 7):
        some = draw(n)
        low, high = (bits(near_copies.drawn_words(some, *mixers[:, k])) for k in range(2))
        assert (bits(near_copies.prints(some, mixers)[None])[0] == ((2 * low + 4 * high - 3).sum(axis=0) > 0)).all()
    for a, b, common in ((4, 5, 4), (9, 9, 8), (16, 20, 16), (100, 100, 89)):
        missed = 0
        for _ in range(100):
            some = draw(a + b - common)
            apart = near_copies.prints(some[:a], mixers) ^ near_copies.prints(some[a - common :], mixers)
            shared = [(apart >> np.uint64(k * near_copies.BITS) & np.uint64((1 << near_copies.BITS) - 1)) == 0 for k in range(near_copies.BLOCKS)]
            missed += not (np.any(shared, axis=0) & (np.bitwise_count(apart) <= near_copies.RADIUS)).any()
        assert missed <= 2, (a, b, common)
