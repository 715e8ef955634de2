"""The pipeline, stage by stage and as a whole, against brute-force versions on a small table;
and the classifier's accuracy on rows that it did not learn from."""

import os
import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from sparseloom.llm import mixing, packing, quality
from sparseloom.llm.common import documents
from test_near_copies import kept
from test_operators import lower, naive_targets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, target double, fp long"
TABLES = "/root/testdata/sf0.01"


def table():
    rng = random.Random(11)
    words = [a + b for a in ("ba", "ko", "mi", "ru", "te", "É") for b in ("lan", "dor", "vis", "nu", "pel")]
    good = [" ".join(rng.choices(words, k=rng.randrange(30, 400))) for _ in range(120)]
    bad = [" ".join(rng.choices(["$$$", "BUY!!", "#1", "0000", "|"], k=rng.randrange(20, 80))) for _ in range(40)]
    copies = [t.upper() if t.isascii() else t for t in good[:6]] + [good[7]] * 3
    near = [t + " balan" for t in good[10:16]] + ["kodor " + t for t in good[16:22]]
    texts = [*good, *bad, *copies, *near, None, "", " \t", " ".join(rng.choices(words, k=6000))]
    rows = [(i, t, "en", "hot" if i % 3 == 0 else ["s1", "s2", "s3", None][i % 4], len(t or ""), 1, 2.0, None) for i, t in enumerate(texts)]
    labels = [(i, int(i < 120), 0) for i in range(160)]
    return rows + [(None, "no id " + good[30], None, "s1", 5, None, None, 4)], labels


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows, labels = table()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def data(text):
    return (text or "").encode()


def naive_good(rows, labels):
    """Rows that 25 neighbours' votes, one document at a time, give at least the threshold."""
    text_of = {r.doc_id: data(r.text) for r in rows}
    learned = sorted((i, q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 4 != 2 and i in text_of)
    voters = quality.fit(np.array([quality.features(text_of[i]) for i, _ in learned], np.float32), np.array([q for _, q in learned], float))
    kept = []
    for r in rows:
        x = voters.latent(np.array([quality.features(data(r.text))], np.float32))[0].astype(float)
        cosines = voters.vectors.astype(float) @ x
        top = np.argsort(-cosines)[: quality.NEAREST]
        votes = np.maximum(cosines[top], 0) ** quality.POWER
        score = (votes * voters.labels[top]).sum() / votes.sum() if votes.sum() else voters.prior
        if score >= 0.7:
            kept.append(r)
    return kept


def order(row):
    return -1 if row.doc_id is None else row.doc_id


def naive_exact(rows):
    last = {lower(data(r.text)): r for r in sorted(rows, key=order)}
    return list(last.values())


def naive_near(rows):
    """One row of each group that similarities of 0.8 or more on 5-word shingles connect."""
    return [r[2] for r in kept([(r.doc_id, r.text, r) for r in rows])]


def is_part(few, many):
    """Whether the words ``few`` occur in ``many`` in this order."""
    left = iter(many)
    return all(w in left for w in few)


def check_mix(before, after):
    words = {r.doc_id: data(r.text).split() for r in before}
    source = {r.doc_id: r.source for r in before}
    sizes, by_doc, by_source = Counter(), Counter(), Counter()
    for i, w in words.items():
        sizes[source[i]] += len(w)
    for r in after:
        own = data(r.text).split()
        assert own and is_part(own, words[r.doc_id])
        assert r.n_chars == len(r.text) and r.source == source[r.doc_id]
        by_doc[r.doc_id] += len(own)
        by_source[r.source] += len(own)
    assert all(n <= mixing.MOST * len(words[i]) for i, n in by_doc.items())
    for s, target in naive_targets(sizes).items():
        assert abs(by_source[s] - target) <= mixing.BLOCK + 1


def naive_pieces(rows):
    from tokenizers import Tokenizer

    tokenizer, want = Tokenizer.from_file(packing.tokenizer_path()), Counter()
    for r in rows:
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for start, length in packing.cut_points(len(ids), packing.WINDOW, packing.PIECE):
            want[r.doc_id, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids)] += 1
    return want


def check_windows(pieces):
    loads, at = Counter(), {}
    for p in pieces:
        loads[p.sequence_id] += p.length
        at.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert max(loads.values()) <= packing.WINDOW
    for spans in at.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))]


def test_pipeline(spark, sf_dir):
    naive = {"quality": lambda rows: naive_good(rows, table()[1]), "exact_dedup": naive_exact, "near_dedup": naive_near}
    docs, names = documents(spark, sf_dir), [n for n, _ in corpus_pipeline.STAGES]
    assert names == [*naive, "mixing", "packing"]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = corpus_pipeline.spool(stage(spark, docs, sf_dir), name)
        after = docs.collect()
        if name in naive:
            assert docs.columns == columns
            assert Counter(map(tuple, after)) == Counter(map(tuple, naive[name](before))), name
            assert 0 < len(after) < len(before)
        elif name == "mixing":
            assert docs.columns == columns
            check_mix(before, after)
            mixed = after
    pieces = naive_pieces(mixed)
    fixed = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert Counter(map(tuple, docs.select(*fixed).collect())) == pieces
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(tuple(r[c] for c in fixed) for r in whole) == pieces
    check_windows(whole)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
def test_quality_on_held_out_labels(spark):
    scores = quality.quality_scores(documents(spark, TABLES), documents(spark, TABLES, "labels"))
    rows = scores.filter("held_out").join(documents(spark, TABLES, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id").collect()
    right = [r.predicted == r.label for r in rows]
    good, bad = [r.score for r in rows if r.label], [r.score for r in rows if not r.label]
    above = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert len(rows) > 50 and np.mean(right) > 0.95 and above > 0.95
