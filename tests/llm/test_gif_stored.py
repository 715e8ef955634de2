"""The media query writes its media and its timed frames, and reads the digests from them."""

import glob

from sparseloom.llm import gif
from sparseloom.plans.storage import shared_dir


def test_media_and_frames_are_written(spark):
    texts = ["a" * 10, None, "xyz " * 60_000]
    folder = shared_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/sparseloom-*"))
    rows = {r.doc_id: r for r in gif.text_media(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    made = {p.rpartition("-")[2]: p for p in set(glob.glob(f"{folder}/sparseloom-*")) - before}
    assert {"media", "frames"} <= set(made)
    frames = spark.read.parquet(made["frames"]).collect()
    for i, t in enumerate(texts):
        own = sorted((f for f in frames if f.key.doc_id == i), key=lambda f: f.frame)
        padded = (t or "").encode() + bytes(-len(t or "") % 64 or (0 if t else 64))
        assert b"".join(bytes(f.rgba)[::4] for f in own) == padded
        assert [f.start_ms for f in own] == [100 * n for n in range(len(own))]
        assert sum(sum(f.green) for f in own) == sum(sum(f.blue) for f in own) == len(padded) == rows[i].payload_bytes
        assert rows[i].feature.startswith(f"frames={len(own)};ms={100 * len(own)};")
    assert rows[2].feature.startswith("frames=4;")
