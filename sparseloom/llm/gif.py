"""GIF as a column: byte payloads stored as indexed frames, and a decoder to timed frames.

The encoder writes 8-bit palette indices as frames of WIDTH pixels a row and at most ROWS rows,
LZW-coded with a table that is not cleared before the frame ends, under a palette of 256 greys. The decoder reads any GIF87a or GIF89a: code
streams with any minimum code size, deferred clears, interlacing, global and local palettes,
transparency and the four disposal rules. It gives, per frame, its time, delay, place and
composed pixels, with a histogram column for each colour.

Code widths follow from a code's number since the last clear, so all codes up to a clear are
unpacked at once, and both directions work on whole runs of codes instead of one after another.

Stored media of the query are released part by part, as their frames are written, so both never lie on disk
as a whole at once.

Cases: null and empty texts store one row of 64 zeros; equal texts and repeated rows give equal bytes, each in
rows of their own; a very long text makes many frames; a frame is clipped to the screen, and may have nothing
left; a stream that breaks the format, or claims a screen or frame of over MOST pixels, raises ValueError in
decode(), and is a row with an ``error`` in frames(), after the frames before it; an empty table gives no rows;
other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete_files, map_batches, new_path, spread, texts

WIDTH, ROWS, DELAY = 64, 1024, 10  # pixels, rows, hundredths of a second
BINS = 16
TABLE = 4096  # LZW codes at most
#: Pixels that a screen or a frame may have: a hostile header claims 17 GB of them.
MOST = 1 << 24
#: Parts in which written media are read back and released.
PARTS = 6


def code_widths(m: int) -> np.ndarray:
    """Width of code n since the clear, for n up to where it stays 12."""
    known = (1 << m) + 2 + np.maximum(np.arange(TABLE) - 1, 0)
    return np.clip(np.floor(np.log2(known)).astype(np.int64) + 1, m + 1, 12)


_WIDTHS = {m: code_widths(m) for m in range(2, 9)}
_ENDS = {m: np.cumsum(w) for m, w in _WIDTHS.items()}


def lzw_encode(data: bytes) -> bytes:
    """An 8-bit code stream for ``data``: literals and two-byte entries, found for a block at a time.

    A code's entry is what it puts out and the byte after that, so literals make entries of two
    bytes. Each block (three times as long as the one before) uses the entries that earlier blocks
    made; once the table is full it stays as it is, and all the rest is one block.
    """
    clear, first = 256, 258
    source = np.frombuffer(data, np.uint8).astype(np.int32)
    entry = np.zeros(1 << 16, np.int16)
    parts, n, at, length = [], 0, 0, 256
    while at < len(source):
        stop = len(source) if n >= TABLE - first else min(len(source), at + length)
        block = source[at:stop]
        pairs = block[: len(block) & ~1].reshape(-1, 2)
        found = entry[pairs[:, 0] << 8 | pairs[:, 1]]
        hit = found > 0
        codes = pairs.copy()
        codes[hit, 0] = found[hit]
        put = np.ones(pairs.shape, bool)
        put[hit, 1] = False
        codes, heads = codes[put], pairs[put]
        if len(block) & 1:
            codes, heads = np.append(codes, block[-1]), np.append(heads, block[-1])
        parts.append(codes)
        if n < TABLE - first and stop < len(source):
            after = np.append(heads[1:], source[stop])
            new = np.flatnonzero(codes < clear)
            new = new[new + n < TABLE - first]
            entry[codes[new] << 8 | after[new]] = first + n + new
        n, at, length = n + len(codes), stop, 3 * length
    values = np.concatenate([[clear], *parts, [clear + 1]])
    widths = np.concatenate([[9], _WIDTHS[8][: n + 1], np.full(max(0, n + 1 - TABLE), 12)])
    ends = np.cumsum(widths)
    bit = ends - widths
    byte, shifted = bit >> 3, values << (bit & 7)
    out = np.zeros((int(ends[-1]) + 7 >> 3) + 2, np.uint8)
    for k in range(3):  # codes have 9 bits or more, so no two of them begin in the same byte
        out[byte + k] |= (shifted >> 8 * k & 255).astype(np.uint8)
    return out[:-2].tobytes()


def expand(codes: np.ndarray, clear: int, most: int) -> np.ndarray:
    """The indices that a run of codes between two clears puts out, up to the code with number ``most`` of them.

    Code j with an entry repeats what code k = entry put out, and one index more: in the output,
    that is the stretch from k's start on. So every output place points back to an earlier one,
    and doubling the pointers ends at the literals.
    """
    first, n = clear + 2, len(codes)
    k = codes - first
    far = np.flatnonzero(k >= 0)
    if not len(far):
        return codes.astype(np.uint8)
    back = k[far]
    if (back >= np.minimum(far, TABLE - first)).any():
        raise ValueError("LZW code before its entry")
    lengths = np.ones(n, np.int64)
    early = far < TABLE - first  # only these have entries of their own
    while True:
        new = lengths[back[early]] + 1
        if (new == lengths[far[early]]).all():
            break
        lengths[far[early]] = new
    lengths[far] = lengths[back] + 1
    starts = np.cumsum(lengths) - lengths
    n = int(np.searchsorted(starts, most))  # a few codes may stand for far more than a frame has
    codes, k, lengths, starts = codes[:n], k[:n], lengths[:n], starts[:n]
    far, back = far[far < n], back[far < n]
    shift = np.zeros(n, np.int64)
    shift[far] = starts[far] - starts[back]
    source = np.arange(int(starts[-1] + lengths[-1])) - np.repeat(shift, lengths)
    while True:
        up = source[source]
        if (up == source).all():
            break
        source = up
    out = np.zeros(len(source), np.uint8)
    literal = k < 0
    out[starts[literal]] = codes[literal]
    return out[source]


def lzw_decode(stream: bytes, m: int, size: int) -> bytes:
    """At most ``size`` indices."""
    clear, end = 1 << m, (1 << m) + 1
    data = np.frombuffer(stream + bytes(4), np.uint8).astype(np.int32)
    total, bit, done, out, run, n = 8 * len(stream), 0, 0, [], [], 0

    def close() -> None:
        nonlocal done, run, n
        if run:
            out.append(expand(np.concatenate(run), clear, size - done))
            done += len(out[-1])
        run, n = [], 0

    while done < size:
        most = (total - bit) // (m + 1) + 1
        widths = _WIDTHS[m][n : n + most] if n < TABLE else np.full(most, 12)
        ends = _ENDS[m][n : n + most] + (bit - (_ENDS[m][n - 1] if n else 0)) if n < TABLE else bit + np.cumsum(widths)
        fit = int(np.searchsorted(ends, total, "right"))
        if not fit:
            break
        at = ends[:fit] - widths[:fit]
        byte = at >> 3
        codes = (data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16) >> (at & 7) & (1 << widths[:fit]) - 1
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else fit
        if stop:
            run.append(codes[:stop])
            n += stop
        bit = int(ends[min(stop, fit - 1)])
        if stop < fit:
            close()
            if codes[stop] == end:
                break
    close()
    return np.concatenate(out).tobytes()[:size] if out else b""


def sub_blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(x := data[i : i + 255])]) + x for i in range(0, len(data), 255)) + b"\0"


GREYS = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


def store(payload: bytes) -> bytes:
    """A GIF whose frames' palette indices are ``payload``, of a multiple of WIDTH bytes."""
    height = min(ROWS, len(payload) // WIDTH)
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, height, 0xF7, 0, 0), GREYS]
    for at in range(0, len(payload), WIDTH * ROWS):
        frame = payload[at : at + WIDTH * ROWS]
        out += [b"\x21\xf9\x04\x04", struct.pack("<H", DELAY), b"\0\0", b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, len(frame) // WIDTH, 0), b"\x08", sub_blocks(lzw_encode(frame))]
    return b"".join(out) + b"\x3b"


@dataclass
class Frame:
    start: int  # hundredths of a second, as is delay
    delay: int
    left: int
    top: int
    width: int
    height: int
    canvas: np.ndarray  # RGBA, a 32-bit word a pixel, of the whole screen after this frame is drawn

    def pixels(self) -> np.ndarray:
        """(height, width, 4) of the frame's own place."""
        part = np.ascontiguousarray(self.canvas[self.top : self.top + self.height, self.left : self.left + self.width])
        return part.view(np.uint8).reshape(self.height, self.width, 4)

    def histogram(self, channel: int) -> np.ndarray:
        """Opaque pixels by the value of a colour, in BINS equal bins."""
        pixels = self.pixels()
        return np.bincount(pixels[..., channel][pixels[..., 3] > 0], minlength=256).reshape(BINS, -1).sum(axis=1)


def row_order(height: int) -> np.ndarray:
    """The rows of an interlaced frame in the order of the stream."""
    return np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(gif: bytes) -> Iterator[Frame]:
    if gif[:6] not in (b"GIF87a", b"GIF89a") or len(gif) < 13:
        raise ValueError("not a GIF")
    screen_w, screen_h, flags, _background, _aspect = struct.unpack_from("<HHBBB", gif, 6)
    at = 13

    def palette(flags: int) -> np.ndarray | None:
        nonlocal at
        if not flags & 0x80:
            return None
        n = 2 << (flags & 7)
        found = np.zeros((256, 4), np.uint8)
        found[:n, :3] = np.frombuffer(gif, np.uint8, 3 * n, at).reshape(n, 3)
        found[:, 3] = 255
        at += 3 * n
        return found.view(np.uint32).ravel()

    def blocks() -> bytes:
        nonlocal at
        found = []
        while n := gif[at]:
            found.append(gif[at + 1 : at + 1 + n])
            at += 1 + n
        at += 1
        return b"".join(found)

    if screen_w * screen_h > MOST:
        raise ValueError("a GIF screen of too many pixels")
    try:
        shared = palette(flags)
        canvas = np.zeros((screen_h, screen_w), np.uint32)  # transparent, as viewers show the background
        clock, delay, disposal, hole = 0, 0, 0, None
        while True:
            kind = gif[at]
            at += 1
            if kind == 0x3B:
                return
            if kind == 0x21:
                label = gif[at]
                at += 1
                body = blocks()
                if label == 0xF9:
                    control, delay, index = struct.unpack("<BHB", body[:4])
                    disposal, hole = control >> 2 & 7, index if control & 1 else None
                continue
            if kind != 0x2C:
                raise ValueError(f"unknown GIF block {kind}")
            left, top, w, h, flags = struct.unpack_from("<HHHHB", gif, at)
            at += 9
            if w * h > MOST:
                raise ValueError("a GIF frame of too many pixels")
            own = palette(flags)
            colours = own if own is not None else shared
            if colours is None:
                raise ValueError("a GIF frame without a palette")
            m = gif[at]
            at += 1
            if not 2 <= m <= 8:
                raise ValueError("GIF code size")
            raw = lzw_decode(blocks(), m, w * h)
            index = np.frombuffer(raw.ljust(w * h, b"\0"), np.uint8).reshape(h, w)
            if flags & 0x40:
                index = index[np.argsort(row_order(h))]
            before = canvas.copy() if disposal == 3 else None
            h, w = max(0, min(h, screen_h - top)), max(0, min(w, screen_w - left))
            index, part = index[:h, :w], canvas[top : top + h, left : left + w]
            drawn = colours[index]
            part[...] = drawn if hole is None else np.where(index == hole, part, drawn)
            yield Frame(clock, delay, left, top, w, h, canvas.copy() if disposal in (2, 3) else canvas)
            clock += delay
            if disposal == 2:
                part[...] = 0
            elif before is not None:
                canvas = before
            delay, disposal, hole = 0, 0, None
    except (IndexError, struct.error) as e:
        raise ValueError("a GIF that breaks off") from e


def frame_rows(gif: bytes) -> Iterator[list]:
    """The values of FRAMES for each frame; last, for a stream that breaks the format, what is wrong."""
    n = 0
    try:
        for f in decode(gif):
            yield [n, 10 * f.start, 10 * f.delay, f.left, f.top, f.width, f.height, f.pixels().tobytes(), *[f.histogram(c).tolist() for c in range(3)], None]
            n += 1
    except ValueError as e:
        yield [n, *[None] * 10, str(e)]


FRAMES = "frame int, start_ms long, delay_ms long, left int, top int, width int, height int, rgba binary, red array<long>, green array<long>, blue array<long>, error string"


def frames(media: DataFrame, key: str, gif_col: str) -> DataFrame:
    """A row per frame of the GIFs in ``gif_col`` (null: none), with its composed pixels and histograms."""
    read = media.select(F.col(key).alias("_sl_key"), F.col(gif_col).cast("binary").alias("_sl_gif")).filter("_sl_gif is not null")
    kind = read.schema["_sl_key"].dataType.simpleString()
    types = [pa.int32(), pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.binary(), *[pa.list_(pa.int64())] * 3, pa.string()]
    names = ["key", *[x.split()[0] for x in FRAMES.split(", ")]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, gif in enumerate(b["_sl_gif"].to_pylist()):
                for row in frame_rows(gif):
                    yield pa.RecordBatch.from_arrays([b["_sl_key"].slice(i, 1), *[pa.array([v], t) for v, t in zip(row, types, strict=True)]], names=names)

    return map_batches(read, work, f"key {kind}, {FRAMES}")


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a GIF."""
    read = docs.select(F.col(id_col).alias("_sl_id"), F.col(text_col).alias("_sl_text"))
    kind = read.schema["_sl_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = texts(b["_sl_text"])
            made = {t: store(t + bytes(-len(t) % WIDTH or (0 if t else WIDTH))) for t in dict.fromkeys(found)}
            yield pa.RecordBatch.from_arrays([b["_sl_id"], pa.array([len(t) for t in found], pa.int64()), pa.array([made[t] for t in found], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return map_batches(read, work, f"doc_id {kind}, n_bytes long, media binary")


def frame_table(media: DataFrame) -> DataFrame:
    """The written table of the frames of ``media``, a spooled table (doc_id, n_bytes, media) whose files are
    deleted as soon as their frames are written; key names the row and holds the media's digests."""
    spark, path = media.sparkSession, new_path(media.sparkSession, "frames")
    files = sorted(media.inputFiles())

    def of(some: DataFrame, part: int) -> DataFrame:
        row = F.struct(F.lit(part).alias("part"), F.monotonically_increasing_id().alias("id"))
        key = F.struct(row.alias("row"), "doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
        return frames(some.select(key.alias("key"), "media"), "key", "media")

    for part in range(min(PARTS, len(files))):
        own = files[part::PARTS]
        of(spark.read.schema(media.schema).parquet(*map(unquote, own)), part).write.option("compression", "zstd").mode("append").parquet(path)
        delete_files(spark, own)
    schema = of(media, 0).schema
    return spark.read.schema(schema).parquet(path) if files else spark.createDataFrame([], schema)


def read_back(shown: DataFrame) -> DataFrame:
    """What the stored frames hold: the payload's digests, the media's, and a feature of the frames."""
    spark, kind = shown.sparkSession, shown.schema["key"].dataType["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None

        def emit() -> pa.RecordBatch:
            values = [key["n_bytes"], size, digest.hexdigest(), zlib.crc32(tail), key["media_bytes"], key["media_sha256"], f"frames={n};ms={end};grey={','.join(map(str, grey.tolist()))}"]
            return pa.RecordBatch.from_arrays([pa.array([key["doc_id"]], doc_type), *[pa.array([v], t) for v, t in zip(values, types, strict=True)]], names=names)

        for b in batches:
            doc_type = b["key"].type.field("doc_id").type
            for k, start, delay, rgba, red, error in zip(*[b[c].to_pylist() for c in ("key", "start_ms", "delay_ms", "rgba", "red", "error")], strict=True):
                if error is not None:
                    raise ValueError(f"stored media that cannot be read back: {error}")
                if key is None or k["row"] != key["row"]:
                    if key is not None:
                        yield emit()
                    key, digest, size, tail, grey, n, end = k, hashlib.sha256(), 0, b"", np.zeros(BINS, np.int64), 0, 0
                payload = rgba[::4]  # all three colours of a grey are its index
                digest.update(payload)
                size, tail, n, end = size + len(payload), payload[-64:], n + 1, start + delay
                grey += np.array(red, np.int64)
        if key is not None:
            yield emit()

    wanted = shown.select("key", "frame", "start_ms", "delay_ms", "rgba", "red", "error")
    one = F.col("key.n_bytes") <= WIDTH * ROWS
    # Only the frames of longer texts have to be brought together.
    many = wanted.filter(~one).repartition(spread(spark), F.col("key.row")).sortWithinPartitions("key.row", "frame")
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_batches(wanted.filter(one), work, schema).unionByName(map_batches(many, work, schema))


def text_media(docs: DataFrame) -> DataFrame:
    """The registered query's columns; media and frames are written and read back."""
    media = stored(docs)
    path = new_path(docs.sparkSession, "media")
    media.write.option("compression", "zstd").parquet(path)
    return read_back(frame_table(docs.sparkSession.read.schema(media.schema).parquet(path)))
