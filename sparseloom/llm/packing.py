"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

Documents are tokenized once. Every full window of a document is a sequence of its own; what
remains is cut into pieces of at most ``piece`` tokens. Pieces are dealt into groups of about
GROUP by a hash, whatever document they come from, and each group is packed by itself: the
pieces, as partial partitions into k windows, are merged by largest difference first, the
fullest windows of one with the emptiest of the other, which leaves windows of nearly equal
load. k starts at the least count that could hold the tokens and rises until no window exceeds
its capacity.

Token ids: white space separates words before the tokenizer's model sees them, so a text's ids
are those of its ASCII-space-separated words, one after another. Workers keep the ids of words
they have met and hand the tokenizer only new ones; after a read with which there are more than ``remember``
of them, they begin anew.

Cases: null and empty texts are just the end token; repeated rows and null ids are packed as
rows of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import os
import re
import string
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, spool, texts

WINDOW, END, TOKENIZER = 2048, 1, "word_bpe_49k.json"
#: Tokens in a piece of a remainder, pieces in a group, words that a worker remembers unless told otherwise, bytes of text that it looks up at once.
PIECE, GROUP, CACHE, READ = 512, 800, 1_000_000, 1 << 20
#: ASCII punctuation that may stand around a word; not the apostrophe, with which contractions begin, nor what opens a special token.
AROUND = string.punctuation.replace("'", "").replace("<", "").encode()
#: The tokenizer lower-cases. A-Z may be so before, but not in what may turn into a special token, nor
#: before combining marks (first bytes CC and CD), which may compose with one case of a letter only.
AS_IS = re.compile(rb"<\||[\xcc\xcd]")


class WordIds(dict):
    """UTF-8 word without ASCII spaces -> its ids as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        end = self.tokenizer.model.end_of_word_suffix or ""
        n = self.tokenizer.get_vocab_size()
        self.lengths = np.array([len((self.tokenizer.id_to_token(i) or "").removesuffix(end)) for i in range(n)], np.int64)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[bytes]) -> None:
        """Learn ``words``, those with what may be a special token one by one.

        Punctuation around a word is a token run of its own where it meets an ASCII letter or digit, so
        such a word's ids are put together from those of its parts.
        """
        alone, parts, framed = [], {}, []
        for w in words:
            core = w.strip(AROUND)
            if b"<" in w:
                alone.append(w)
            elif len(core) < len(w) and core[:1].isalnum() and core[-1:].isalnum():
                at = len(w) - len(w.lstrip(AROUND))
                framed.append((w, pieces := (w[:at], core, w[at + len(core) :])))
                parts.update(dict.fromkeys(pieces))
            else:
                parts[w] = None
        self[b""] = b""
        self.learn_parts([w for w in parts if w not in self])
        for w, ids in zip(alone, self.ids([w.decode() for w in alone]), strict=True):
            self[w] = ids.tobytes()
        for w, pieces in framed:
            self[w] = b"".join([self[x] for x in pieces])

    def learn_parts(self, words: list[bytes]) -> None:
        """Words go to the tokenizer many at a time: the bytes that ids stand for tell where each word ends.

        Where the ends don't meet, as with white space that is not ASCII's, they go one by one.
        """
        for at in range(0, len(words), 512):
            some = words[at : at + 512]
            joined = b" ".join(some).decode()
            ids = self.ids([joined])[0]
            shown = joined.lower() if joined.isascii() else unicodedata.normalize("NFC", joined).lower()
            goals = np.cumsum(np.array([len(x) for x in shown.encode().split(b" ")], np.int64))
            ends = np.cumsum(self.lengths[ids])
            if len(goals) == len(some) == len(shown.split()) and len(ends) and ends[-1] == goals[-1] and (ends[(cuts := np.searchsorted(ends, goals) + 1) - 1] == goals).all():
                data, last = ids.tobytes(), 0
                for w, cut in zip(some, cuts.tolist(), strict=True):
                    self[w] = data[4 * last : 4 * cut]
                    last = cut
            else:
                for w, own in zip(some, self.ids([w.decode() for w in some]), strict=True):
                    self[w] = own.tobytes()

    def encode(self, batch: list[bytes], remember: int = CACHE) -> Iterator[bytes]:
        """The ids of each text. Texts are read some at a time, since a call of the tokenizer has a price of its own."""
        sizes = np.cumsum([len(t) for t in batch]) // READ
        for at, end in zip(starts := [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist()], [*starts[1:], len(batch)], strict=True):
            split = [(t if AS_IS.search(t) else t.lower()).split() for t in batch[at:end]]
            new: dict[bytes, None] = {}
            for words in split:
                found = list(map(self.get, words))
                if None in found:
                    new.update(dict.fromkeys([w for w, ids in zip(words, found, strict=True) if ids is None]))
            if new:
                self.learn(list(new))
            for words in split:
                yield b"".join(list(map(self.get, words)))
            if len(self) > remember:  # now, since the next read may be another query's, much later
                self.clear()


_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _IDS:
        _IDS[path] = WordIds(path)
    return _IDS[path]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def cut_points(n: int, window: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole windows, then near-equal parts of the rest."""
    full, rest = divmod(n, window)
    parts = -(-rest // piece)
    edges = [full * window + rest * i // parts for i in range(parts + 1)] if parts else []
    return [(i * window, window) for i in range(full)] + [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def token_pieces(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, piece: int = PIECE, remember: int = CACHE) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): the pieces of all documents. ``path``: None
    for the default tokenizer, found on the executor itself. ``remember``: words that a worker keeps, 150 bytes each or so."""
    read = docs.select(F.col(id_col).alias("_sl_id"), F.col(text_col).alias("_sl_text"))
    id_type = read.schema["_sl_id"].dataType.simpleString()
    end = np.array([END], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(path or tokenizer_path())
        for b in batches:
            at, rows = [], []
            for i, ids in enumerate(ids_of.encode(texts(b["_sl_text"]), remember)):
                ids += end
                n = len(ids) // 4
                for start, length in cut_points(n, window, piece):
                    at.append(i)
                    rows.append((start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n))
            columns = np.array(rows, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b["_sl_id"].take(pa.array(at, pa.int64())), *[pa.array(columns[:, k].copy()) for k in range(4)]], names=names)

    return map_batches(read, work, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long")


def differencing(sizes: list[int], k: int) -> list[int]:
    """The window, from 0 to k-1, of each item, by multiway differencing.

    A partial partition is a list of (load above the least window's, items), ascending, of the
    windows that hold items. Items are kept as nested pairs until the end.
    """
    heap: list[tuple[int, int, list]] = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        clash = len(a) + len(b) - k  # that many windows of either meet one of the other
        if clash <= 0:
            merged = sorted(a + b, key=lambda x: x[0])
            least = merged[0][0] if len(merged) == k else 0
        else:
            # The fullest of a has the emptiest of b; where b's windows run out, a's stand alone.
            low_a, low_b = a[:clash], b[:clash][::-1]
            merged = sorted([(x[0] + y[0], (x[1], y[1])) for x, y in zip(low_a, low_b, strict=True)] + a[clash:] + b[clash:], key=lambda x: x[0])
            least = merged[0][0]
        kept = [(s - least, items) for s, items in merged]
        heapq.heappush(heap, (-kept[-1][0], serial, kept))
        serial += 1
    out = [0] * len(sizes)
    for window, (_, items) in enumerate(heap[0][2] if heap else []):
        stack = [items]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack.extend(x)
            else:
                out[x] = window
    return out


def pack(sizes: list[int], capacity: int) -> list[int]:
    """The window of each item; as few more windows than the tokens need as let none exceed ``capacity``."""
    total = sum(sizes)
    k = max(1, -(-total // capacity))
    while True:
        windows = differencing(sizes, k)
        loads = np.bincount(windows, weights=sizes, minlength=k)
        over = loads.max(initial=0) - capacity
        if over <= 0:
            return windows
        k += max(1, int(k * over / capacity / 4))


def packed(pieces: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """``pieces`` with sequence_id and offset; a sequence's id is the number of its first piece."""
    rows = spool(pieces.withColumn("_sl_piece", F.monotonically_increasing_id()), "pieces")
    whole = rows.filter(F.col("length") == window).withColumn("sequence_id", F.col("_sl_piece"))
    rest = rows.filter(F.col("length") < window)
    groups = max(1, round(rest.count() / group))
    dealt = rest.select("_sl_piece", "length", F.pmod(F.xxhash64("_sl_piece"), F.lit(groups)).alias("_sl_group"))

    def one(found: pa.Table) -> pa.Table:
        found = found.sort_by("_sl_piece")
        sizes = found["length"].to_numpy()
        windows = np.array(pack(sizes.tolist(), window), np.int64)
        first = {}
        names = found["_sl_piece"].to_numpy()
        for n, w in zip(names.tolist(), windows.tolist(), strict=True):
            first.setdefault(w, n)
        return pa.table({"_sl_p": names, "sequence_id": np.array([first[w] for w in windows.tolist()], np.int64)})

    placed = dealt.groupBy("_sl_group").applyInArrow(one, "_sl_p long, sequence_id long")
    in_order = Window.partitionBy("sequence_id").orderBy("_sl_piece").rowsBetween(Window.unboundedPreceding, -1)
    ordered = rest.join(placed, F.col("_sl_piece") == F.col("_sl_p")).drop("_sl_p").withColumn("offset", F.coalesce(F.sum("length").over(in_order), F.lit(0).cast("long")))
    return whole.withColumn("offset", F.lit(0).cast("long")).unionByName(ordered).drop("_sl_piece")


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    """The registered query's columns, one row per piece."""
    return packed(token_pieces(docs, **options))
