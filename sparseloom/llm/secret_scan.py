"""Secret scans with corpus-wide ownership frequency.

Base spans come from three patterns over the whole text. The method looks at candidates: the
values of base spans and every other token that looks like a credential. Candidates leave the
scan as hashes only; per hash the distinct owners and distinct repositories are counted over
the whole corpus. A candidate that occurs with more than MAX_OWNERS owners or MAX_REPOS
repositories is a widely copied example; one that belongs to few, and looks alive (mixed letters
and digits of enough entropy, no run of a placeholder), is an owner's own credential. Tokens
of the second sort that no base span covers are added, as kind ``owned``; base spans stay
whatever their class, which is reported beside them.

Counting distinct owners needs no group in one task: (hash, owner) and (hash, repository)
pairs are combined before and after the shuffle, then counted by hash.

In ``documents``, the owner is the source and the repository is the pair of source and
language, the closest that the table has.

A hash that a great part of all rows holds is broadcast to its rows instead of dealt to one task.

Cases: a null text is empty; a null owner or repository counts as one of its own; repeated
rows and copies do not raise a count beyond their owners; spans that begin at one place are ordered by kind;
a very long text is scanned whole, in time that grows with its length; an empty table gives no rows; other columns
are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparseloom.plans.hot import hot_limit, join_hot

from .common import FILE, ROW, map_batches, spool, with_locator

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "owned")

#: The same matches as HEX with the short ones dropped; and a test that fails faster than ASSIGN.
HEX_RUN = re.compile(r"[0-9a-f]{32,}")
KEYS = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PLACEHOLDER = re.compile(r"example|sample|dummy|changeme|placeholder|your|xxxx|1234567|abcdefg", re.IGNORECASE | re.ASCII)
MAX_OWNERS, MAX_REPOS, ENTROPY = 2, 4, 3.0


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value), by start and then by kind as listed."""
    found = []
    if KEYS.search(text):
        found += [(*m.span(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(*m.span(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(*m.span(), "hex", m[0]) for m in HEX_RUN.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def looks_alive(value: str) -> bool:
    """Letters and digits, enough entropy, no placeholder."""
    if not any(c.isdigit() for c in value) or not any(c.isalpha() for c in value) or PLACEHOLDER.search(value):
        return False
    counts = np.unique(list(value), return_counts=True)[1] / len(value)
    return float(-(counts * np.log2(counts)).sum()) >= ENTROPY


def candidates(text: str) -> list[tuple[int, int, str, str]]:
    """Base spans, and as kind ``owned`` the other live-looking tokens."""
    found = base_spans(text)
    starts = [s for s, _, _, _ in found]
    ends = list(accumulate((e for _, e, _, _ in found), max))  # the furthest end of the spans so far
    for m in CANDIDATE.finditer(text):
        before = bisect_left(starts, m.end())  # base spans that begin before the token ends
        if (not before or ends[before - 1] <= m.start()) and looks_alive(m[0]):
            found.append((*m.span(), "owned", m[0]))
    return found


def digest(value: str) -> int:
    return int.from_bytes(hashlib.sha256(value.encode()).digest()[:8], "big", signed=True)


SPAN = "array<struct<start:long,end:long,kind:string,hash:long,alive:boolean>>"


def scanned(docs: DataFrame, id_col: str, text_col: str, owner: Column, repository: Column) -> DataFrame:
    """Every row's place, id and candidates, with hashed owner and repository."""
    read = with_locator(docs, [F.col(id_col).alias("_sl_id"), F.col(text_col).alias("_sl_text"), F.xxhash64(owner).alias("owner"), F.xxhash64(repository).alias("repo")])
    schema = read.drop("_sl_text").withColumn("spans", F.lit(None).cast(SPAN)).schema
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("hash", pa.int64()), ("alive", pa.bool_())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in schema]
        for b in batches:
            spans = []
            for text in b["_sl_text"].to_pylist():
                found = candidates(text or "")
                spans.append([{"start": s, "end": e, "kind": kind, "hash": digest(v), "alive": kind == "owned" or looks_alive(v)} for s, e, kind, v in found])
            yield pa.RecordBatch.from_arrays([*[b[n] for n in names[:-1]], pa.array(spans, pa.list_(span))], names=names)

    return map_batches(read, work, schema)


def ownership(spans: DataFrame) -> DataFrame:
    """(hash, owners, repos, times) over the whole corpus."""
    seen = spans.select(F.explode("spans.hash").alias("hash"), "owner", "repo").groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("times"))
    owners = seen.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"), F.sum("times").alias("times"))
    return owners.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repos"), F.sum("times").alias("times"))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """Per row: (_sl_id, FILE, ROW, found): spans by start, then kind, each with owners, repos and class."""
    owner = F.col("source") if owner is None else owner
    repository = F.struct("source", "lang") if repository is None else repository
    rows = spool(scanned(docs, id_col, text_col, owner, repository), "candidates")
    each = rows.select(FILE, ROW, F.explode("spans").alias("s")).select(FILE, ROW, "s.*")
    owned = spool(ownership(rows), "ownership")
    total = owned.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    known = join_hot(each, owned, "hash", "times", hot_limit(docs.sparkSession, total))
    rare = (F.col("owners") <= MAX_OWNERS) & (F.col("repos") <= MAX_REPOS)
    label = F.when(rare & F.col("alive"), "owner-specific").when(rare, "inert").otherwise("widely copied")
    known = known.withColumn("class", label).filter((F.col("kind") != "owned") | (F.col("class") == "owner-specific"))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    # As many spans as a text holds.
    found = known.groupBy(FILE, ROW).agg(F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind", "owners", "repos", "class"))).alias("found"))
    return rows.drop("spans", "owner", "repo").join(found, [FILE, ROW], "left")


def secrets(docs: DataFrame) -> DataFrame:
    """The registered query's columns, with the number of owner-specific spans."""
    found = F.coalesce("found", F.array().cast("array<struct<start:long,rank:long,end:long,kind:string,owners:long,repos:long,class:string>>"))

    def count(field: str, value: str) -> Column:
        return F.size(F.filter(found, lambda s: s[field] == value)).cast("long")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter(found, lambda s: s["kind"] != "owned")
    return secret_spans(docs).select(
        F.col("_sl_id").alias("doc_id"),
        *[count("kind", k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(found).alias("spans"),
        count("class", "owner-specific").alias("n_owner_specific"),
    )
