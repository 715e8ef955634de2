"""A training-data pipeline over ``documents``: filter, deduplicate, mix and pack.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and is written
as Parquet that the next one reads. All but the last return the columns of documents.

Cases, in every stage: null and empty texts are texts without words, scored by the training rows' mean label, equal
to each other, near copies of each other, without words to mix, and just an end token to pack; a null id ranks
last and is never learned from; of repeated rows one stays in exact_dedup; ties are broken by id, then by file and
place; very long texts are read whole; extra columns, whatever their names, are passed through up to the mix; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparseloom.llm import exact_dedup, mixing, near_copies, packing, quality
from sparseloom.llm.common import documents, drop_spooled, spool

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    return quality.good_documents(docs, documents(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts, the row with the largest doc_id stays."""
    return exact_dedup.without_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup: SimHash links by pivot distance tables; of each group of them that a Jaccard similarity of 0.8 or more
    of five-word shingles holds together, one document stays."""
    return near_copies.one_of_each_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: the words that each pass takes of a document, as a row of their own."""
    return mixing.mixed_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: one row per piece of a document's tokens. Workers have served the stages before, so they remember fewer words."""
    return packing.pack_documents(docs, remember=400_000)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Models, hashes, seeded draws and tokenizers are not SQL's; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, spool(stage(spark, docs, sf_dir), name)
        drop_spooled(before)  # the input stays: only tables that spool() wrote are dropped
    return STAGES[-1][1](spark, docs, sf_dir)
