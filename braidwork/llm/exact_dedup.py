"""Exact deduplication through an extendible-hash index on shared files, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidwork.llm.common import BROADCAST_IDS, SPACE, store, text_or_empty

FIRST_DEPTH, LAST_DEPTH = 8, 16


def normalised(name: str = "text"):
    """Each run of white space becomes one space; single spaces are left alone, so that few matches are replaced."""
    return F.regexp_replace(text_or_empty(name), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def directory(keys: DataFrame, capacity: int) -> DataFrame:
    """The index's directory: one row for each used 16-bit key prefix, with its bucket and local depth.

    The directory starts at FIRST_DEPTH bits. A bucket of more than `capacity` distinct keys is split on its
    next bit, again and again up to LAST_DEPTH; each split beyond the deepest so far doubles the directory.
    The table holds 65,536 rows at most, whatever the corpus. A bucket that is overfull at LAST_DEPTH stays whole:
    results don't change, only its chains are spread over more tasks by key.
    """
    counts = keys.select("key64").distinct().groupBy(key_prefix().alias("prefix")).agg(F.count("*").alias("n"))
    top = counts.withColumn("_top", F.shiftright("prefix", LAST_DEPTH - FIRST_DEPTH))
    depth = F.lit(LAST_DEPTH)
    for d in range(LAST_DEPTH - 1, FIRST_DEPTH - 1, -1):
        at = F.shiftright("prefix", LAST_DEPTH - d)
        held = F.sum("n").over(Window.partitionBy("_top", at))
        depth = F.when(held <= capacity, F.lit(d)).otherwise(depth)
    split = top.withColumn("depth", depth)
    bucket = F.expr(f"shiftleft(shiftright(prefix, {LAST_DEPTH} - depth), {LAST_DEPTH} - depth)")
    return split.select("prefix", bucket.alias("bucket"), "depth")


def key_prefix():
    return F.shiftrightunsigned("key64", 64 - LAST_DEPTH).cast("int")


def routed(rows: DataFrame, guide: DataFrame) -> DataFrame:
    """rows with the bucket that the directory names for their keys; without a directory entry a key can't be in the index."""
    return rows.withColumn("prefix", key_prefix()).join(F.broadcast(guide.select("prefix", "bucket")), "prefix").drop("prefix")


def build_index(entries: DataFrame, guide: DataFrame) -> DataFrame:
    """Index files, stored: bucket, key64, chain, digest, keep_id, group_size.

    Entries go to their buckets. In a bucket, records of one key are compared by their bytes, since the text is a
    part of what is grouped; texts that differ under one key form a chain. Copies meet in the partial aggregation
    ahead of the shuffle, so a hot text sends one record from each task.
    """
    owned = routed(entries.select("key64", "norm", "digest", "doc_id"), guide).groupBy("bucket", "key64", "norm", "digest")
    records = owned.agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).drop("norm")
    chain = F.row_number().over(Window.partitionBy("bucket", "key64").orderBy("digest"))
    return store(records.select("bucket", "key64", chain.alias("chain"), "digest", "keep_id", "group_size"), "dedup-index")


def look_up(entries: DataFrame, guide: DataFrame, index: DataFrame) -> DataFrame:
    """Each entry with what the index holds for it: found by bucket and key, then along the chain by digest."""
    return routed(entries.drop("norm"), guide).join(index, ["bucket", "key64", "digest"])


def exact_entries(docs: DataFrame, capacity: int = 1 << 18) -> DataFrame:
    """As `exact_groups`, with tid, a hash of the text as it was."""
    text = text_or_empty()
    keyed = docs.select("doc_id", F.xxhash64(text).alias("tid"), normalised().alias("norm"))
    keyed = keyed.select("doc_id", "tid", "norm", F.xxhash64("norm").alias("key64"), F.unhex(F.sha2("norm", 256)).alias("digest"))
    entries = store(keyed, "dedup-entries")
    guide = store(directory(entries, capacity), "dedup-directory")
    return look_up(entries, guide, build_index(entries, guide)).select(
        "doc_id",
        "tid",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "bucket",
        "chain",
    )


def exact_groups(docs: DataFrame, capacity: int = 1 << 18) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain.

    Texts are equal when identical after every run of `[\\x20\\x09-\\x0D]` is replaced by one space; null counts
    as empty. The smallest doc_id of equal texts stays; a null doc_id loses to any other, and a group of only
    null ids keeps the null. Rows repeated with the same doc_id all count and share one decision. An empty table
    gives no row, and other columns are ignored.

    1. Each text becomes an index entry (64-bit key, digest, normalised text, doc_id), written to the shared folder.
    2. The entries' distinct keys fill the directory; overfull buckets split and the directory doubles.
    3. The directory routes entries to buckets, which are ranges of keys; there bytes are compared and chains made.
    4. Chains are written as index files; every entry looks its record up by bucket, key and digest.
    """
    return exact_entries(docs, capacity).drop("tid")


def drop_copies(docs: DataFrame, capacity: int = 1 << 18) -> DataFrame:
    """The documents that stay.

    Decided row by row: of rows that share a doc_id (null too) each goes or stays with its own text. Rows alike in
    both share the decision.
    """
    gone = exact_entries(docs, capacity).where("NOT kept").select(F.col("doc_id").alias("_gone"), F.col("tid").alias("_tid")).distinct()
    gone = store(gone, "dedup-gone")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, F.col("doc_id").eqNullSafe(F.col("_gone")) & (F.xxhash64(text_or_empty()) == F.col("_tid")), "left_anti")


ORACLE_EXACT = f"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[{SPACE}]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
