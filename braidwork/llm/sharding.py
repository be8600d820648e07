"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm.common import positions, prefix_sums, source_key, text_or_empty


def interleave(docs: DataFrame, shards: int = 40, seed: int = 9) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, source_key.

    Rows are shuffled by a seeded hash within each source and ranked; the rows of all sources are ordered by
    fractional rank (rank + 1/2) / rows of the source, ties by source, and cut into `shards` runs whose counts
    differ by one at most. Every run then holds each source in proportion. The law is `rows`: grown_shard is
    null, and copies of a text are dealt like any other row.

    A null source is a source of its own. A null text has size 16 and the checksum of no bytes. Repeated rows
    are dealt one by one. Rows are hashed and ordered by id, checksum and size, so rows that share an id (null too)
    spread over the cells by their texts, and a task that runs again places them as before. An empty table gives no
    row. Other columns are ignored.

    Ranks come from hash cells and positions from ranges of (fraction, source, rank), each with a small table of
    running counts, so that neither a hot source, nor many sources of one row each, nor the whole table is ever sorted in one task.
    """
    rows = docs.count()
    facts = docs.select(
        "doc_id",
        source_key().alias("source_key"),
        (F.octet_length(text_or_empty()).cast("long") + 16).alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
        F.lit(1).cast("long").alias("_one"),
    )
    ranked = prefix_sums(facts, "source_key", "_one", ["doc_id", "text_crc32", "size"], rows, seed)
    fraction = ranked.withColumn("_f", (F.col("before") + 0.5) / F.col("total"))
    placed = positions(fraction, ["_f", "source_key", "before"], "_position", "sharding-order")
    return (
        placed.withColumn("shard", F.expr(f"_position * {shards} div {max(rows, 1)}").cast("int"))
        .withColumn("slot", F.col("_position") - F.expr(f"(shard * {rows}L + {shards - 1}) div {shards}"))
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source_key")
    )
