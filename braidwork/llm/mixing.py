"""Mixing sources to target weights with fixed-length blocks, drawn slot counts and index permutations."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidwork.llm.common import bounded_batches, lean, positions, prefix_sums, source_key, store, text_or_empty

BLOCK_WORDS, SHARDS = 256, 40
WORDS = r"[^\x20\x09-\x0D]+"
#: Sources whose counts one task draws, and the most groups of sources whose counts the driver draws.
CELL_SOURCES, MOST_CELLS = 1000, 1 << 16
#: Slots of a source and shard that one record opens, and rows of a batch of opened slots.
RANGE_SLOTS, BATCH_SLOTS = 1 << 22, 1 << 16


def water_level(sources: DataFrame, budget: float, most: float) -> float:
    """The words for each unit of weight at which the targets, each at most `most` times its source's words, add up to budget.

    Newton's steps on a rising, concave, piecewise straight line: the excess of sources above their bound is shared
    again by weight among the others, until none is above. Each step is one sum over the table of sources.
    """
    level, closed = 0.0, -1
    while True:
        above = F.lit(level) * F.col("weight") > most * F.col("words")
        found = sources.agg(F.count_if(above).alias("n"), F.sum(F.when(above, most * F.col("words"))).alias("held"), F.sum(F.when(~above, F.col("weight"))).alias("weight")).first()
        if found.n == closed or not found.weight:
            return level
        level, closed = (budget - (found.held or 0.0)) / found.weight, found.n


def planned(facts: DataFrame, weights: list[float], share: float, most: float, block_words: int) -> DataFrame:
    """Stored, one row a source: source_key, source (its number by code point, null last), words, target, blocks, passes, rest, slots."""
    sums = facts.groupBy("source_key").agg(F.sum("size").alias("words"))
    ranked = positions(sums, ["source_key"], "source", "mixing-sources")
    turns = F.array(*[F.lit(float(w)) for w in weights])
    weighed = ranked.withColumn("weight", F.get(turns, (F.col("source") % len(weights)).cast("int")))
    total = weighed.agg(F.sum("words")).first()[0] or 0
    level = water_level(weighed, share * total, most)
    aimed = weighed.withColumn("target", F.least(most * F.col("words"), level * F.col("weight"))).withColumn("due", F.rint("target").cast("long"))
    counted = aimed.withColumns(
        {
            "blocks": F.expr(f"(words + {block_words - 1}) div {block_words}"),
            "passes": F.expr("CASE WHEN words > 0 THEN due div words ELSE 0 END"),
        }
    ).withColumn("rest", F.expr("due - passes * words"))
    slots = F.expr(f"passes * blocks + (rest + {block_words - 1}) div {block_words}")
    return store(counted.select("source_key", "source", "words", "target", "blocks", "passes", "rest", slots.alias("slots")), "mixing-plan")


def permute(index: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A seeded pseudorandom permutation of 0 .. size-1, at these indices: a Feistel network, walked until it falls inside."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> np.uint64(half), x & mask
        for r in range(4):
            mixed = (b + np.uint64((seed * 0x9E3779B97F4A7C15 + r * 0xBF58476D1CE4E5B9) & (2**64 - 1))) * np.uint64(0x94D049BB133111EB)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((mixed >> np.uint64(32)) & mask)
        return (a << np.uint64(half)) | b

    out = once(index.astype(np.uint64))
    while (far := out >= np.uint64(size)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def draw_counts(slots: np.ndarray, shards: int, seed: int | list[int], rooms: np.ndarray | None = None) -> np.ndarray:
    """Slots of each source in each shard: multinomial draws in proportion to what each source still has to give.

    Shards hold equally many slots (one more or less), or as many as `rooms` says. A draw beyond what a source has left is drawn again
    among the others, so the counts of a source add up to its slots: multinomial counts given the totals.
    """
    rng, left, rows = np.random.default_rng(seed), slots.astype(np.int64).copy(), []
    total = int(slots.sum())
    for j in range(shards):
        room, row = (j + 1) * total // shards - j * total // shards if rooms is None else int(rooms[j]), np.zeros_like(left)
        while room > 0:
            drawn = np.minimum(rng.multinomial(room, left / left.sum()), left)
            row, left, room = row + drawn, left - drawn, room - int(drawn.sum())
        rows.append(row)
    return np.array(rows, dtype=np.int64).reshape(shards, len(slots))


DRAWN = "shard int, source_key string, source long, low long, high long, words long, blocks long, passes long, rest long"


def drawn_counts(plan: DataFrame, shards: int, seed: int) -> tuple[DataFrame, int]:
    """Slots low to high of each source in each shard (DRAWN), and how many there are: multinomial counts, in two steps.

    Sources are dealt to cells of about CELL_SOURCES. The driver draws how many slots of each cell go to each shard
    (MOST_CELLS times `shards` numbers at most); tasks draw those of a cell's sources, given these. A multinomial
    draw of groups and then within them is a multinomial draw of all.
    """
    spark = plan.sparkSession
    cells = max(1, min(MOST_CELLS, -(-plan.count() // CELL_SOURCES)))
    dealt = plan.where("slots > 0").withColumn("cell", F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(cells)))
    sums = {r.cell: r.slots for r in dealt.groupBy("cell").agg(F.sum("slots").alias("slots")).collect()}
    order = sorted(sums)
    counts = draw_counts(np.array([sums[c] for c in order], dtype=np.int64), shards, seed)
    rooms = spark.createDataFrame([(c, column.tolist()) for c, column in zip(order, counts.T, strict=True)], "cell long, rooms array<long>")

    def draw(sources: pd.DataFrame, room: pd.DataFrame) -> pd.DataFrame:
        sources = sources.sort_values("source", ignore_index=True)
        counts = draw_counts(sources["slots"].to_numpy(), shards, [seed, int(sources["cell"][0])], np.asarray(room["rooms"][0]))
        ends = np.cumsum(counts, axis=0)
        shard, at = np.nonzero(counts)
        out = sources.loc[at, ["source_key", "source", "words", "blocks", "passes", "rest"]].reset_index(drop=True)
        return out.assign(shard=shard, low=(ends - counts)[shard, at], high=ends[shard, at])[[c.split()[0] for c in DRAWN.split(", ")]]

    return dealt.groupBy("cell").cogroup(rooms.groupBy("cell")).applyInPandas(draw, DRAWN), int(counts.sum())


def text_id() -> Column:
    """Parts rows that share an id (null too), so that they spread by their texts."""
    return F.xxhash64(text_or_empty())


def measured(docs: DataFrame, seed: int) -> DataFrame:
    """Stored rows (doc_id, source_key, size, tid, before, total): size in words, hash of the text, place in the source's stream of words."""
    facts = docs.select("doc_id", source_key().alias("source_key"), F.regexp_count(text_or_empty(), F.lit(WORDS)).cast("long").alias("size"), text_id().alias("tid"))
    return store(prefix_sums(facts, "source_key", "size", ["doc_id", "size", "tid"], docs.count(), seed), "mixing-sizes")


def mix(docs: DataFrame, weights: list[float] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: int = 3):
    """(documents, pieces, sources) of a mixture of `share` times all words.

    Sources in code point order, null last, take the weights in turn; targets are filled by weight up to
    `most` times a source's words. Each source's documents, in a seeded order, form a stream of words cut into
    fixed-length blocks. The slots of the mixture are dealt to shards by multinomial counts; slot k of a source
    maps through the source's pseudorandom permutation to a block, whole passes over all blocks first, then
    part of one more pass, whose last slot takes only the words that are still due. Slots and blocks join by
    index. No word is taken more often than ceil(most) times.

    documents: doc_id, source_key, size, tid, before, total. pieces: shard, slot, source_key, block, pass, doc_id,
    size, tid, before, word_start, n_words. sources: source_key, words, target (see planned).

    A null text has no words; documents without words get no piece. A null source is a source of its own.
    Repeated rows are documents of their own. An empty table gives no rows. Other columns are ignored. Sources,
    words, blocks and slots stay distributed; see drawn_counts for what the driver draws.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    facts = measured(docs, seed)
    plan = planned(facts, weights, share, most, block_words)
    counts, total = drawn_counts(plan, shards, seed)

    def blocks_of(row) -> tuple[np.ndarray, ...]:
        k = np.arange(row.low, row.high, dtype=np.int64)
        turn, at = np.divmod(k, max(row.blocks, 1))
        turn, full = np.minimum(turn, row.passes), row.words // block_words
        at = np.where(turn < row.passes, at, k - row.passes * row.blocks)
        block, take = np.empty(len(k), dtype=np.int64), np.full(len(k), block_words, dtype=np.int64)
        for t in np.unique(turn):
            mine, own = turn == t, seed * 1009 + row.source * 31 + int(t)
            if t < row.passes:
                block[mine] = permute(at[mine], row.blocks, own)
            else:
                inside = mine & (at < full)
                block[inside] = permute(at[inside], full, own) if inside.any() else 0
                block[mine & (at >= full)] = full
                take[mine] = np.minimum(block_words, row.rest - at[mine] * block_words)
        return k, block, turn, take

    def open_slots(frames):
        for frame in frames:
            held, n = [], 0
            for row in frame.itertuples(index=False):
                for low in range(row.low, row.high, BATCH_SLOTS):
                    k, block, turn, take = blocks_of(row._replace(low=low, high=min(row.high, low + BATCH_SLOTS)))
                    held.append((np.full(len(k), row.shard), k, np.full(len(k), row.source_key, dtype=object), block, turn, take))
                    n += len(k)
                    if n >= BATCH_SLOTS:
                        yield opened(held)
                        held, n = [], 0
            if n:
                yield opened(held)

    def opened(held) -> pd.DataFrame:
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(("shard", "slot", "source_key", "block", "pass", "take"), zip(*held, strict=True), strict=True)})

    # A record opens RANGE_SLOTS slots at most, so a hot source is dealt to many tasks.
    begin = F.explode(F.sequence(F.col("low"), F.col("high") - 1, F.lit(RANGE_SLOTS)))
    ranges = counts.withColumn("low", begin).withColumn("high", F.least("high", F.col("low") + RANGE_SLOTS))
    held = ranges.repartition(max(1, min(total, spark.sparkContext.defaultParallelism * 2), total // RANGE_SLOTS))
    drawn = held.mapInPandas(open_slots, "shard int, slot long, source_key string, block long, pass long, take long")
    first, last = F.expr(f"before div {block_words}"), F.expr(f"(before + size - 1) div {block_words}")
    parts = facts.where("size > 0").select("doc_id", "source_key", "size", "tid", "before", F.explode(F.sequence(first, last)).alias("block"))
    at = F.greatest("before", F.col("block") * block_words)
    until = F.least(F.col("before") + F.col("size"), F.col("block") * block_words + F.col("take"))
    # Slots grow with the corpus, though Spark takes them for as small as the counts they are opened from: never broadcast them.
    pieces = (
        drawn.hint("merge").join(parts, ["source_key", "block"])
        .withColumn("word_start", at - F.col("before"))
        .withColumn("n_words", until - at)
        .where("n_words > 0")
        .drop("take")
    )
    return facts, pieces, plan


def mixture_counts(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (see mix)."""
    facts, pieces, sources = mix(docs, **options)
    aims = sources.select("source_key", F.col("words").alias("source_size"), "target")
    # A document with words is known by its place; documents without words have no piece.
    row = ["source_key", "before", "size"]
    taken = pieces.groupBy(*row).agg(F.sum("n_words").alias("_taken"))
    joined = facts.join(taken, row, "left").select("doc_id", "size", "source_key", F.coalesce("_taken", F.lit(0)).alias("taken"))
    return joined.join(aims, "source_key").select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture as documents: doc_id, text, lang, source, n_chars, one row for each document and pass it is taken in.

    A row's text is the words taken in that pass, from the whole text with its white space where all are
    taken; else runs of taken words keep theirs, and runs are parted by a line break. Rows that share an id (null
    too) are told apart by their texts; rows alike in id, source and text share out the places of their kind.
    An empty table gives no row.
    """
    _, pieces, _ = mix(docs, **options)
    row = ["source_key", "doc_id", "size", "tid"]
    spans = pieces.groupBy(*row, "before").agg(F.sort_array(F.collect_list(F.struct("pass", "word_start", "n_words"))).alias("spans"))
    spans = spans.withColumn("_nth", F.row_number().over(Window.partitionBy(*row).orderBy("before")))
    spans = spans.select(*[F.col(c).alias(f"_{c}") for c in [*row]], F.col("_nth").alias("_turn"), "spans")
    texts = docs.select("doc_id", "text", "lang", "source", source_key().alias("source_key"), F.regexp_count(text_or_empty(), F.lit(WORDS)).cast("long").alias("size"), text_id().alias("tid"))
    texts = texts.withColumn("_nth", F.row_number().over(Window.partitionBy(*row).orderBy("text", "lang")))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in row] + [F.col("_nth") == F.col("_turn")]
    joined = texts.join(spans, same).select("doc_id", "text", "lang", "source", "size", "spans")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def render(batches):
        import re

        word = re.compile("[^\x20\x09-\x0d]+")
        for batch in batches:
            for part in (batch.slice(low, 200) for low in range(0, batch.num_rows, 200)):
                texts, sizes, spans = part.column(1).to_pylist(), part.column(4).to_pylist(), part.column(5).to_pylist()
                owner, out = [], []
                for i, (text, size) in enumerate(zip(texts, sizes, strict=True)):
                    runs: dict[int, list] = {}
                    for s in spans[i]:
                        of_pass = runs.setdefault(s["pass"], [])
                        if of_pass and of_pass[-1][1] == s["word_start"]:
                            of_pass[-1][1] += s["n_words"]
                        else:
                            of_pass.append([s["word_start"], s["word_start"] + s["n_words"]])
                    places = None
                    for of_pass in runs.values():
                        owner.append(i)
                        if of_pass == [[0, size]]:
                            out.append(text)
                        else:
                            places = places or [m.span() for m in word.finditer(text)]
                            out.append("\n".join(text[places[a][0] : places[b - 1][1]] for a, b in of_pass))
                pick = pa.array(owner, pa.int64())
                columns = [part.column(0).take(pick), pa.array(out, pa.string()), part.column(2).take(pick), part.column(3).take(pick), pa.array([len(t) for t in out], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "lang", "source", "n_chars"])

    return joined.mapInArrow(lean(render), f"doc_id {id_type}, text string, lang string, source string, n_chars long")
