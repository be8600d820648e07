"""Repeated byte strings removed by sorting suffixes: sampled splitters, buckets, multikey quicksort."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm.common import Shared, bounded_batches, lean, positions, store, text_or_empty
from braidwork.llm.textbytes import Rolling, bytes_of, mix64, parts

LENGTH = 100
#: Bytes of a suffix's leading token. A string of LENGTH bytes holds LENGTH - GRAM + 1 such tokens.
GRAM = 32
#: Two strings of LENGTH bytes that share a leading token share this much left of it, or else RIGHT from it on.
LEFT = (LENGTH - GRAM) // 2
RIGHT = LENGTH - LEFT + 1
#: Suffixes that a task combines, and about how many a bucket sorts.
BLOCK_ROWS = 1_000_000
BUCKET_ROWS = 600_000
#: Contexts of one token up to which they are compared by the task that gets the token; strings of more common tokens are spread by their own hash.
TOGETHER = 128
#: Contexts whose strings are held at a time.
CONTEXTS = 8_000
#: Suffixes sampled for each bucket's splitter.
SAMPLED = 100
#: A token with so many of the sampled suffixes would fill a good part of a bucket: its suffixes are dealt by context.
HEAVY = 25


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbouring values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    return np.minimum(out[: len(values) - width + 1], out[width - have :][: len(values) - width + 1]) if width > have else out


#: Seed of the second hash: strings count as equal only if both 64-bit hashes of their bytes are.
CHECK = 1


def suffixes(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """The suffixes that stand for all strings of `length` bytes: (token, context, text, packed).

    Each string is represented by the suffix at its least token (by hash, the leftmost of equals), so equal
    strings are represented by equal suffixes at equal places, wherever they stand. Neighbouring strings mostly
    share theirs: a suffix has a token, the context of all strings it represents (by the second hash, so that
    token and context are 128 bits of its bytes), and packed their first
    start (33 bits), how many follow (7), the token's distance from it (7), and 8 bits each of the hashes of
    what lies LEFT before the token and RIGHT from it on.
    """
    n = len(data)
    none = np.empty(0, dtype=np.uint64)
    if n < length:
        return none, none, none.astype(np.int64), none.astype(np.int64)
    rolling, check = Rolling(data), Rolling(data, CHECK)
    at = np.arange(n - GRAM + 1)
    token = rolling.of(at, at + GRAM)
    ranked = (token & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    least = (sliding_min(ranked, length - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    whole = np.zeros(n - length + 1 + 1, dtype=np.int64)
    low, high = starts[:-1], starts[1:] - length + 1
    fits = high > low
    np.add.at(whole, low[fits], 1)
    np.add.at(whole, high[fits], -1)
    inside = np.cumsum(whole[:-1]) > 0
    place = np.flatnonzero(inside)
    if not len(place):
        return none, none, none.astype(np.int64), none.astype(np.int64)
    anchor = least[place]
    new = np.ones(len(place), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1] + 1)
    begins = np.flatnonzero(new)
    first, last = place[begins], place[np.append(begins[1:], len(place)) - 1]
    anchor = anchor[begins]
    text = np.searchsorted(starts, first, side="right") - 1
    context = check.of(first, last + length) ^ ((anchor - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    own = first.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    left_ok, right_ok = anchor - LEFT >= starts[text], anchor + RIGHT <= starts[text + 1]
    left = np.where(left_ok, rolling.of(np.where(left_ok, anchor - LEFT, 0), anchor + GRAM), own)
    right = np.where(right_ok, rolling.of(anchor, np.where(right_ok, anchor + RIGHT, anchor)), own)
    packed = (first - starts[text]) << 30 | (last - first) << 23 | (anchor - first) << 16 | (left >> np.uint64(56)).astype(np.int64) << 8 | (right >> np.uint64(56)).astype(np.int64)
    return token[anchor], context, text, packed


def multikey_quicksort(keys: list[np.ndarray], small: int = 4096) -> np.ndarray:
    """The order that sorts rows by their tokens: three-way partition by one token, the equal part going on to the next."""
    done, stack = [], [(np.arange(len(keys[0])), 0)]
    while stack:
        rows, depth = stack.pop()
        if len(rows) <= small or depth >= len(keys) - 1:
            done.append(rows[np.lexsort([k[rows] for k in reversed(keys[min(depth, len(keys) - 1) :])])] if len(rows) > 1 else rows)
            continue
        token = keys[depth][rows]
        pivot = np.sort(token[:: max(1, len(token) // 63)])[min(31, (len(token) - 1) // 2)]
        low, same = token < pivot, token == pivot
        stack += [(rows[~low & ~same], depth), (rows[same], depth + 1), (rows[low], depth)]
    return np.concatenate(done) if done else np.empty(0, dtype=np.int64)


def combined(token, context, doc, packed):
    """Rows in sorted order, and which of them have the same token and context as the row before."""
    order = multikey_quicksort([token, context, doc, packed])
    token, context, doc, packed = token[order], context[order], doc[order], packed[order]
    again = np.zeros(len(token), dtype=bool)
    again[1:] = (token[1:] == token[:-1]) & (context[1:] == context[:-1])
    return token, context, doc, packed, again


def bucket_rows(token, context, doc, packed, splitters: np.ndarray, heavy: np.ndarray) -> pa.RecordBatch:
    """Rows for the sort. Of equal suffixes in this block only the earliest goes to its bucket; the others are repeats already."""
    token, context, doc, packed, again = combined(token, context, doc, packed)
    bucket = np.searchsorted(splitters, token, side="right").astype(np.int64)
    if len(heavy):
        bucket = np.where(np.isin(token, heavy), (mix64(context) % np.uint64(len(splitters) + 1)).astype(np.int64), bucket)
    bucket = np.where(again, -1 - np.abs(doc % (len(splitters) + 1)), bucket)
    return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(token.view(np.int64)), pa.array(context.view(np.int64)), pa.array(doc), pa.array(packed)], names=["bucket", "token", "context", "doc", "packed"])


def signed(token: np.ndarray) -> np.ndarray:
    """Longs that sort as these unsigned tokens do, and back."""
    return (token ^ np.uint64(1 << 63)).view(np.int64)


def split_points(sample: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(splitters, heavy tokens) from sampled suffixes (token, doc), which are sorted and counted on the executors.

    The driver gets one token a bucket, and of those with more than HEAVY sampled suffixes at most SAMPLED / HEAVY a bucket.
    """
    placed = positions(sample, ["token", "doc"], "place", "repeats-sample")
    n = max(1, placed.count())
    cut = placed.where(f"place > 0 AND (place * {buckets}) div {n} > ((place - 1) * {buckets}) div {n}").select("token").distinct()
    often = placed.groupBy("token").count().where(F.col("count") > HEAVY).select("token")

    def unsigned(tokens: DataFrame) -> np.ndarray:
        return np.sort(signed(np.asarray(tokens.toArrow().column(0)).view(np.uint64)).view(np.uint64))

    return unsigned(cut), unsigned(often)


ROWS = "bucket long, token long, context long, doc long, packed long"
FOUND = "doc long, low long, high long"


def in_blocks(found, splitters: np.ndarray, heavy: np.ndarray):
    """Combine suffixes, block by block, into rows for the buckets."""
    held, n = [], 0
    for x in found:
        held.append(x)
        n += len(x[0])
        if n >= BLOCK_ROWS:
            yield bucket_rows(*(np.concatenate(c) for c in zip(*held, strict=True)), splitters, heavy)
            held, n = [], 0
    if n:
        yield bucket_rows(*(np.concatenate(c) for c in zip(*held, strict=True)), splitters, heavy)


def sort_bucket(length: int, cuts: Shared):
    """The function that sorts a task's buckets and tells repeats: rows (doc, low, high).

    high below 0 marks a suffix to look into, low its packed place: -1 if few contexts share its token, else -2.

    Splitters are whole leading tokens, so suffixes with equal tokens lie in one bucket, and none have to be
    compared across boundaries. Heavy tokens are the exception: only suffixes of equal context meet here, and
    all that are left go on to be compared string by string.
    """

    def repeats(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        heavy = cuts.value[1]
        rows = pa.Table.from_batches(held)
        bucket = np.asarray(rows.column("bucket"))
        token, context, doc, packed = (np.asarray(rows.column(c)) for c in ("token", "context", "doc", "packed"))
        known = bucket < 0
        out = [(doc[known], packed[known])]
        mine = ~known
        token, context, doc, packed, again = combined(token[mine].view(np.uint64), context[mine].view(np.uint64), doc[mine], packed[mine])
        out.append((doc[again], packed[again]))
        docs, places = (np.concatenate(c) for c in zip(*out, strict=True))
        low = places >> 30
        found = [(docs, low, low + (places >> 23 & 127) + length)]
        first = ~again
        token, doc, packed = token[first], doc[first], packed[first]
        look = np.zeros(len(token), dtype=bool)
        if len(token):
            group = np.cumsum(np.append(False, token[1:] != token[:-1]))
            for side in (packed >> 8 & 255, packed & 255):
                key = group << 8 | side
                order = np.argsort(key, kind="stable")
                same = key[order][1:] == key[order][:-1]
                look[order[1:][same]] = True
                look[order[:-1][same]] = True
        many = np.bincount(group)[group] > TOGETHER if len(token) else look
        if len(heavy) and len(token):
            apart = np.isin(token, heavy)
            look, many = look | apart, many | apart
        found.append((doc[look], packed[look], np.where(many[look], -2, -1)))
        docs, low, high = (np.concatenate(c) for c in zip(*found, strict=True))
        for i in range(0, len(docs), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 18)]) for x in (docs, low, high)], names=["doc", "low", "high"])

    return repeats


STRINGS = "bucket long, token long, check long, doc long, packed long, context binary"


def strings_of(data, starts, rolling, check, text, packed, length):
    """(text, start, hash, second hash) of all strings that these suffixes represent."""
    more = (packed >> 23 & 127) + 1
    owner = np.repeat(text, more)
    start = np.repeat(packed >> 30, more) + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
    begin = starts[owner] + start
    return owner, start, rolling.of(begin, begin + length), check.of(begin, begin + length)


def sort_strings(length: int):
    """The function that sorts strings one by one and tells all but the earliest of equal ones, neighbours joined: rows (doc, low, high)."""

    def repeats(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        token, check, doc, packed = (np.asarray(rows.column(c)) for c in ("token", "check", "doc", "packed"))
        known = np.asarray(rows.column("bucket")) < 0
        context = rows.column("context").combine_chunks()
        alone = np.asarray(context.is_null())
        yield from spans(doc[known], packed[known] >> 30)
        single = alone & ~known
        yield from earliest_stays(token[single].view(np.uint64), check[single].view(np.uint64), doc[single], packed[single] >> 30)
        # Contexts of one token at a time (many tokens together): only these have strings in common.
        order = np.flatnonzero(~alone)
        order = order[np.argsort(token[order], kind="stable")]
        sorted_token = token[order]
        low = 0
        while low < len(order):
            high = min(low + CONTEXTS, len(order))
            high = int(np.searchsorted(sorted_token, sorted_token[high - 1], side="right"))
            some = order[low:high]
            data, starts = bytes_of(context.take(pa.array(some)))
            place = packed[some]
            owner, start, found, second = strings_of(data, starts, Rolling(data), Rolling(data, CHECK), np.arange(len(place)), place & ((1 << 30) - 1), length)
            yield from earliest_stays(found, second, doc[some][owner], (place >> 30)[owner] + start)
            low = high

    def earliest_stays(hashes, second, docs, begin):
        _, _, docs, begin, again = combined(hashes, second, docs, begin)
        yield from spans(docs[again], begin[again])

    def spans(docs, begin):
        order = np.lexsort((begin, docs))
        docs, begin = docs[order], begin[order]
        new = np.ones(len(docs), dtype=bool)
        new[1:] = (docs[1:] != docs[:-1]) | (begin[1:] > begin[:-1] + 1)
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(docs)) - 1
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(docs[at]), pa.array(begin[at]), pa.array(begin[last] + length)], names=["doc", "low", "high"])

    return repeats


def keyed(docs: DataFrame) -> DataFrame:
    """Rows (doc, doc_id, text) with a unique 64-bit doc that sorts like doc_id: doc_id itself where it is unique and not null.

    Else rows are range-partitioned and sorted by doc_id (null last) and text, and numbered; a table in the
    shared folder fixes the numbers.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    integral = docs.schema["doc_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    if integral and rows.select("doc_id").where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count() == 0 and rows.where("doc_id IS NULL").limit(1).count() == 0:
        return rows.select(F.col("doc_id").cast("long").alias("doc"), "doc_id", "text")
    order = [F.col("doc_id").asc_nulls_last(), F.col("text")]
    numbered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("doc", F.monotonically_increasing_id())
    return store(numbered.select("doc", "doc_id", "text"), "repeats-documents")


def without_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left).

    Every byte covered by a string of `length` bytes that also starts earlier, in a document of smaller doc_id
    or earlier in the same one, is removed; strings are judged on the whole input as it was. Null text counts as
    empty; rows that repeat a doc_id are ordered by text, null ids come last. An empty table gives no row; other
    columns are ignored.

    1. Each task finds the suffixes that represent all strings of its texts (see suffixes): about one for each
       thirty bytes. Equal ones in a block of a task are combined, so that a passage however common sends each
       bucket one row from each block.
    2. Sampled splitters range-partition the suffixes by leading token; each bucket is sorted by multikey
       quicksort. Of suffixes with equal token and context all but the earliest are repeats.
    3. Suffixes that share a token but not the whole context meet again string by string, in a second sort.
    4. Spans of a document are merged and cut from its bytes.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = keyed(docs)
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(spark.sparkContext.defaultParallelism * 2, -(-total // (BUCKET_ROWS * 30)))

    def of_texts(batches):
        for batch in batches:
            for piece in parts(batch, 1, 2 << 20):
                data, starts = bytes_of(piece.column(1))
                token, context, text, packed = suffixes(data, starts, length)
                yield token, context, np.asarray(piece.column(0))[text], packed

    def sampled(batches):
        for token, _, doc, _ in of_texts(batches):
            some = slice(None, None, max(1, len(token) // 2000))
            yield pa.RecordBatch.from_arrays([pa.array(signed(token[some])), pa.array(doc[some])], names=["token", "doc"])

    pairs = texts.select("doc", "text")
    part = min(1.0, buckets * SAMPLED * 30 / max(total, 1))
    some = pairs.where(F.pmod(F.xxhash64(F.lit(7), "doc"), F.lit(1 << 20)) < int(part * (1 << 20)))
    cuts = Shared(spark, split_points(some.mapInArrow(lean(sampled), "token long, doc long"), buckets))
    rows = pairs.mapInArrow(lean(lambda batches: in_blocks(of_texts(batches), *cuts.value)), ROWS)
    found = store(rows.repartitionById(buckets, F.pmod("bucket", F.lit(buckets)).cast("int")).mapInArrow(lean(sort_bucket(length, cuts)), FOUND), "repeats-found")

    place = F.struct(F.col("low"), (F.col("high") == -2).alias("many"))
    unsure = found.where("high < 0").groupBy("doc").agg(F.collect_list(place).alias("places"))
    strings = pairs.join(unsure, "doc").select("doc", "text", "places")

    named = ["bucket", "token", "check", "doc", "packed", "context"]

    def of_strings(batches):
        even = (np.arange(1, buckets, dtype=np.float64) / buckets * 2.0**64).astype(np.uint64)
        for batch in batches:
            for piece in parts(batch, 1, 1 << 20):
                data, starts = bytes_of(piece.column(1))
                rolling, check = Rolling(data), Rolling(data, CHECK)
                ids, places = np.asarray(piece.column(0)), piece.column(2)
                count = np.asarray([len(x) for x in places])
                flat = places.flatten()
                packed, many = np.asarray(flat.field("low")), np.asarray(flat.field("many").cast(pa.int8())).astype(bool)
                text = np.repeat(np.arange(piece.num_rows), count)
                few, few_text = packed[~many], text[~many]
                low = starts[few_text] + (few >> 30)
                anchor = low + (few >> 16 & 127)
                token = rolling.of(anchor, anchor + GRAM)
                end = low + (few >> 23 & 127) + length
                raw = data.tobytes()
                contexts = pa.array([raw[a:b] for a, b in zip(low.tolist(), end.tolist(), strict=True)], pa.binary())
                bucket = np.searchsorted(even, mix64(token), side="right").astype(np.int64)  # least tokens are small numbers: spread them
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(token.view(np.int64)), pa.array(np.zeros(len(few), dtype=np.int64)), pa.array(ids[few_text]), pa.array(few), contexts], names=named)
                owner, start, found, second = strings_of(data, starts, rolling, check, text[many], packed[many], length)
                if len(found):
                    rows = bucket_rows(found, second, ids[owner], start << 30, even, found[:0])
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.nulls(rows.num_rows, pa.binary())], names=named)

    again = strings.mapInArrow(lean(of_strings), STRINGS).repartitionById(buckets, F.pmod("bucket", F.lit(buckets)).cast("int")).mapInArrow(lean(sort_strings(length)), FOUND)
    spans = found.where("high >= 0").unionByName(again).groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def removed(batches):
        for batch in batches:
            for piece in parts(batch, 2, 16 << 20):
                data, starts = bytes_of(piece.column(2))
                out = [[] for _ in range(5)]
                spans = piece.column(3)
                for i in range(piece.num_rows):
                    body, runs, cut = data[starts[i] : starts[i + 1]], 0, 0
                    if spans[i].is_valid:
                        flat = spans[i].values
                        change = np.zeros(len(body) + 1, dtype=np.int32)
                        np.add.at(change, np.asarray(flat.field("low")), 1)
                        np.add.at(change, np.asarray(flat.field("high")), -1)
                        gone = np.cumsum(change[:-1]) > 0
                        runs, cut = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), int(gone.sum())
                        body = body[~gone]
                    kept = body.tobytes()
                    for column, value in zip(out, (starts[i + 1] - starts[i], cut, runs, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                        column.append(value)
                columns = [piece.column(1), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string())]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    columns, names = [*columns, pa.array(out[4], pa.binary())], [*names, "kept"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    whole = pairs if texts.columns == ["doc", "text"] else texts
    return whole.join(spans, "doc", "left").select("doc", "doc_id", "text", "spans").mapInArrow(lean(removed), schema)
