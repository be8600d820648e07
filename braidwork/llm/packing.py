"""Mixture-controlled packing: deficit round-robin over source queues fills every window to its token proportions."""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidwork.llm.common import bounded_batches, lean, source_key, store, text_or_empty, worker_state
from braidwork.llm.textbytes import LOWER, bytes_of, mix64, parts, words

CAPACITY, END_ID = 4096, 2
#: Windows of one dealing table; the same table serves all full periods of a phase.
PERIOD = 64
#: Queues that are planned. With more sources, those of least weight are merged into two of these (see rare_places).
MAX_QUEUES = 256
#: Keys of those two; keys of sources begin with 1 or 2.
RARE, RARE_UNWEIGHED = "3", "4"
#: Rows of the table of running sums (about 60 bytes each) up to which it is broadcast; beyond, it is joined by shuffle.
BROADCAST_ROWS = 200_000
#: The lowest so many bytes of a word of eight.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
#: Chunks of text between white space whose ids a worker remembers (some 60 bytes each), unless `remember` says otherwise.
CACHE_CHUNKS = 1_300_000


def deal(share: np.ndarray, left: np.ndarray, windows: int, capacity: int, deficit: np.ndarray, stop_when_dry: bool) -> np.ndarray:
    """Deficit round-robin, window by window: what each queue gives to each window. Changes left and deficit."""
    rows = []
    had = left > 0
    while len(rows) < windows and left.sum() > 0:
        deficit += share * capacity
        take = np.minimum(np.maximum(np.floor(deficit), 0).astype(np.int64), left)
        room = capacity - int(take.sum())
        if room < 0:  # debts paid back at once: cut the largest takes in proportion
            take = apportion(take.astype(float), capacity, take)
            room = 0
        while room > 0 and (more := left - take).sum() > 0:
            first = np.lexsort((np.arange(len(share)), -np.where(more > 0, deficit - take, -np.inf)))
            owed = [q for q in first if more[q] > 0 and deficit[q] - take[q] > 0][:room]
            if owed:
                take[owed] += 1
                room -= len(owed)
            else:
                given = apportion(np.where(more > 0, np.maximum(share, 1e-12), 0), min(room, int(more.sum())), more)
                take += given
                room -= int(given.sum())
        left -= take
        deficit -= take
        rows.append(take)
        if stop_when_dry and (had & (left == 0)).any():
            break
    return np.array(rows, dtype=np.int64).reshape(-1, len(share))


def apportion(weight: np.ndarray, total: int, most: np.ndarray) -> np.ndarray:
    """Integers in proportion to weight that add up to total (largest remainders first), each at most `most`."""
    given = np.zeros(len(weight), dtype=np.int64)
    while (room := total - int(given.sum())) > 0:
        open_ = (given < most) & (weight > 0)
        if not open_.any():
            break
        exact = np.where(open_, weight / weight[open_].sum() * room, 0)
        part = np.minimum(np.floor(exact).astype(np.int64), most - given)
        if part.sum() == 0:
            order = np.argsort(-np.where(open_, exact - np.floor(exact), -1), kind="stable")
            part[[q for q in order if open_[q]][:room]] = 1
        given += part
    return given


def plan_windows(totals: np.ndarray, weights: np.ndarray, capacity: int = CAPACITY, period: int = PERIOD) -> list[dict]:
    """Phases of the dealing, for queues with these token totals.

    While the same queues hold out, every `period` windows are dealt alike by one table; near a queue's end
    windows are dealt singly, then the rest go on without it. Deficits carry over from window to window and
    phase to phase. A phase says where in each queue's stream it begins, how much it takes each time, how
    often, its first window, and for each window the running sums and places.
    """
    left, start, window = totals.astype(np.int64).copy(), np.zeros(len(totals), dtype=np.int64), 0
    deficit, phases = np.zeros(len(totals)), []
    while left.sum() > 0:
        active = left > 0
        share = np.where(active, weights, 0.0)
        share = share / share.sum() if share.sum() > 0 else left / left.sum()
        quota = apportion(share, capacity * period, left)
        full = int(quota.sum()) == capacity * period
        times = int((left[quota > 0] // quota[quota > 0]).min()) if full else 0
        if times:
            takes = deal(quota / quota.sum(), quota.copy(), period, capacity, np.zeros(len(totals)), False)
            deficit += (share * capacity * period - quota) * times
            left = left - quota * times
        else:
            times = 1
            takes = deal(share, left, period, capacity, deficit, True)
        sums = np.vstack([np.zeros(len(totals), dtype=np.int64), np.cumsum(takes, axis=0)])
        places = np.cumsum(takes, axis=1) - takes
        phases.append({"start": start.copy(), "each": sums[-1].copy(), "times": times, "window": window, "windows": len(takes), "sums": sums, "places": places})
        start += sums[-1] * times
        window += len(takes) * times
    return phases


def by_queue(phases: list[dict], q: int) -> tuple[list[int], list[tuple]]:
    used = [p for p in phases if p["each"][q] > 0]
    return [int(p["start"][q]) for p in used], [(int(p["start"][q]), int(p["each"][q]), p["window"], p["windows"], p["sums"][:, q].tolist(), p["places"][:, q].tolist()) for p in used]


def cut(queue: tuple[list[int], list[tuple]], begin: int, n: int):
    """The pieces of n ids that begin at this place of their queue's stream: (start, length, window, place)."""
    done = 0
    while done < n:
        start, each, window, windows, sums, places = queue[1][bisect_right(queue[0], begin + done) - 1]
        period, r = divmod(begin + done - start, each)
        w = bisect_right(sums, r) - 1
        length = min(sums[w + 1] - r, n - done)
        yield done, length, window + period * windows + w, places[w] + r - sums[w]
        done += length


class ChunkTable:
    """Entries of ids, found by chunks of up to 16 bytes: a hash table with open addressing, in arrays.

    A chunk's key is its first eight bytes (zeros behind a shorter one) and its last eight if it has more; as no
    chunk here holds a zero byte, keys are equal exactly where chunks are.
    """

    def __init__(self, dtype: str):
        self.ids, self.offset, self.count = np.zeros(1 << 12, dtype=dtype), np.zeros(1 << 10, dtype=np.int64), np.zeros(1 << 10, dtype=np.int64)
        self.entries = self.filled = 0
        self.one, self.two, self.entry = np.zeros(1 << 10, dtype=np.uint64), np.zeros(1 << 10, dtype=np.uint64), np.full(1 << 10, -1, dtype=np.int32)
        self.keys = 0

    def add(self, new: list[bytes]) -> np.ndarray:
        """Entries for these ids, behind those that count as kept."""
        size = np.array([len(x) for x in new], dtype=np.int64) // self.ids.itemsize
        end = self.filled + int(size.sum())
        while end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.entries + len(new) > len(self.count):
            self.offset, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.offset, self.count))
        at = np.arange(self.entries, self.entries + len(new))
        self.count[at], self.offset[at] = size, self.filled + np.cumsum(size) - size
        self.ids[self.filled : end] = np.frombuffer(b"".join(new), dtype=self.ids.dtype)
        return at

    def keep(self, at: np.ndarray) -> None:
        """Entries just added stay; others are overwritten by the next."""
        if len(at):
            self.entries, self.filled = int(at[-1]) + 1, int(self.offset[at[-1]] + self.count[at[-1]])

    def slots(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return (mix64(one + two * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) & (len(self.entry) - 1)

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Each key's entry, or -1."""
        slot = self.slots(one, two)
        found = self.entry[slot]
        left = np.flatnonzero((found >= 0) & ((self.one[slot] != one) | (self.two[slot] != two)))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (len(self.entry) - 1)
            now = self.entry[slot]
            found[left] = now
            other = (now >= 0) & ((self.one[slot] != one[left]) | (self.two[slot] != two[left]))
            left, slot = left[other], slot[other]
        return found

    def insert(self, one: np.ndarray, two: np.ndarray, entry: np.ndarray) -> None:
        """Distinct keys that aren't there yet."""
        if (self.keys + len(one)) * 3 > len(self.entry) * 2:
            old = self.entry >= 0
            held = self.one[old], self.two[old], self.entry[old]
            size = len(self.entry)
            while (self.keys + len(one)) * 3 > size * 2:
                size *= 2
            self.one, self.two, self.entry = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.uint64), np.full(size, -1, dtype=np.int32)
            self._place(*held)
        self._place(one, two, entry)
        self.keys += len(one)

    def _place(self, one, two, entry):
        slot = self.slots(one, two)
        while len(slot):
            free = np.flatnonzero(self.entry[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            mine = free[first]
            self.one[slot[mine]], self.two[slot[mine]], self.entry[slot[mine]] = one[mine], two[mine], entry[mine]
            rest = np.ones(len(slot), dtype=bool)
            rest[mine] = False
            one, two, entry, slot = one[rest], two[rest], entry[rest], (slot[rest] + 1) & (len(self.entry) - 1)


class ChunkEncoder:
    """Ids of whole texts, from the remembered ids of their chunks between ASCII white space.

    The tokenizer lower-cases, drops white space and never joins what it parts, so a chunk's ids don't depend on
    its neighbours. Chunks are looked up all at once, by their bytes with A-Z lower-cased; those longer than 16
    bytes by a dictionary. New chunks are encoded many at a time, parted by a sign with an id of its own that no
    such text can give. Texts with characters beyond U+024F, with U+0130, with the separators 28 to 31 (which not
    every library takes for white space) or a zero byte, or with the opening of a special token, are encoded whole.
    """

    #: ASCII marks without the apostrophe, which can open a contraction.
    MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
    #: Signs beyond U+024F, fixed values; the first with a single id parts chunks.
    SIGNS = ("\U0001f602", "\u2764", "\u65e5", "\u306e")

    def __init__(self, content: str, dtype: str, remember: int = CACHE_CHUNKS):
        import re

        from tokenizers import Tokenizer

        self.tokenizer, self.dtype, self.remember = Tokenizer.from_str(content), dtype, remember
        self.table, self.long = ChunkTable(dtype), {}
        self.odd = re.compile("[^\x01-\x1b\x20-\u012f\u0131-\u024f]").search
        #: Bytes that a text encoded whole has at least one of.
        self.suspect = np.zeros(256, dtype=bool)
        self.suspect[[0, 28, 29, 30, 31, ord("<"), 0xC4, *range(0xC9, 256)]] = True
        ids = {s: self.tokenizer.encode(s, add_special_tokens=False).ids for s in self.SIGNS}
        self.sign = next(((s, x[0]) for s, x in ids.items() if len(x) == 1), None)

    def packed(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=self.dtype).tobytes() for x in found]

    def new_ids(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks. Marks after a last letter are a run of their own, so word and marks are encoded apart."""

        def parted(piece: str) -> tuple[str, ...]:
            word = piece.rstrip(self.MARKS)
            return (word, piece[len(word) :]) if word and word[-1].isalpha() else (piece,)

        split = [[x for piece in c.lower().split() for x in parted(piece) if x] for c in chunks]
        wanted = list({x for pieces in split for x in pieces})
        ids = dict(zip(wanted, self.packed_chunks(wanted), strict=True)) if wanted else {}
        return [b"".join([ids[x] for x in pieces]) for pieces in split]

    def packed_chunks(self, chunks: list[str]) -> list[bytes]:
        if self.sign is None:
            return self.packed(chunks)
        out = []
        for low in range(0, len(chunks), 200):
            part = chunks[low : low + 200]
            ids = np.array(self.tokenizer.encode(f" {self.sign[0]} ".join(part), add_special_tokens=False).ids, dtype=self.dtype)
            ends = np.append(np.flatnonzero(ids == self.sign[1]), len(ids)).tolist()
            raw, width, at = ids.tobytes(), ids.itemsize, 0
            for end in ends:
                out.append(raw[at * width : end * width])
                at = end + 1
        return out

    def entries(self, low: np.ndarray, begin: np.ndarray, end: np.ndarray, more: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Entries of the table: one for each chunk of these bytes, and one for each of `more` ids; read them before the next call."""
        raw = np.concatenate([np.zeros(8, dtype=np.uint8), low, np.zeros(8, dtype=np.uint8)])
        eight = np.ndarray(len(raw) - 7, dtype="<u8", buffer=raw.data, strides=(1,))
        size = end - begin
        one = eight[begin + 8] & MASKS[np.minimum(size, 8)]
        two = np.where(size > 8, eight[end], np.uint64(0))
        found = self.table.find(one, two).astype(np.int64)
        wide = np.flatnonzero(size > 16)
        held = [low[b:e].tobytes() for b, e in zip(begin[wide].tolist(), end[wide].tolist(), strict=True)]
        found[wide] = [self.long.get(c, -1) for c in held]
        missing = np.flatnonzero((found < 0) & (size <= 16))
        missing = missing[np.lexsort((two[missing], one[missing]))]
        first = np.ones(len(missing), dtype=bool)
        first[1:] = (one[missing[1:]] != one[missing[:-1]]) | (two[missing[1:]] != two[missing[:-1]])
        fresh, longer = missing[first], list(dict.fromkeys(c for c, f in zip(held, found[wide].tolist(), strict=True) if f < 0))
        chunks = [low[b:e].tobytes() for b, e in zip(begin[fresh].tolist(), end[fresh].tolist(), strict=True)] + longer
        at = self.table.add(self.new_ids([c.decode() for c in chunks]) + more)
        new = at[: len(chunks)]
        found[missing] = new[np.cumsum(first) - 1]
        longs = dict(zip(longer, new[len(fresh) :].tolist(), strict=True))
        found[wide] = [longs.get(c, f) for c, f in zip(held, found[wide].tolist(), strict=True)]
        if self.table.keys + len(self.long) + len(new) <= self.remember:
            self.table.keep(new)
            self.table.insert(one[fresh], two[fresh], new[: len(fresh)].astype(np.int32))
            self.long.update(longs)
        return found, at[len(chunks) :]

    def encode_column(self, column: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text's begin, and the end), with the end id behind each text if there is one."""
        data, starts = bytes_of(column)
        suspects = np.unique(np.searchsorted(starts, np.flatnonzero(self.suspect[data]), side="right") - 1)
        odd = [(i, t) for i in suspects.tolist() if "<|" in (t := column[i].as_py()) or self.odd(t)]
        begin, end, first = words(data, starts)
        text = np.repeat(np.arange(len(column)), np.diff(first))
        if odd:
            whole = np.ones(len(column), dtype=bool)
            whole[[i for i, _ in odd]] = False
            begin, end, text = begin[whole[text]], end[whole[text]], text[whole[text]]
        more = self.packed([t for _, t in odd]) if odd else []
        found, added = self.entries(LOWER[data], begin, end, more if end_id is None else [*more, np.array([end_id], dtype=self.dtype).tobytes()])
        ends = np.arange(len(column) if end_id is not None else 0)
        text = np.concatenate([text, np.array([i for i, _ in odd], dtype=np.int64), ends])
        found = np.concatenate([found, added[: len(odd)], np.repeat(added[len(odd) :], len(column))])
        order = np.argsort(text, kind="stable")
        found = found[order]
        count, offset = self.table.count[found], self.table.offset[found]
        cuts = np.concatenate([[0], np.cumsum(count)])
        ids = self.table.ids[np.arange(cuts[-1]) + np.repeat(offset - cuts[:-1], count)]
        return ids, cuts[np.searchsorted(text[order], np.arange(len(column) + 1))]

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, cuts = self.encode_column(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def encoder(content: str, dtype: str, key: str, remember: int) -> ChunkEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    state = worker_state()
    if state.get("encoder_key") != key:
        state.update(encoder_key=key, encoder=ChunkEncoder(content, dtype, remember))
    return state["encoder"]


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, queue=None, remember: int = CACHE_CHUNKS) -> DataFrame:
    """Stored rows (doc_id, queue, chunk, start, n, ids): ids packed little-endian; start counts the ids of the queue ahead in the same task."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        content = f.read()
    from tokenizers import Tokenizer

    dtype = "<u2" if max(Tokenizer.from_str(content).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    shared, key = spark.sparkContext.broadcast(content), f"{tokenizer_path}:{dtype}:{remember}"
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, queue string, chunk long, start long, n long, ids binary"

    def encode(batches):
        from pyspark import TaskContext

        chunk, ahead, enc = TaskContext.get().partitionId(), {}, encoder(shared.value, dtype, key, remember)
        for batch in batches:
            for part in parts(batch, 1):
                ids, cuts = enc.encode_column(part.column(1), end_id)
                queues, starts, sizes = part.column(2).to_pylist(), [], np.diff(cuts).tolist()
                for q, n in zip(queues, sizes, strict=True):
                    starts.append(ahead.get(q, 0))
                    ahead[q] = starts[-1] + n
                held = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((cuts * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([chunk] * len(sizes), pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), held],
                    names=["doc_id", "queue", "chunk", "start", "n", "ids"],
                )

    rows = docs.select("doc_id", text_or_empty().alias("text"), (source_key() if queue is None else queue).alias("queue"))
    return store(rows.mapInArrow(lean(encode, keep=True), schema), "packing-ids"), dtype


def rare_places(ids: DataFrame, bases: DataFrame, rare: DataFrame) -> DataFrame:
    """chunk, queue, start, pool, place: where each document of a rare source begins in its pool's stream.

    Weighted fair queueing: documents go by the end of their place in their source's stream over the source's
    weight (over its total where it weighs 0). So at any point of the pool's stream each source that is not
    used up has given its proportion, to within a document.
    """
    order = ["finish", "queue", "chunk", "start"]
    rate = F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.col("total").cast("double"))
    ends = ids.select("chunk", "queue", "start", "n").join(bases, ["chunk", "queue"]).join(rare, "queue")
    ends = ends.select("pool", ((F.col("base") + F.col("start") + F.col("n")) / rate).alias("finish"), "queue", "chunk", "start", "n")
    ends = store(ends.repartitionByRange("pool", *order).withColumn("cell", F.spark_partition_id()), "packing-rare")
    cells = ends.groupBy("pool", "cell").agg(F.sum("n").alias("sum"))
    ahead = Window.partitionBy("pool").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("pool", "cell", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("cell_base"))  # one row for each task
    inside = Window.partitionBy("pool", "cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ends.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(cells), ["pool", "cell"])
    return placed.select("chunk", "queue", "start", "pool", (F.col("cell_base") + F.col("inside")).alias("place"))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, mixture: dict | None = None, with_ids: bool = False, remember: int = CACHE_CHUNKS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A document's ids are those of its whole text and one end id; null text counts as empty, so each document
    has one id at least. Each source (null is one too) is a queue of its documents in the order they are read.
    Windows of `capacity` ids are filled by deficit round-robin over the queues to the target proportions:
    `mixture` (source to weight; a source it lacks weighs 0 and follows when the others are used up), or each
    queue's own share of all ids. What a queue is owed carries over to the next window, and its place in the
    stream carries over from one partition to the next, so every window but the last is full and every id lies
    in one piece. Repeated rows and null ids are packed like others; an empty table gives no row; other
    columns are ignored. Lost tasks run again from the written ids.

    Only the totals of queues (MAX_QUEUES at most) reach the driver, where the dealing is planned; any place
    of a queue's stream then maps to its window by arithmetic. With more sources than that, those of greatest
    weight have queues of their own. The others meet in one queue with their summed weights, merged there
    document by document in proportion to them; sources that weigh 0 meet in another one, which weighs 0.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    ids, dtype = tokenized(docs, tokenizer_path, end_id, remember=remember)
    sums = ids.groupBy("chunk", "queue").agg(F.sum("n").alias("sum"))
    ahead = Window.partitionBy("queue").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = store(sums.select("chunk", "queue", "sum", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("base")), "packing-bases")
    named = None if mixture is None else {"2" if k is None else f"1{k}": float(v) for k, v in mixture.items()}
    totals = bases.groupBy("queue").agg(F.sum("sum").alias("total"))
    found, rare = totals.limit(MAX_QUEUES + 1).collect(), None
    if len(found) > MAX_QUEUES:
        weighed = totals.withColumn("weight", F.col("total").cast("double"))
        if named is not None:
            given = spark.createDataFrame([(q, w) for q, w in named.items()], "queue string, weight double")
            weighed = totals.join(given, "queue", "left").select("queue", "total", F.coalesce("weight", F.lit(0.0)).alias("weight"))
        weighed = store(weighed, "packing-weights")
        found = weighed.orderBy(F.desc("weight"), F.desc("total"), "queue").limit(MAX_QUEUES - 2).collect()
        own = F.broadcast(spark.createDataFrame([(r.queue,) for r in found], "queue string"))
        rare = weighed.join(own, "queue", "left_anti").withColumn("pool", F.when(F.col("weight") > 0, RARE).otherwise(RARE_UNWEIGHED))
        found += rare.groupBy(F.col("pool").alias("queue")).agg(F.sum("total").alias("total"), F.sum("weight").alias("weight")).collect()
    found = sorted(found, key=lambda r: r.queue)
    queues = [r.queue for r in found]
    amounts = np.array([r.total for r in found], dtype=np.int64)
    if rare is not None:
        weights = np.array([r.weight for r in found])
    else:
        weights = amounts.astype(float) if named is None else np.array([named.get(q, 0.0) for q in queues])
    plan = spark.sparkContext.broadcast((plan_windows(amounts, weights, capacity), queues))
    bases = bases.drop("sum")
    bases = F.broadcast(bases) if bases.count() <= BROADCAST_ROWS else bases
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def pieces(batches):
        phases, names = plan.value
        place = {q: by_queue(phases, i) for i, q in enumerate(names)}
        for batch in batches:
            out = [[] for _ in range(7 + with_ids)]
            taken = []
            for i, (q, start, n, base, packed) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("queue", "start", "n", "base", "ids")), strict=True)):
                wide = np.frombuffer(packed, dtype=dtype).astype("<u4")
                for at, length, window, offset in cut(place[q], base + start, n):
                    taken.append(i)
                    piece = wide[at : at + length]
                    for column, value in zip(out, (at, length, zlib.crc32(piece), n, window, offset), strict=False):
                        column.append(value)
                    if with_ids:
                        out[7].append(piece.astype(np.int32))
            columns = [batch.column("doc_id").take(pa.array(taken, pa.int64())), *(pa.array(x, pa.int64()) for x in out[:6])]
            names_ = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns, names_ = [*columns, pa.array(out[7], pa.list_(pa.int32()))], [*names_, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names_)

    columns = ["doc_id", "queue", "start", "n", "base", "ids"]
    rows = ids.join(bases, ["chunk", "queue"])
    if rare is not None:
        merged = ids.join(rare_places(ids, bases, rare), ["chunk", "queue", "start"])
        merged = merged.select("doc_id", F.col("pool").alias("queue"), F.col("place").alias("start"), "n", F.lit(0).cast("long").alias("base"), "ids")
        rows = rows.join(own, "queue", "left_semi").select(*columns).unionByName(merged)
    return rows.select(*columns).mapInArrow(lean(pieces, keep=True), schema)
