"""N-gram Jaccard join by grouped prefixes: documents of equal size and prefix are one group; group pairs are filtered, expanded, verified."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm.common import BROADCAST_IDS, SPACE, bounded_batches, lean, store, text_or_empty
from braidwork.llm.components import components
from braidwork.llm.textbytes import LOWER, Rolling, bytes_of, mix64, parts, words

SHINGLE = 5
#: Two sets link when MORE * intersection >= LESS * union (similarity 3 / 4).
LESS, MORE = 75, 100
#: A shingle counts as frequent from this many documents of one block of a task on; so many are told apart at most.
BLOCK_SHINGLES, BLOCK_COUNT, FREQUENT = 2_000_000, 2, 200_000
#: Runs of up to this many groups give pairs of groups; longer ones stay runs.
SMALL_RUN = 12
#: Longer runs than this are not thinned.
THINNED_RUN = 1000
#: Steps from group to group within which a cluster is gathered.
CLUSTER_STEPS = 2
#: Shingles and sets of a tile, at most (a longer set stands alone).
TILE_TOKENS, TILE_SETS = 400_000, 4096
#: Rows of sorted runs that a task holds.
RUN_ROWS = 400_000
#: Prefix rows for each task of the join, shingles for each task that compares, and in a slice of what is sent there.
TASK_ROWS, TASK_TOKENS, SLICE_TOKENS = 500_000, 4_000_000, 500_000
#: Salts of the hashes of sets and prefixes.
SET_SALT, GROUP_SALT = 0x1234567, 0x7654321


def shingles(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts one after the other, and where each text's begin (and the end)."""
    folded = LOWER[data]
    begin, end, first = words(data, starts)
    word = Rolling(folded).of(begin, end)
    n, total = np.diff(first), len(word)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(n)), count)
    at = first[:-1][text] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    held = np.minimum(n[text], SHINGLE)
    sums = held.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for i in range(SHINGLE):
        inside = i < held
        sums = mix64(sums + np.uint64(i)) + np.where(inside, word[np.minimum(at + i, max(total - 1, 0))] if total else 0, 0).astype(np.uint64)
    values = mix64(sums)
    ends = np.concatenate([[0], np.cumsum(count)])
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a > 1:
            values[a:b].sort()
    new = np.ones(len(values), dtype=bool)
    if len(values):
        new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    kept = np.concatenate([[0], np.cumsum(new)])
    return values[new], kept[ends]


def digest(values: np.ndarray, ends: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of each set, whatever the order of its values."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(values ^ np.uint64(salt)))])
    return mix64(sums[ends[1:]] - sums[ends[:-1]] + np.diff(ends).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def prefix_length(n: np.ndarray) -> np.ndarray:
    """So many of a set's first shingles, in one order for all sets, that two linked sets share one of them."""
    return np.where(n > 0, n + (-n * LESS // MORE) + 1, 0)


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(sorted hashes, counts) of shingles that are frequent in blocks of documents, and the number of all shingles.

    Every document is counted. Only what a block of a task holds BLOCK_COUNT times is sent on; counts are summed
    and the FREQUENT most frequent kept, which bounds what the driver and the tasks hold. They decide the order
    of shingles only, never which documents are compared.
    """

    def count(batches):
        held, size, total = [], 0, 0

        def block():
            values, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= BLOCK_COUNT
            return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(n[often].astype(np.int64)), pa.array(np.zeros(int(often.sum()), dtype=np.int64))], names=["h", "n", "total"])

        for batch in batches:
            for piece in parts(batch, 0):
                values, _ = shingles(*bytes_of(piece.column(0)))
                held.append(values)
                size, total = size + len(values), total + len(values)
                if size >= BLOCK_SHINGLES:
                    yield block()
                    held, size = [], 0
        if held:
            yield block()
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0]), pa.array([total])], names=["h", "n", "total"])

    counted = store(docs.select(text_or_empty().alias("text")).mapInArrow(lean(count), "h long, n long, total long"), "jaccard-frequent")
    total = counted.agg(F.sum("total")).first()[0] or 0
    sums = store(counted.where("n > 0").groupBy("h").agg(F.sum("n").alias("n")), "jaccard-sums")
    # The least count that leaves no more than FREQUENT shingles, so that no more are sent to the driver.
    often, least = 0, None
    for n, shingles_with_n in sorted(map(tuple, sums.groupBy("n").count().collect()), reverse=True):
        often += shingles_with_n
        if often > FREQUENT:
            break
        least = n
    top = sums.where(F.col("n") >= (least if least is not None else 1 << 60)).toPandas()
    order = np.argsort(top["h"].to_numpy().astype(np.int64).view(np.uint64))
    return top["h"].to_numpy().astype(np.int64).view(np.uint64)[order], top["n"].to_numpy().astype(np.int64)[order], total


def prefixed(values: np.ndarray, ends: np.ndarray, often: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Values with each text's in the common order: rare ones by hash, then frequent ones by count."""
    if not len(often) or not len(values):
        return values
    at = np.minimum(np.searchsorted(often, values), len(often) - 1)
    weight = np.where(often[at] == values, counts[at], 0)
    touched = np.unique(np.searchsorted(ends, np.flatnonzero(weight), side="right") - 1)
    out = values.copy()
    for i in touched.tolist():
        a, b = ends[i], ends[i + 1]
        out[a:b] = values[a:b][np.argsort(weight[a:b], kind="stable")]
    return out


def may_link(n1, at1, n2, at2):
    """Whether sets of these sizes, whose first common shingle is at these places of their orders, can link."""
    need = -(-(n1 + n2) * LESS // (LESS + MORE))
    return similar_size(n1, n2) & (at1 <= n1 - need) & (at2 <= n2 - need)


def similar_size(n1, n2):
    return LESS * np.maximum(n1, n2) <= MORE * np.minimum(n1, n2)


PREFIX = "h long, pack long, place long"


def run_pairs(batches):
    """Pairs of groups and long runs from rows (h, pack, place, doc_id, tid) sorted by h and place.

    place: size << 32 | position for prefix rows of groups (pack), -1 - n for members (h: set, pack: group), which
    pass through. Yields kind 0: a pair (a, b) of groups and in how many short runs it is; kind 1: a row (h, group) of a long run;
    kind 2: a member (set, group, -1 - n) with its doc_id and tid.
    """
    doc_type = [pa.int64()]

    def out(kind, a, b, c, doc=None, tid=None):
        ids = [doc if doc is not None else pa.nulls(len(a), doc_type[0]), tid if tid is not None else pa.nulls(len(a), pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, dtype=np.int64)), pa.array(a), pa.array(b), pa.array(c), *ids], names=["kind", "a", "b", "c", "doc_id", "tid"])

    def emit(h, group, place, long_h):
        if not len(h):
            return
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (group[1:] != group[:-1]) | (place[1:] != place[:-1])
        h, group, place = h[new], group[new], place[new]
        first = np.ones(len(h), dtype=bool)
        first[1:] = h[1:] != h[:-1]
        begin = np.flatnonzero(first)
        length = np.diff(np.append(begin, len(h)))
        index = np.arange(len(h)) - np.repeat(begin, length)
        big = np.repeat(length > SMALL_RUN, length)
        if long_h is not None:
            big |= h == long_h
        size = place >> 32
        back = np.concatenate([np.full(int(((index >= d) & ~big).sum()), d) for d in range(1, max(SMALL_RUN, 2))])
        right = np.concatenate([np.flatnonzero((index >= d) & ~big) for d in range(1, max(SMALL_RUN, 2))])
        left = right - back
        good = similar_size(size[left], size[right]) & (group[left] != group[right])
        a, b = np.minimum(group[left[good]], group[right[good]]), np.maximum(group[left[good]], group[right[good]])
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        once = np.ones(len(a), dtype=bool)
        once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        if once.any():
            yield out(0, a[once], b[once], np.diff(np.append(np.flatnonzero(once), len(a))))
        if big.any():
            yield out(1, h[big], group[big], place[big])

    held, rows, long_h = [], 0, None
    for batch in batches:
        doc_type[0] = batch.column(3).type
        h, group, place = (np.asarray(batch.column(i)) for i in range(3))
        member = place < 0
        if member.any():
            yield out(2, h[member], group[member], place[member], *(batch.column(i).filter(pa.array(member)) for i in (3, 4)))
        keep = ~member
        held.append((h[keep], group[keep], place[keep]))
        rows += int(keep.sum())
        if rows >= RUN_ROWS:
            h, group, place = (np.concatenate(c) for c in zip(*held, strict=True))
            cut = int(np.searchsorted(h, h[-1]))
            if cut:
                yield from emit(h[:cut], group[:cut], place[:cut], long_h)
                long_h = None if h[-1] != long_h else long_h
                held, rows = [(h[cut:], group[cut:], place[cut:])], len(h) - cut
            else:  # one run fills the block: all its rows are those of a long run
                yield from emit(h, group, place, h[-1])
                long_h, held, rows = h[-1], [], 0
    if held:
        yield from emit(*(np.concatenate(c) for c in zip(*held, strict=True)), long_h)


def thinned(batches):
    """Units (h, group) from rows (h, group, place, long) of long runs, sorted by h; long: the group's number of long runs.

    A pair that short runs don't have shares shingles of long runs only, no more than either group has, and passes the
    position filter in the run of the first one. Groups without such a partner leave the run; a run with fewer
    such pairs than groups becomes these pairs.
    """

    def emit(h, group, place, long):
        size, at = place >> 32, place & 0xFFFFFFFF
        low = 0
        for high in np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h)).tolist():
            one = slice(low, high)
            if high - low > THINNED_RUN:
                yield h[one], group[one]
            else:
                i, j = np.triu_indices(high - low, 1)
                i, j = i + low, j + low
                good = may_link(size[i], at[i], size[j], at[j])
                i, j = i[good], j[good]
                good = np.minimum(long[i], long[j]) >= needed(size[i], size[j]) + np.minimum(prefix_length(size[i]) - size[i], prefix_length(size[j]) - size[j])
                i, j = i[good], j[good]
                if len(i) >= high - low:
                    kept = np.unique(np.concatenate([i, j]))
                    yield h[kept], group[kept]
                elif len(i):
                    pair = mix64(mix64(np.minimum(group[i], group[j]).view(np.uint64)) + np.maximum(group[i], group[j]).view(np.uint64)).view(np.int64)
                    yield np.concatenate([pair, pair]), np.concatenate([group[i], group[j]])
            low = high

    def out(found):
        h, group = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(group)], names=["h", "group"])

    rest, passed = [np.empty(0, dtype=np.int64)] * 4, None
    for batch in batches:
        h, group, place, long = now = [np.concatenate([r, np.asarray(batch.column(i))]) for i, r in enumerate(rest)]
        if not len(h):
            continue
        cut = int(np.searchsorted(h, h[-1]))
        ended = [c[:cut] for c in now]
        if passed is not None and cut:
            going = ended[0] == passed
            if going.any():
                yield out([(ended[0][going], ended[1][going])])
                ended = [c[~going] for c in ended]
            passed = None
        if len(ended[0]) and (found := list(emit(*ended))):
            yield out(found)
        rest = [c[cut:] for c in now]
        if len(rest[0]) > THINNED_RUN or passed is not None:  # it is passed on as it comes
            yield out([(rest[0], rest[1])])
            passed, rest = h[-1], [c[:0] for c in rest]
    if len(rest[0]) and (found := list(emit(*rest))):
        yield out(found)


def needed(n1, n2):
    """The intersection that sets of these sizes need to link."""
    return -(-(n1 + n2) * LESS // (LESS + MORE))


def bit_rows(row: np.ndarray, token: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits of each row, one column for each token that two rows have at least; the rows and columns of these)."""
    _, column, count = np.unique(token, return_inverse=True, return_counts=True)
    shared = count[column] >= 2
    place = np.cumsum(count >= 2) - 1
    row, column = row[shared], place[column[shared]]
    bits = np.zeros((rows, max(1, -(-int((count >= 2).sum()) // 64))), dtype=np.uint64)
    np.bitwise_or.at(bits, (row, column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))
    return bits, row, column


def merge(part: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Component numbers after the links i - j."""
    while (differ := part[i] != part[j]).any():
        low, high = np.minimum(part[i], part[j])[differ], np.maximum(part[i], part[j])[differ]
        to = np.arange(int(part.max()) + 1)
        np.minimum.at(to, high, low)
        while (to[to] != to).any():
            to = to[to]
        part = to[part]
    return part


class Tile:
    """Sets that are compared with each other in one task, and the components that they have so far.

    Each member has a label (of the component that it is known to be in), a tile, a mark of what it has been
    compared with already, and its shingles, rare ones first. Pairs of one label or mark are not compared, nor,
    where the members come from two tiles, pairs from the same one.
    """

    def __init__(self, label: np.ndarray, tile: np.ndarray, mark: np.ndarray, shingles: np.ndarray, ends: np.ndarray):
        self.names, self.part = np.unique(label, return_inverse=True)
        self.label_of, self.across = self.part.copy(), len(np.unique(tile)) > 1
        self.tile, self.mark, self.n = tile, mark, np.diff(ends)
        self.prefix = prefix_length(self.n)
        row = np.repeat(np.arange(len(self.n)), self.n)
        self.bits, _, _ = bit_rows(row, shingles, len(self.n))
        ahead = np.arange(len(shingles)) - np.repeat(ends[:-1], self.n) < self.prefix[row]
        self.first, self.row, self.column = bit_rows(row[ahead], shingles[ahead], len(self.n))

    def open(self, i, j):
        """Which of these pairs are to be compared, by labels, marks, tiles and sizes."""
        n1, n2 = self.n[i], self.n[j]
        good = (self.part[i] != self.part[j]) & (self.mark[i] != self.mark[j]) & similar_size(n1, n2)
        return good & (self.tile[i] != self.tile[j]) if self.across else good

    def least(self, i, j):
        """So many first shingles are shared by two sets that link: all common ones but those that their other shingles can push beyond a prefix."""
        need = needed(self.n[i], self.n[j])
        return np.minimum(self.prefix[i] - self.n[i], self.prefix[j] - self.n[j]) + need

    def verify(self, i, j) -> None:
        """Compare these pairs in full."""
        step = max(1, 2_000_000 // self.bits.shape[1])
        for low in range(0, len(i), step):
            a, b = i[low : low + step], j[low : low + step]
            still = self.part[a] != self.part[b]
            a, b = a[still], b[still]
            linked = np.bitwise_count(self.bits[a] & self.bits[b]).sum(axis=1, dtype=np.int64) >= needed(self.n[a], self.n[b])
            if linked.any():
                self.part = merge(self.part, a[linked], b[linked])

    def compare(self) -> tuple[np.ndarray, np.ndarray]:
        """Compare all pairs that can link; labels that turned out to be of one component, each with the least of them."""
        members = len(self.n)
        count = np.bincount(self.column) if len(self.column) else np.zeros(0, dtype=np.int64)
        listed = int((count * (count - 1) // 2).sum())
        if listed * 100 < members * (members - 1) // 2 * self.first.shape[1]:
            self.compare_listed(count)
        else:
            self.compare_rows()
        best = np.full(int(self.part.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(best, self.part, self.names[self.label_of])
        a, b = self.names[self.label_of], best[self.part]
        return a[a != b], b[a != b]

    def compare_rows(self) -> None:
        """Each member with all behind it: for members that have much in common."""
        every = np.arange(len(self.n))
        for i in range(len(self.n) - 1):
            j = every[i + 1 :][self.open(i, every[i + 1 :])]
            step = max(1, 4_000_000 // self.first.shape[1])
            for low in range(0, len(j), step):
                k = j[low : low + step]
                k = k[np.bitwise_count(self.first[k] & self.first[i]).sum(axis=1, dtype=np.int64) >= self.least(i, k)]
                if len(k):
                    self.verify(np.full(len(k), i), k)

    def compare_listed(self, count: np.ndarray) -> None:
        """Pairs from the lists of the shingles' members: for members that have little in common."""
        order = np.argsort(self.column, kind="stable")
        row, column = self.row[order], self.column[order]
        index = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        pairs = []
        for back in range(1, int(count.max(initial=1))):
            right = np.flatnonzero(index >= back)
            pairs.append(row[right - back] * len(self.n) + row[right])
        if pairs:
            pair, shared = np.unique(np.concatenate(pairs), return_counts=True)
            i, j = pair // len(self.n), pair % len(self.n)
            good = self.open(i, j) & (shared >= self.least(i, j))
            self.verify(i[good], j[good])


def compared(batches):
    """(a, b): labels found to be of one component, from rows (key, tile, set, label, mark, shingles) sorted by key, tile and set."""

    def links(block):
        set_, tile = np.asarray(block.column(2)), np.asarray(block.column(1))
        new = np.ones(len(set_), dtype=bool)
        new[1:] = (set_[1:] != set_[:-1]) | (tile[1:] != tile[:-1])
        if not new.all():
            block = block.filter(pa.array(new))
        if block.num_rows < 2:
            return None
        tile, label, mark = (np.asarray(block.column(i)) for i in (1, 3, 4))
        lists = block.column(5)
        ends = lists.offsets.to_numpy().astype(np.int64)
        shingles = lists.values.to_numpy()[ends[0] : ends[-1]]
        return Tile(label, tile, mark, shingles, ends - ends[0]).compare()

    def out(found):
        a, b = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    rest, found, held = [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.asarray(batch.column(0))
        ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
        if rest and np.asarray(rest[0].column(0))[0] != key[0]:
            ends = np.insert(ends, 0, 0)
        low = 0
        for high in ends.tolist():
            if high > low:
                rest.append(batch.slice(low, high - low))
            if high < len(key):
                if (edges := links(pa.concat_batches(rest))) is not None:
                    found.append(edges)
                    held += len(edges[0])
                rest = []
            low = high
        if held > 100_000:
            yield out(found)
            found, held = [], 0
    if rest and (edges := links(pa.concat_batches(rest))) is not None:
        found.append(edges)
    if found:
        yield out(found)


def compare(docs: DataFrame, chosen: DataFrame, order) -> DataFrame:
    """Stored (a, b): labels found to be of one component. `chosen`, a stored table: doc_id and tid of a document of each set, set, label, mark, tile, keys, tokens.

    The shingles of each chosen set are made where its text is read, and go to the tasks of its keys.
    """
    spark = docs.sparkSession

    def shingled(batches):
        seen: set[int] = set()
        for batch in batches:
            for piece in parts(batch, 0):
                values, ends = shingles(*bytes_of(piece.column(0)))
                named, n = np.asarray(piece.column(1)), np.diff(ends)
                mine = digest(values, ends, SET_SALT).view(np.int64) == named  # a doc_id may have several texts
                for i, s in enumerate(named.tolist()):
                    if mine[i]:
                        mine[i] = s not in seen
                        seen.add(s)
                if len(seen) > 300_000:
                    seen.clear()
                ordered = prefixed(values, ends, *order.value)
                chosen_rows = np.flatnonzero(mine)
                keys = piece.column(5).take(pa.array(chosen_rows))
                times = np.diff(keys.offsets.to_numpy())
                row = np.repeat(chosen_rows, times)
                low = 0
                while low < len(row):  # slices of bounded size, a long set alone
                    high = low + max(1, int(np.searchsorted(np.cumsum(n[row[low:]]), SLICE_TOKENS, side="right")))
                    part = row[low:high]
                    cuts = np.concatenate([[0], np.cumsum(n[part])])
                    at = np.arange(cuts[-1]) - np.repeat(cuts[:-1] - ends[:-1][part], n[part])
                    lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ordered[at].view(np.int64)))
                    take = pa.array(part)
                    yield pa.RecordBatch.from_arrays([keys.flatten().slice(low, high - low), *(piece.column(c).take(take) for c in (4, 1, 2, 3)), lists], names=["key", "tile", "set", "label", "mark", "shingles"])
                    low = high

    wanted = chosen.select(F.col("doc_id").alias("_id"), F.col("tid").alias("_tid"), "set", "label", "mark", "tile", "keys")
    few = chosen.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS // 4
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    mine = texts.join(F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_tid")))
    rows = mine.select("text", "set", "label", "mark", "tile", "keys").mapInArrow(lean(shingled), "key long, tile long, set long, label long, mark long, shingles array<long>")
    moved = chosen.agg(F.sum(F.col("n") * F.size("keys"))).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-moved // TASK_TOKENS))
    rows = rows.repartition(tasks, "key").sortWithinPartitions("key", "tile", "set")
    return store(rows.mapInArrow(lean(compared), "a long, b long"), "jaccard-links")


def tiles_for(tokens, sets):
    """So many tiles of bounded size hold these."""
    return F.greatest(F.ceil(tokens / F.lit(TILE_TOKENS)), F.ceil(sets / F.lit(TILE_SETS)), F.lit(1)).cast("long")


def relabelled(state: DataFrame, edges: DataFrame) -> DataFrame:
    """state with the labels that edges between labels lead to."""
    labels = components(edges).select(F.col("node").alias("label"), F.col("label").alias("_to"))
    return store(state.join(labels, "label", "left").withColumn("label", F.coalesce("_to", "label")).drop("_to").select(*state.columns), "jaccard-state")


def unfinished(state: DataFrame, units: DataFrame) -> DataFrame | None:
    """Stored (h, group): the groups of units (and groups by themselves) with members of several labels that have several marks, or None."""
    ranges = [f(c).alias(f"{n}_{c}") for c in ("label", "mark") for f, n in ((F.min, "low"), (F.max, "high"))]
    wider = [f(f"{n}_{c}").alias(f"{n}_{c}") for c in ("label", "mark") for f, n in ((F.min, "low"), (F.max, "high"))]
    torn = "low_label != high_label AND low_mark != high_mark"
    groups = state.groupBy("group").agg(*ranges)
    across = units.join(groups, "group").groupBy("h").agg(*wider).where(torn).select("h")
    found = store(units.join(across, "h").unionByName(groups.where(torn).select(F.col("group").alias("h"), "group")), "jaccard-open")
    return found if found.limit(1).count() else None


def linked_rows(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, tid (a hash of its text), n_shingles, component_id. See `linked`."""
    spark = docs.sparkSession
    bounded_batches(spark)
    often, counts, total = frequent_shingles(docs)
    shared = spark.sparkContext.broadcast((often, counts))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def prefixes(batches):
        often, counts = shared.value
        seen: set[int] = set()
        for batch in batches:
            for piece in parts(batch, 1):
                values, ends = shingles(*bytes_of(piece.column(1)))
                n = np.diff(ends)
                sets = digest(values, ends, SET_SALT)
                ordered = prefixed(values, ends, often, counts)
                length = prefix_length(n)
                cuts = np.concatenate([[0], np.cumsum(length)])
                text = np.repeat(np.arange(len(n)), length)
                position = np.arange(cuts[-1]) - np.repeat(cuts[:-1], length)
                tokens = ordered[ends[:-1][text] + position]
                group = digest(tokens, cuts, GROUP_SALT) ^ mix64(n.astype(np.uint64))
                fresh = np.zeros(len(n), dtype=bool)
                for i, g in enumerate(group.tolist()):
                    if n[i] and g not in seen:
                        seen.add(g)
                        fresh[i] = True
                if len(seen) > 300_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(sets.view(np.int64)), pa.array(group.view(np.int64)), pa.array(-1 - n), piece.column(0), piece.column(2)], names=["h", "pack", "place", "doc_id", "tid"])
                mine = fresh[text]
                rows = [tokens[mine].view(np.int64), group[text[mine]].view(np.int64), n[text[mine]] << 32 | position[mine]]
                yield pa.RecordBatch.from_arrays([*(pa.array(r) for r in rows), pa.nulls(len(rows[0]), piece.column(0).type), pa.nulls(len(rows[0]), pa.int64())], names=["h", "pack", "place", "doc_id", "tid"])

    tasks = max(spark.sparkContext.defaultParallelism, -(-total // (4 * TASK_ROWS)))
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    rows = texts.select("doc_id", "text", F.xxhash64("text").alias("tid")).mapInArrow(lean(prefixes), f"{PREFIX}, doc_id {id_type}, tid long")
    rows = rows.repartition(tasks, "h").sortWithinPartitions("h", "place", "pack")
    joined = store(rows.mapInArrow(lean(run_pairs), f"kind long, a long, b long, c long, doc_id {id_type}, tid long"), "jaccard-runs")

    members = joined.where("kind = 2").select("doc_id", "tid", F.col("a").alias("set"), F.col("b").alias("group"), (-1 - F.col("c")).alias("n"))
    runs = joined.where("kind = 1").select(F.col("a").alias("h"), F.col("b").alias("group"), F.col("c").alias("place")).distinct()
    some = members.where("n > 0").groupBy("set", "group", "n").agg(F.min("doc_id").alias("smallest"), F.min(F.struct("doc_id", "tid")).alias("one"))
    groups = store(some.select("set", "group", "n", "smallest", F.col("one.doc_id").alias("doc_id"), F.col("one.tid").alias("tid")), "jaccard-groups")
    long_runs = store(runs.groupBy("group").agg(F.count("*").alias("long")), "jaccard-long")
    pairs = sharing_pairs(joined.where("kind = 0"), long_runs, groups)
    thin = runs.join(long_runs, "group").select("h", "group", "place", "long").repartition(tasks, "h").sortWithinPartitions("h", "place")
    thin = thin.mapInArrow(lean(thinned), "h long, group long").distinct()
    # A unit is a run or a pair of groups: whoever links, meets in a unit or a group.
    units = store(thin.unionByName(pairs.select(F.xxhash64("a", "b").alias("h"), F.explode(F.array("a", "b")).alias("group"))), "jaccard-units")

    # Groups that meet come together in clusters: the least group within a few steps. Only the places of work depend on it.
    near = units.groupBy("group").agg(F.min("group").alias("cluster"))
    for _ in range(CLUSTER_STEPS):
        low = units.join(near, "group").groupBy("h").agg(F.min("cluster").alias("cluster"))
        near = units.join(low, "h").groupBy("group").agg(F.min("cluster").alias("cluster"))
    alone = groups.groupBy("group").agg(F.count("*").alias("sets")).where("sets > 1").select("group", F.col("group").alias("cluster"))
    clusters = store(near.unionByName(alone).groupBy("group").agg(F.min("cluster").alias("cluster")), "jaccard-clusters")
    placed = groups.join(clusters, "group")
    load = placed.groupBy("cluster").agg(F.sum("n").alias("tokens"), F.count("*").alias("sets")).select("cluster", tiles_for(F.col("tokens"), F.col("sets")).alias("tiles"))
    of_tile = lambda turn: F.when(F.col("tiles") == 1, F.col("cluster")).otherwise(F.xxhash64("cluster", F.pmod(F.xxhash64("set", F.lit(turn)), F.col("tiles"))))
    state = placed.join(load, "cluster").select("set", "group", "n", "doc_id", "tid", "cluster", "tiles", F.col("set").alias("label"), of_tile(0).alias("mark"))
    state = store(state, "jaccard-state")

    # All pairs of a tile are compared. Tiles are disjoint, so what each one finds are components already.
    chosen = state.select("doc_id", "tid", "set", "n", "label", F.col("set").alias("mark"), F.col("mark").alias("tile"), F.array("mark").alias("keys"))
    found = compare(docs, store(chosen, "jaccard-chosen"), shared)
    state = state.drop("label").join(found.select(F.col("a").alias("set"), F.col("b").alias("_to")), "set", "left").withColumn("label", F.coalesce("_to", "set")).drop("_to")
    state = store(state, "jaccard-state")

    open_ = unfinished(state, units)
    if open_ is not None and state.where("tiles > 1").limit(1).count():
        # Clusters of several tiles are dealt anew, so that large components come together before the rest is compared.
        again = state.where("tiles > 1").join(open_.select("group").distinct(), "group", "left_semi")
        chosen = again.select("doc_id", "tid", "set", "n", "label", "mark", of_tile(1).alias("tile"), F.array(of_tile(1)).alias("keys"))
        found = compare(docs, store(chosen, "jaccard-chosen"), shared)
        if found.limit(1).count():
            state = relabelled(state, found)
            open_ = unfinished(state, units)
    if open_ is not None:
        found = compare(docs, tile_pairs(state, open_), shared)
        if found.limit(1).count():
            state = relabelled(state, found)

    labels = state.select("set", "label")
    owner = groups.join(labels, "set", "left").select("set", "smallest", F.coalesce("label", "set").alias("label"))
    least = owner.groupBy("label").agg(F.min("smallest").alias("component_id"))
    of_set = owner.join(least, "label").select("set", "component_id")
    full = members.where("n > 0").join(of_set, "set").select("doc_id", "tid", F.col("n").alias("n_shingles"), "component_id")
    empty = members.where("n = 0").select("doc_id", "tid", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(empty)


def sharing_pairs(met: DataFrame, long_runs: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b): pairs of groups whose prefixes may share enough shingles for a link: those of their short runs and, at best, all that either has in long runs."""
    about = groups.select("group", "n").distinct().join(long_runs, "group", "left").select("group", "n", F.coalesce("long", F.lit(0)).alias("long"))
    one, two = (about.select(F.col("group").alias(g), F.col("n").alias(f"n_{g}"), F.col("long").alias(f"long_{g}")) for g in "ab")
    pairs = met.groupBy("a", "b").agg(F.sum("c").alias("shared")).join(one, "a").join(two, "b")
    need = f"((n_a + n_b) * {LESS} + {LESS + MORE - 1}) div {LESS + MORE}"
    return pairs.where(f"shared + least(long_a, long_b) >= {need} + 1 - (greatest(n_a, n_b) * {LESS} + {MORE - 1}) div {MORE}").select("a", "b")


def tile_pairs(state: DataFrame, open_: DataFrame) -> DataFrame:
    """Stored rows for `compare`: the sets of open units in new tiles, and for each the pairs of tiles in which it is compared.

    A label with many sets has tiles of its own, which needn't meet each other; labels with few share tiles.
    Tiles meet if a unit has groups in both and their sizes allow a link.
    """
    left = state.join(open_.select("group").distinct(), "group", "left_semi")
    load = left.groupBy("cluster", "label").agg(F.sum("n").alias("_tokens"), F.count("*").alias("_sets"))
    load = load.withColumn("_own", (F.col("_tokens") * 2 > TILE_TOKENS) | (F.col("_sets") * 2 > TILE_SETS))
    pool = load.where("NOT _own").groupBy("cluster").agg(F.sum("_tokens").alias("_tokens"), F.sum("_sets").alias("_sets")).select("cluster", tiles_for(F.col("_tokens"), F.col("_sets")).alias("_pool"))
    load = load.join(pool, "cluster", "left").select("cluster", "label", "_own", F.when(F.col("_own"), tiles_for(F.col("_tokens"), F.col("_sets"))).otherwise(F.col("_pool")).alias("_tiles"))
    own, shared = F.xxhash64("cluster", "label", F.pmod(F.xxhash64("set"), "_tiles")), F.xxhash64("cluster", F.pmod(F.xxhash64("label"), "_tiles"))
    left = left.join(load, ["cluster", "label"]).withColumn("tile", F.when(F.col("_own"), own).otherwise(shared))
    left = store(left.select("doc_id", "tid", "set", "group", "n", "label", "mark", "tile"), "jaccard-left")
    of_tile = left.groupBy("tile").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("label").alias("first"), F.max("label").alias("last"))
    lists = open_.join(left.select("group", "tile").distinct(), "group").groupBy("h").agg(F.sort_array(F.collect_set("tile")).alias("tiles")).select("tiles").distinct()
    met = lists.select("tiles", F.explode("tiles").alias("x")).select("x", F.explode(F.filter("tiles", lambda t: t >= F.col("x"))).alias("y")).distinct()
    one, two = (of_tile.select(F.col("tile").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ("low", "high", "first", "last")]) for n in "xy")
    met = met.join(one, "x").join(two, "y").where("NOT (x_first = x_last AND y_first = y_last AND x_first = y_first)")
    met = met.where(f"x_low * {LESS} <= y_high * {MORE} AND y_low * {LESS} <= x_high * {MORE}").select("x", "y", F.xxhash64("x", "y").alias("key"))
    met = store(met, "jaccard-tiles")
    keys = met.select(F.col("x").alias("tile"), "key").unionByName(met.where("x != y").select(F.col("y").alias("tile"), "key")).groupBy("tile").agg(F.collect_list("key").alias("keys"))
    return store(left.join(keys, "tile").select("doc_id", "tid", "set", "n", "label", "mark", "tile", "keys"), "jaccard-chosen")


def linked(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Words are runs of other characters than `[\\x20\\x09-\\x0D]`, A-Z lower-cased; a document's set has its distinct
    shingles of five words, or its whole sequence of fewer; 64-bit hashes stand for shingles. Sets link from
    similarity 0.75 on, and component_id is the smallest doc_id reachable by links. Documents without words
    (null text too) have an empty set and link with nothing. Equal texts share a set. Rows that repeat a doc_id
    take part each with their own text; null ids are never the smallest unless a component has no other, and then
    its id is null. An empty table gives no row; other columns are ignored.

    1. Shingles frequent in blocks of documents are counted; they come last in the common order, so that
       passages many documents share are seldom in a prefix.
    2. Documents of equal size and prefix form a group. A task sends a group's prefix on once, to where the
       prefix's shingles meet; groups of short runs are pairs, if sizes and the number
       of shingles that their prefixes may share allow a link.
    3. Groups that meet form clusters, which are cut into tiles of bounded size. Their members' sets go to the
       tile's task once; there pairs pass the size and prefix-count filters and are verified. What leaves the
       task are the components found, never pairs.
    4. Where a run, pair or group still has several components in several tiles, its sets are dealt anew, then
       compared by pairs of tiles, all but those known to be of one component. So no link that matters is lost.
    """
    return linked_rows(docs).drop("tid")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without those that link, directly or through others, to one of smaller doc_id.

    Decided row by row: of rows that share a doc_id (null too) each goes or stays with its own text. Rows alike in
    both share the decision.
    """
    gone = linked_rows(docs).where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = store(gone.select(F.col("doc_id").alias("_gone"), F.col("tid").alias("_tid")).distinct(), "jaccard-gone")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, F.col("doc_id").eqNullSafe(F.col("_gone")) & (F.xxhash64(text_or_empty()) == F.col("_tid")), "left_anti")


ORACLE_LINKED = f"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[{SPACE}]+'), lambda x: x <> '') AS w FROM documents),
g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingles FROM t),
n AS (SELECT doc_id, len(shingles) AS n FROM g),
s AS (SELECT doc_id, unnest(shingles) AS shingle FROM g),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 75 * (a.n + b.n - common)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach(x, y) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.x, e.y FROM reach r JOIN e ON e.x = r.y)
SELECT x AS doc_id, any_value(n.n)::BIGINT AS n_shingles, min(y) AS component_id FROM reach JOIN n ON n.doc_id = x GROUP BY x
"""
