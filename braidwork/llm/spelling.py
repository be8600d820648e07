"""Grouping of spelling variants: automata over the halves of words find all words at one edit from each other."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.llm.common import lean, only, store, text_or_empty

LETTERS = "A-Za-z\\u00C0-\\u00FF"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST = 7
#: Words that may share one segment before it is told apart by halves of what it leaves open.
GROUP = 4096
#: Words of a segment that a task compares one by one; more are told apart in the same way.
FEW = 12
#: Segments of an automaton, about.
SHARD = 8192


def letter_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id (as string, null: empty) and run: each maximal run of letters of at least `least` code points, A-Z in lower case."""
    found = F.regexp_extract_all(text_or_empty(), F.lit(f"([{LETTERS}]{{{least},}})"), F.lit(1))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(found).alias("run"))
    return rows.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))


def with_slips(runs: DataFrame, every: int = 31) -> DataFrame:
    """word: the run, without one code point where `every` divides the checksum of `<doc_id>:<run>`; the checksum says which."""
    h = F.crc32(F.concat("doc_id", F.lit(":"), "run"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.withColumn("h", h).select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def counted(words: DataFrame, least: int = LEAST, at_least: int = 2) -> DataFrame:
    """word, n: the distinct words of at least `least` code points that occur at_least times."""
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= at_least)


def halves(rows: DataFrame) -> DataFrame:
    """Each row twice, for a word of `m` code points that holds still its first `p` and last `s`: with the first and with the last half of what is open held still too."""
    low, high = F.col("p"), F.col("m") - F.col("s")
    mid = low + F.floor((high - low) / 2).cast("int")
    kinds = F.array(F.struct(mid.alias("p"), F.col("s").alias("s")), F.struct(low.alias("p"), (F.col("m") - mid).alias("s")))
    return rows.withColumn("_k", F.explode(kinds)).withColumns({"p": F.col("_k.p"), "s": F.col("_k.s")}).drop("_k").withColumn("key", segment_key())


def segment_key() -> Column:
    """One number for what is held still of a word; equal for a word and those at one edit from it that keep the segment."""
    size = F.length("word")
    return F.xxhash64("m", "p", "s", F.substring("word", F.lit(1), F.col("p")), F.substring("word", size - F.col("s") + 1, F.col("s")))


def one_edit(a: str, b: str) -> bool:
    """Whether a and b differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def found_before(u: str, w: str, p: int, s: int) -> bool:
    """Whether an earlier half of the way to segment (p, s) finds the pair as well: then it is counted there."""
    low, high, end = 0, len(w), len(w) - s
    while (low, high) != (p, end):
        mid = low + (high - low) // 2
        if p >= mid:
            low = mid
            continue
        if u[low:mid] == w[low:mid]:
            return True
        high = mid
    return False


def divided(words: list[tuple[str, int]], m: int, p: int, s: int) -> list | dict:
    """Words of m code points that share their first p and last s: a short list, or by the halves of what is open."""
    if len(words) <= FEW or m - p - s <= 1:
        return words
    mid, kids = p + (m - p - s) // 2, {}
    for item in words:
        kids.setdefault((0, item[0][p:mid]), []).append(item)
        kids.setdefault((1, item[0][mid : m - s]), []).append(item)
    return {(last, piece): divided(held, m, p if last else mid, m - mid if last else s) for (last, piece), held in kids.items()}


def candidates(held: list | dict, word: str, m: int, p: int, s: int):
    """(words, p, s): the lists that a word's own halves lead to."""
    waiting, size = [(held, p, s)], len(word)
    while waiting:
        held, p, s = waiting.pop()
        if isinstance(held, list):
            yield held, p, s
            continue
        mid = p + (m - p - s) // 2
        for key, p_, s_ in (((0, word[p:mid]), mid, s), ((1, word[size - (m - mid) : size - s]), p, m - mid)):
            if key in held:
                waiting.append((held[key], p_, s_))


class Automaton:
    """The words of a shard by their segments; a scan of a word finds those at one edit from it that keep a segment."""

    def __init__(self):
        self.groups, self.made = {}, None

    def add(self, word: str, n: int, m: int, p: int, s: int) -> None:
        self.groups.setdefault((word[:p], word[m - s :], m), []).append((word, n))

    def close(self) -> None:
        import ahocorasick

        pieces = {}
        for (first, last, m), words in self.groups.items():
            pieces.setdefault(max(first, last, key=len), []).append((first, last, m, divided(words, m, len(first), len(last))))
        self.made = ahocorasick.Automaton()
        for piece, groups in pieces.items():
            self.made.add_word(piece, groups)
        if pieces:
            self.made.make_automaton()

    def near(self, word: str, m: int, p: int, s: int) -> tuple[int, int, str | None]:
        """(number, largest n, its word) of the shard's words of m code points that keep their first p and last s."""
        size, count, most, best = len(word), 0, -1, None
        for end, groups in self.made.iter(word) if self.groups else ():
            if end + 1 != p and end + 1 != size:
                continue
            for first, last, length, held in groups:
                if length != m or len(first) != p or len(last) != s or not word.startswith(first) or not word.endswith(last):
                    continue
                if end + 1 != (p if p >= s else size):
                    continue
                for words, p_, s_ in candidates(held, word, m, p, s):
                    open_ = word[p_ : size - s_]
                    for other, n in words:
                        if one_edit(open_, other[p_ : m - s_]) and not found_before(word, other, p_, s_):
                            count += 1
                            if n > most or n == most and other < best:
                                most, best = n, other
        return count, most, best


def scanned(patterns: DataFrame, probes: DataFrame, shards: int) -> DataFrame:
    """word, near, best_n, best for each probe with a near word among the patterns; a shard's automaton is all that a task holds."""
    rows = patterns.withColumn("role", F.lit(0)).unionByName(probes.withColumn("role", F.lit(1)))
    placed = rows.select(F.pmod("key", F.lit(shards)).alias("shard"), "role", "word", "n", "m", "p", "s")
    ordered = placed.repartition("shard").sortWithinPartitions("shard", "role")

    def scan(batches):
        current, automaton = None, None
        for batch in batches:
            out = []
            for shard, role, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != current:
                    current, automaton = shard, Automaton()
                word, n, m, p, s = row
                if role == 0:
                    automaton.add(word, n, m, p, s)
                    continue
                if automaton.made is None:
                    automaton.close()
                count, most, best = automaton.near(word, m, p, s)
                if count:
                    out.append((word, count, most, best))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "near", "best_n", "best"])

    return ordered.mapInArrow(lean(scan), "word string, near long, best_n long, best string")


def near_words(words: DataFrame) -> DataFrame:
    """word, near (number of words at one edit), best_n and best (of these the one of largest n, ties to the smallest).

    words: a stored table of distinct word and n, words of two code points at least. A word is cut into halves; of two
    words at one edit, one half of either stands unchanged at the beginning or the end of the other. Shards of
    segments, by hash, are made automata; each word is scanned by those that can hold the segments that it begins
    or ends with (words of its length, one less, one more), offsets and lengths are checked and the open part
    compared. No pair leaves a task, only counts and the best. A segment that more than GROUP words share is held
    still and its open part halved again, for as long as it is shared by too many, so no task meets a hot segment's words
    together; what is left when one code point is open is bounded by the alphabet.
    """
    start = words.select("word", "n", F.length("word").alias("m"), F.lit(0).alias("p"), F.lit(0).alias("s"))
    patterns = start
    probes = start.withColumn("m", F.explode(F.sequence(F.col("m") - 1, F.col("m") + 1))).where("m >= 2").select(start.columns)
    shards, found = max(64, -(-2 * words.count() // SHARD)), None
    while True:
        patterns, probes = halves(patterns), halves(probes)
        open_ = F.col("m") - F.col("p") - F.col("s")
        crowded = store(patterns.where(open_ > 1).groupBy("key").count().where(F.col("count") > GROUP).select("key"), "spelling-crowded")
        more = crowded.limit(1).count() > 0
        few = patterns, probes
        if more:
            keys = crowded.select(F.col("key").alias("_crowded"))
            few = [x.join(keys, F.col("key") == F.col("_crowded"), "left_anti") for x in few]
        part = scanned(*few, shards)
        found = part if found is None else found.unionByName(part)
        if not more:
            break
        patterns, probes = (store(only(x, crowded, "key", "key").drop("key"), f"spelling-{name}") for x, name in ((patterns, "patterns"), (probes, "probes")))
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))).alias("top")
    return found.groupBy("word").agg(F.sum("near").alias("near"), best).select("word", "near", (-F.col("top.less")).alias("best_n"), "top.best")


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n for each distinct word of `words` (word, n).

    form: of the words at exactly one inserted, deleted or replaced code point the one of largest n (ties: the smallest in
    code-point order), if its n is at least ratio times the word's. root: the last word that forms lead to, the
    word itself if it has none. Counts of a word that stands in several rows add up; null words and words under
    two code points take no part; an empty table gives no row. Other columns are ignored. ratio must be over 1, so forms
    grow and their chains end.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1")
    known = store(words.where(F.length("word") >= 2).groupBy("word").agg(F.sum("n").cast("long").alias("n")), "spelling-words")
    joined = known.join(near_words(known), "word", "left")
    of_form = F.col("best_n") >= F.col("n") * ratio
    formed = store(joined.select("word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(of_form, F.col("best")).alias("form"), F.when(of_form, F.col("best_n")).alias("form_n")), "spelling-forms")
    up = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # each round doubles how far a word sees; counts grow by ratio a step, so there are few
        above = up.select(F.col("word").alias("root"), F.col("root").alias("above"))
        up = store(up.join(above, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "spelling-roots")
        if up.where("moved").limit(1).count() == 0:
            break
        up = up.drop("moved")
    roots = up.select("word", "root")
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
