"""Language identification with language-bitmask n-gram filters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm.common import Shared, bounded_batches, lean, text_or_empty, threshold
from braidwork.llm.textbytes import LOWER, bytes_of, mix64, parts

#: Texts of a language that training reads (expected number; chosen by a hash of doc_id).
TRAIN_TEXTS = 4000
#: N-grams of a language that its filter holds, the most frequent first.
GRAMS = 50_000
#: Languages that share a word of each filter position, one bit each; a model has as many words as its languages need.
WORD_BITS = 64
#: Positions of the filters (a power of two) and hash functions.
LOG_POSITIONS, HASHES = 21, 3
#: An n-gram is a language's own if its frequency there is at least this part of its highest frequency anywhere.
OWN = 0.5
SIZE = 4  # bytes of an n-gram


def grams(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """4-byte n-grams of each text, lower-cased, digits and ASCII signs as spaces: (n-gram, text), none across texts.

    A space stands ahead of each text and two behind it, so that one letter makes an n-gram.
    """
    plain = LOWER.copy()
    plain[[c for c in range(128) if not 97 <= plain[c] <= 122]] = 32
    folded = np.insert(plain[data], np.concatenate([starts[:-1], starts[1:], starts[1:]]), 32).astype(np.uint32)
    starts = starts + 3 * np.arange(len(starts))
    if len(folded) < SIZE:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    keys = folded[:-3] | folded[1:-2] << np.uint32(8) | folded[2:-1] << np.uint32(16) | folded[3:] << np.uint32(24)
    whole = np.ones(len(keys), dtype=bool)
    cuts = starts[1:-1]
    for back in range(1, SIZE):
        at = cuts - back
        whole[at[(at >= 0) & (at < len(keys))]] = False
    whole &= keys != np.uint32(0x20202020)
    text = np.searchsorted(starts, np.flatnonzero(whole), side="right") - 1
    return keys[whole], text


def positions(keys: np.ndarray) -> list[np.ndarray]:
    wide = mix64(keys.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))
    return [(wide >> np.uint64(i * 21)).astype(np.int64) & ((1 << LOG_POSITIONS) - 1) for i in range(HASHES)]


class LanguageFilters:
    """Bit-sliced Bloom filters: a bit of every position belongs to each language, so one lookup answers for WORD_BITS of them."""

    def __init__(self, languages: list[str], members: dict[int, np.ndarray]):
        self.languages = languages
        bits = min(len(languages), WORD_BITS)
        kind = next(t for t, width in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if bits <= width)
        self.slices = [np.zeros(1 << LOG_POSITIONS, dtype=kind) for _ in range(0, len(languages), WORD_BITS)]
        for l, keys in members.items():
            for at in positions(keys):
                self.slices[l // WORD_BITS][at] |= kind(1 << l % WORD_BITS)
        filled = np.array([np.count_nonzero(self.slices[l // WORD_BITS] & kind(1 << l % WORD_BITS)) for l in range(len(languages))]) / (1 << LOG_POSITIONS)
        self.false_rate = filled**HASHES

    def counts(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each text and language: n-grams the language has, without those expected by chance."""
        keys, text = grams(data, starts)
        places, n = positions(keys), len(starts) - 1
        total = np.bincount(text, minlength=n)
        out = np.zeros((n, len(self.languages)))
        for first, words in zip(range(0, len(self.languages), WORD_BITS), self.slices, strict=True):
            found = words[places[0]]
            for at in places[1:]:
                found &= words[at]
            known = np.flatnonzero(found)
            found, of = found[known], text[known]
            for l in range(first, min(first + WORD_BITS, len(self.languages))):
                rate = self.false_rate[l]
                hits = np.bincount(of[(found >> found.dtype.type(l - first)) & found.dtype.type(1) != 0], minlength=n)
                out[:, l] = np.maximum(0, (hits - total * rate) / (1 - rate))
        return out


def fit(docs: DataFrame, train_texts: int = TRAIN_TEXTS) -> LanguageFilters:
    """Filters from the text and lang of rows that are not held out and whose lang is not null.

    Every lang of those rows is learned, however many there are; a model takes 16 MB for 64 of them (less for
    up to 32). Reads about `train_texts` texts of each language; counts of n-grams are summed on the executors, and each
    language's filter gets its own frequent n-grams (see OWN, GRAMS). No row to learn from gives no language.
    """
    bounded_batches(docs.sparkSession)
    learn = docs.where("pmod(crc32(cast(coalesce(cast(doc_id as string), '') as binary)), 5) != 0 AND lang IS NOT NULL")
    sizes = {r.lang: r["count"] for r in learn.groupBy("lang").count().collect()}
    if not sizes:
        return LanguageFilters([], {})
    languages = sorted(sizes)
    part = F.create_map(*[x for l in languages for x in (F.lit(l), F.lit(threshold(train_texts / sizes[l])))])
    sample = learn.where(F.xxhash64(F.lit(5), "doc_id", "text") <= part[F.col("lang")])

    def count(batches):
        sums: dict[str, dict] = {}
        for batch in batches:
            for piece in parts(batch, 0):
                langs = np.array(piece.column(1).to_pylist(), dtype=object)
                data, starts = bytes_of(piece.column(0))
                keys, text = grams(data, starts)
                for l in set(langs.tolist()):
                    found, n = np.unique(keys[(langs == l)[text]], return_counts=True)
                    sums.setdefault(l, []).append((found, n))
        for l, pairs in sums.items():
            keys, inverse = np.unique(np.concatenate([k for k, _ in pairs]), return_inverse=True)
            n = np.bincount(inverse, weights=np.concatenate([c for _, c in pairs]), minlength=len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([l] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counted = sample.select(text_or_empty().alias("text"), "lang").mapInArrow(lean(count), "lang string, gram long, n long")
    counted = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).where("n > 1")
    from pyspark.sql.window import Window

    top = counted.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(f"_r <= {GRAMS}")
    rows = top.select("lang", "gram", "n").toPandas()  # GRAMS rows of a language at most
    rows["p"] = rows["n"] / rows.groupby("lang")["n"].transform("sum")
    rows = rows[rows["p"] >= OWN * rows.groupby("gram")["p"].transform("max")]
    return LanguageFilters(languages, {i: rows.loc[rows["lang"] == l, "gram"].to_numpy().astype(np.uint32) for i, l in enumerate(languages)})


def with_letter(texts: pa.Array) -> np.ndarray:
    """Which texts have a letter of any script."""
    data, starts = bytes_of(texts)
    if len(starts) == 1:
        return np.empty(0, dtype=bool)
    begins, empty = starts[:-1].clip(max=len(data)), np.diff(starts) == 0
    folded = LOWER[data]
    has = (np.add.reduceat(np.append((folded >= 97) & (folded <= 122), False), begins) > 0) & ~empty
    high = np.add.reduceat(np.append(data >= 128, False), begins) > 0
    for i in np.flatnonzero(high & ~has & ~empty):
        has[i] = any(c.isalpha() for c in texts[int(i)].as_py())
    return has


def predict(docs: DataFrame, model: LanguageFilters) -> DataFrame:
    """One row per document: doc_id, lang_pred, score.

    lang_pred has the most n-grams (ties: the first by code point); `und` if the text is null, empty or
    without a letter, or if the model has no language. score is the best count's part of the two best counts;
    0 for `und` and for texts none of whose n-grams any language has.
    """
    shared = Shared(docs.sparkSession, model)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def scored(batches):
        model = shared.value
        for batch in batches:
            for piece in parts(batch, 1):
                data, starts = bytes_of(piece.column(1))
                has = with_letter(piece.column(1))
                if model.languages:
                    counts = model.counts(data, starts)
                    best = counts.argmax(axis=1)
                    ordered = np.sort(counts, axis=1)
                    top, second = ordered[:, -1], ordered[:, -2] if counts.shape[1] > 1 else np.zeros(len(counts))
                    score = np.where(has & (top > 0), top / np.maximum(top + second, 1e-300), 0.0)
                    names = [model.languages[b] if h else "und" for b, h in zip(best, has, strict=True)]
                else:
                    names, score = ["und"] * piece.num_rows, np.zeros(piece.num_rows)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(lean(scored), f"doc_id {id_type}, lang_pred string, score double")


def identify(docs: DataFrame, train_texts: int = TRAIN_TEXTS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, by a model learned from the rows that are not held out.

    Rows of an empty table give nothing; repeated rows give repeated answers; a null id counts as the empty
    string in the split. Texts of any length are read whole.
    """
    found = predict(docs, fit(docs, train_texts))
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float | None = 0.0, relabel: bool = False) -> DataFrame:
    """The documents whose language is known: not `und`, and some n-gram known to its language (score above `least`).

    With None for `least` every document stays that `predict` gives a language, whatever its score. With `relabel` lang
    becomes what `predict` says, unless no language knows an n-gram of the text: then the given one stays.
    The test is a function of the text alone, so it is made row by row and the documents are not shuffled.
    """
    model = fit(docs)
    shared = Shared(docs.sparkSession, model)
    columns = docs.columns

    def kept(batches):
        model = shared.value
        names = pa.array(model.languages, pa.string())
        for batch in batches:
            for piece in parts(batch, len(columns)):
                texts, made = piece.column(len(columns)), dict(zip(columns, piece.columns, strict=False))
                good = with_letter(texts) if model.languages else np.zeros(piece.num_rows, dtype=bool)
                if model.languages and (relabel or least is not None):
                    counts = model.counts(*bytes_of(texts))
                    top = counts.max(axis=1, initial=0)
                    if least is not None:
                        good &= top > least
                    if relabel:
                        made["lang"] = pa.compute.if_else(pa.array(top > 0), names.take(pa.array(counts.argmax(axis=1))), made["lang"].cast(pa.string()))
                yield pa.RecordBatch.from_arrays([made[c].filter(pa.array(good)) for c in columns], names=columns)

    return docs.select(*columns, text_or_empty().alias("_text")).mapInArrow(lean(kept), docs.schema)
