"""Byte-level BPE: pieces of a text merged together as rows of padded matrices, and the way back."""

from __future__ import annotations

import base64
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from braidwork.llm.common import Shared, bounded_batches, lean, text_or_empty, worker_state
from braidwork.llm.textbytes import ODD, offsets_of, parts

#: No pair of the vocabulary.
NONE = np.int32(2**31 - 1)
#: Bits of a token id in a pair's key.
BITS = 21
#: Pieces of more bytes are merged alone.
WIDEST = 64
#: Bytes of a matrix's tokens, about.
MATRIX = 1 << 21
#: Pieces and bytes of pieces that a task remembers; then it starts anew.
REMEMBER, REMEMBER_BYTES = 400_000, 16 << 20
#: Texts of more characters are cut into pieces block by block.
BLOCK = 1 << 22


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank, from lines of base64 and rank."""
    pairs = [line.split() for line in Path(path).read_bytes().splitlines() if line.strip()]
    tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(tokens) != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without a gap")
    return [tokens[i] for i in range(len(tokens))]


class PairTable:
    """Open addressing over (left id, right id) -> rank of both together, in numpy."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        keys = (left.astype(np.int64) << BITS) | right
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, dtype=np.int64), np.full(1 << self.bits, NONE, dtype=np.int32)
        waiting, slot = np.arange(len(keys)), self.slot(keys)
        while len(waiting):
            free = np.flatnonzero(self.keys[slot] == -1)
            taken, first = np.unique(slot[free], return_index=True)
            done = free[first]
            self.keys[taken], self.ranks[taken] = keys[waiting[done]], rank[waiting[done]]
            rest = np.ones(len(waiting), dtype=bool)
            rest[done] = False
            waiting, slot = waiting[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * ODD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where there is none or a side is padding (-1)."""
        shape, left, right = left.shape, left.ravel(), right.ravel()
        out = np.full(left.shape, NONE, dtype=np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        keys = (left[at].astype(np.int64) << BITS) | right[at]
        slot = self.slot(keys)
        while len(at):
            held = self.keys[slot]
            hit = held == keys
            out[at[hit]] = self.ranks[slot[hit]]
            on = ~hit & (held != -1)
            at, keys, slot = at[on], keys[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)


class Vocabulary:
    """Merges, tokens as bytes, and token ids of pieces."""

    def __init__(self, tokens: list[bytes]):
        self.ids = {token: i for i, token in enumerate(tokens)}
        self.of_byte = np.array([self.ids.get(bytes([b]), -1) for b in range(256)], dtype=np.int32)
        if (self.of_byte < 0).any():
            raise ValueError("every byte must be a token")
        pairs = [(self.ids[t[:k]], self.ids[t[k:]], i) for i, t in enumerate(tokens) for k in range(1, len(t)) if t[:k] in self.ids and t[k:] in self.ids]
        self.pairs = PairTable(*np.array(pairs, dtype=np.int32).reshape(-1, 3).T)
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts, self.bytes = np.cumsum(self.lengths) - self.lengths, np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def merge_rows(self, tokens: np.ndarray) -> list[np.ndarray]:
        """Token ids of each row of a matrix padded with -1: in each round every row merges its leftmost pair of least
        rank, and loses a column; rows without a pair are done and leave."""
        out: list = [None] * len(tokens)
        row, ranks = np.arange(len(tokens)), self.pairs.of(tokens[:, :-1], tokens[:, 1:])
        while len(row):
            width = tokens.shape[1]
            low = ranks.min(axis=1) if width > 1 else np.full(len(row), NONE)
            if (low == NONE).any():
                for i in np.flatnonzero(low == NONE):
                    out[row[i]] = tokens[i][tokens[i] >= 0].copy()
                live = low != NONE
                row, tokens, ranks, low = row[live], tokens[live], ranks[live], low[live]
                if not len(row):
                    break
            every, at = np.arange(len(row)), ranks.argmin(axis=1)
            tokens[every, at] = low
            kept = np.ones(tokens.shape, dtype=bool)
            kept[every, at + 1] = False
            tokens = tokens[kept].reshape(len(row), width - 1)
            kept = np.ones(ranks.shape, dtype=bool)
            kept[every, at] = False
            ranks = ranks[kept].reshape(len(row), width - 2)
            i = np.flatnonzero(at > 0)
            ranks[i, at[i] - 1] = self.pairs.of(tokens[i, at[i] - 1], tokens[i, at[i]])
            i = np.flatnonzero(at < width - 2)
            ranks[i, at[i]] = self.pairs.of(tokens[i, at[i]], tokens[i, at[i] + 1])
        return out

    def merge_long(self, tokens: np.ndarray) -> np.ndarray:
        """The same for one long row. A round takes the pairs of least rank from the left, none that overlaps one taken, up to
        the first that makes a pair of lower rank: what one merge a round would do next, at once."""
        ranks = self.pairs.of(tokens[:-1], tokens[1:])
        while len(ranks) and (low := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == low)
            fresh = np.concatenate([[True], np.diff(at) > 1])
            began = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - began) % 2 == 0]
            joined = np.concatenate([[False], np.diff(at) == 2])
            padded = np.concatenate([[-1], tokens, [-1]])
            before, after = np.where(joined, low, padded[at]), padded[at + 3]
            same = np.full(len(at), low)
            lower = np.flatnonzero(np.minimum(self.pairs.of(before, same), self.pairs.of(same, after)) < low)
            if len(lower):
                at = at[: lower[0] + 1]
            tokens[at] = low
            tokens, ranks = np.delete(tokens, at + 1), np.delete(ranks, at)
            place = at - np.arange(len(at))
            for i in (place[place > 0] - 1, place[place < len(tokens) - 1]):
                ranks[i] = self.pairs.of(tokens[i], tokens[i + 1])
        return tokens

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece: one id if the piece is a token, otherwise what merging leaves."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ids.get(piece)
            if whole is not None:
                out[i] = np.array([whole], dtype=np.int32)
            elif len(piece) > WIDEST:
                out[i] = self.merge_long(self.of_byte[np.frombuffer(piece, dtype=np.uint8)])
            else:
                buckets.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for width, members in buckets.items():
            step = max(1, MATRIX // width)
            for low in range(0, len(members), step):
                chosen = members[low : low + step]
                tokens = np.full((len(chosen), width), -1, dtype=np.int32)
                sizes = np.array([len(pieces[i]) for i in chosen])
                tokens[np.arange(width) < sizes[:, None]] = self.of_byte[np.frombuffer(b"".join(pieces[i] for i in chosen), dtype=np.uint8)]
                for i, ids in zip(chosen, self.merge_rows(tokens), strict=True):
                    out[i] = ids
        return out

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where each id's end."""
        return spread(self.bytes, self.starts[ids], self.lengths[ids])


def spread(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of values from starts, one behind the other, and where each ends."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)], ends


class Pieces:
    """Pieces met so far and their ids, in one growing array."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex

        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        if self.pattern.groups:
            raise ValueError("the pattern must not capture groups")
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.held, self.ids, self.ends = 0, np.zeros(1 << 16, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def blocks(self, text: str):
        found = (m[0] for m in self.pattern.finditer(text))
        while block := list(islice(found, 1 << 18)):
            yield block

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; what texts of moderate length hold of new pieces is merged together."""
        out: list = [None] * len(texts)
        short = [i for i, text in enumerate(texts) if len(text) < BLOCK]
        found = [self.pattern.findall(texts[i]) for i in short]
        ids, ends = self.of_block([p for pieces in found for p in pieces])
        bounds = np.concatenate([[0], ends])[np.cumsum([0, *map(len, found)])]
        for i, a, b in zip(short, bounds[:-1], bounds[1:], strict=True):
            out[i] = ids[a:b]
        for i, text in enumerate(texts):
            if out[i] is None:
                out[i] = np.concatenate([self.of_block(block)[0] for block in self.blocks(text)])
        return out

    def of_block(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, and where each piece's end."""
        if len(self.number) > REMEMBER or self.held > REMEMBER_BYTES:
            self.forget()
        new = list(set(pieces).difference(self.number))
        if new:
            raw = [p.encode() for p in new]
            made = self.vocabulary.encode(raw)
            self.number.update(zip(new, range(len(self.ends) - 1, len(self.ends) - 1 + len(new)), strict=True))
            self.held += sum(map(len, raw))
            low = self.ends[-1]
            self.ends = np.concatenate([self.ends, low + np.cumsum([len(x) for x in made])])
            if self.ends[-1] > len(self.ids):
                self.ids = np.concatenate([self.ids[:low], np.zeros(2 * int(self.ends[-1]) - low, dtype=np.int32)])
            self.ids[low : self.ends[-1]] = np.concatenate(made)
        at = np.fromiter(map(self.number.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        return spread(self.ids, self.ends[at], self.ends[at + 1] - self.ends[at])


class Codec:
    """A vocabulary file and a pattern for Spark: the tokens are broadcast, tables are made once in a worker."""

    def __init__(self, path: str, pattern: str):
        self.tokens, self.pattern = read_ranks(path), pattern

    def encode(self, df: DataFrame, column: str = "text", to: str = "ids") -> DataFrame:
        """df with the token ids of `column` (array of int) in place of any column `to`; null text counts as empty: no ids.

        Each match of the pattern is encoded alone; what it doesn't match has no ids. A batch's new pieces are merged
        together, one matrix for each power of two of lengths; those of more than 64 bytes are one row each, which merges
        all leftmost pairs of the least rank a round, as far as that is what one at a time would do. A task remembers
        a bounded number of pieces. Texts are taken whole, repeats and ties change nothing.
        """
        spark, kept = df.sparkSession, df.drop(to)
        bounded_batches(spark)
        rows = kept.withColumn("_text", text_or_empty(column))
        out = StructType([*kept.schema.fields, StructField(to, ArrayType(IntegerType(), False))])
        shared, pattern = Shared(spark, self.tokens), self.pattern

        def run(batches):
            pieces = Pieces(made_once(shared), pattern)
            for batch in batches:
                for part in parts(batch, batch.num_columns - 1):
                    ids = pieces.of(part.column(part.num_columns - 1).to_pylist())
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists(ids)], names=out.names)

        return rows.mapInArrow(lean(run, keep=True), out)

    def decode(self, df: DataFrame, column: str = "ids", to: str = "decoded") -> DataFrame:
        """df with the bytes of the ids of `column` in place of any column `to`; a null list gives null, an empty one no bytes.
        An id that the vocabulary lacks is an error."""
        spark, kept = df.sparkSession, df.drop(to)
        bounded_batches(spark)
        rows = kept.withColumn("_ids", F.col(column).cast("array<int>"))
        out = StructType([*kept.schema.fields, StructField(to, BinaryType())])
        shared = Shared(spark, self.tokens)

        def run(batches):
            vocabulary = made_once(shared)
            for batch in batches:
                for low in range(0, batch.num_rows, 64):
                    part = batch.slice(low, 64)
                    lists_ = part.column(part.num_columns - 1)
                    ids = lists_.fill_null([]) if lists_.null_count else lists_
                    flat = ids.flatten().to_numpy(zero_copy_only=False)
                    if len(flat) and not (0 <= flat.min() and flat.max() < len(vocabulary.lengths)):
                        raise ValueError("an id is not in the vocabulary")
                    data, ends = vocabulary.decode(flat)
                    bounds = np.concatenate([[0], ends])[offsets_of(ids) - offsets_of(ids)[0]]
                    whole, missing = data.tobytes(), lists_.is_null().to_pylist()
                    texts = [None if gone else whole[a:b] for a, b, gone in zip(bounds[:-1], bounds[1:], missing, strict=True)]
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, type=pa.binary())], names=out.names)

        return rows.mapInArrow(lean(run, keep=True), out)


def lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int32)))


def made_once(shared: Shared) -> Vocabulary:
    state, key = worker_state(), ("byte_bpe", len(shared.held.value), hash(shared.held.value))
    if key not in state:
        state.clear()
        state[key] = Vocabulary(shared.value)
    return state[key]
