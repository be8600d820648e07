"""Byte-level BPE against another implementation, spelling variants and whitening against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.llm import byte_bpe, chat, queries, spelling, whitening
from braidwork.llm.queries import tokenizer_file

# 4, chat: rows that stand more than once.


def test_chat_repeated_rows(spark):
    said = [(0, "user", "hello world"), (1, "assistant", "fine thanks"), (1, "assistant", "fine thank"), (2, None, "abcdef"), (2, "user", "abcdef"), (3, "tool", "x" * 100), (4, "assistant", "")]
    rows = [(c, t, r, x) for c in (1, 2, None) for t, r, x in said for _ in range(2 if c == 1 else 3)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.conv_id: r for r in chat.digests(chat.format_events(chat.conversation_events(df), chat.SEQUENCE)).collect()}
    for c, r in got.items():
        turns = sorted((t, role or "user", x) for k, t, role, x in rows if k == c)
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256("".join(x for _, role, x in turns if role == "assistant").encode()).hexdigest()
    assert set(got) == {1, 2, None}


# 11, byte-level BPE.


@pytest.fixture(scope="module")
def codec():
    import public_tokenizers

    return byte_bpe.Codec(tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def encoding(codec):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=codec.pattern, mergeable_ranks={t: i for i, t in enumerate(codec.tokens)}, special_tokens={})


def odd_texts():
    rng = random.Random(5)
    alphabet = "aabcde  \n\t\r\x0b\x1c\x1d\x85\xa0 ᠎​ 　﻿'st012½²٣一二日本語ñéß😂👩‍👩‍👧ไทยกำह्।.,!?-_<|endoftext|>\x00\x7f"
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 200))) for _ in range(300)]
    letters = "".join(rng.choice("etaoinshrdlu") for _ in range(30_000))
    return [None, "", " ", "\n\n", "a", "don't we've", "<|endoftext|>", "a" * 5000, "ab" * 3000, "abc" * 700, " " * 3000, "日本語" * 400, "=" * 999, letters, "one two " * 20_000, *made, *made[:20]]


def test_bpe_equals_another_implementation(spark, codec, encoding):
    texts = odd_texts()
    rows = [(i if i % 50 else None, i, t, "clash", [7]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, at int, text string, decoded string, ids array<int>").repartition(5)
    got = {r["at"]: r for r in codec.decode(codec.encode(df)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert list(got[i].ids) == encoding.encode_ordinary(text or ""), text
        assert bytes(got[i].decoded).decode() == (text or "")
    empty = codec.decode(codec.encode(df.where("at < 0")))
    assert empty.count() == 0 and dict(empty.dtypes)["decoded"] == "binary"


def test_bpe_blocks_and_memory(codec, monkeypatch):
    """Texts cut block by block and a memory of a few pieces give the same ids; long rows merge as matrices do."""
    texts = [t or "" for t in odd_texts()]
    vocabulary = byte_bpe.Vocabulary(codec.tokens)
    right = [list(x) for x in byte_bpe.Pieces(vocabulary, codec.pattern).of(texts)]
    monkeypatch.setattr(byte_bpe, "BLOCK", 50)
    monkeypatch.setattr(byte_bpe, "REMEMBER", 10)
    pieces = byte_bpe.Pieces(vocabulary, codec.pattern)
    assert [list(x) for low in range(0, len(texts), 7) for x in pieces.of(texts[low : low + 7])] == right
    monkeypatch.setattr(byte_bpe, "WIDEST", 1)
    assert [list(x) for x in byte_bpe.Pieces(vocabulary, codec.pattern).of(texts)] == right
    assert [list(x) for x in pieces.of([])] == []


def merged_plainly(tokens: list[bytes], piece: bytes) -> list[int]:
    ranks = {t: i for i, t in enumerate(tokens)}
    if piece in ranks:
        return [ranks[piece]]
    now = [piece[i : i + 1] for i in range(len(piece))]
    while len(now) > 1:
        rank, i = min((ranks.get(now[i] + now[i + 1], 1 << 30), i) for i in range(len(now) - 1))
        if rank == 1 << 30:
            break
        now[i : i + 2] = [now[i] + now[i + 1]]
    return [ranks[t] for t in now]


def test_bpe_of_vocabularies_that_were_never_trained():
    """Merges may make pairs of lower rank there, which a round of several merges must not overtake."""
    rng = random.Random(2)
    for _ in range(60):
        made = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6))) for _ in range(40)}
        made = rng.sample(sorted(made), len(made))
        tokens = made[:10] + [bytes([b]) for b in range(256)] + made[10:]
        vocabulary = byte_bpe.Vocabulary(tokens)
        for _ in range(30):
            piece = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 40)))
            right = merged_plainly(tokens, piece)
            assert list(vocabulary.encode([piece])[0]) == right
            if len(piece) > 1 and piece not in vocabulary.ids:
                assert list(vocabulary.merge_long(vocabulary.of_byte[np.frombuffer(piece, dtype=np.uint8)])) == right


def test_bpe_null_lists_and_unknown_ids(spark, codec):
    df = spark.createDataFrame([(1, None), (2, []), (3, [1, 2])], "k int, ids array<int>")
    got = {r.k: r.decoded for r in codec.decode(df).collect()}
    assert got[1] is None and got[2] == b"" and bytes(got[3]) == codec.tokens[1] + codec.tokens[2]
    with pytest.raises(Exception, match="not in the vocabulary"):
        codec.decode(spark.createDataFrame([([1 << 20],)], "ids array<int>")).collect()


def test_bpe_query(spark, tmp_path, encoding):
    texts = odd_texts()[:40]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op11_byte_bpe(spark, str(tmp_path)).collect():
        text = texts[r.doc_id] or ""
        ids = encoding.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


# 12, spelling variants.


def near_plainly(words: list[str]) -> dict[str, set[str]]:
    """Words at one edit, by the patterns that they leave when a code point goes or is blotted out."""
    near = defaultdict(set)
    known, blots = set(words), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            if (short := w[:i] + w[i + 1 :]) in known:
                near[w].add(short)
                near[short].add(w)
            blots[w[:i] + "\0" + w[i + 1 :]].add(w)
    for alike in blots.values():
        for w in alike:
            near[w] |= alike - {w}
    return near


def variants_plainly(n: dict[str, int], ratio: int = 10) -> dict[str, tuple]:
    near, form, out = near_plainly(list(n)), {}, {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n.get(form[w]))
    return out


def slips(docs) -> Counter:
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda x: x[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return Counter({w: c for w, c in count.items() if len(w) >= 7 and c >= 2})


def got_variants(df) -> dict[str, tuple]:
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_spelling_against_brute_force(spark):
    """Copies of long and short words at one and two edits, edits at either end and in the middle, chains of forms, ties."""
    rng = random.Random(4)
    n = {}
    for _ in range(150):
        w = "".join(rng.choice("abç") for _ in range(rng.randrange(2, 15)))
        n[w] = rng.choice([1, 5, 50, 500, 50_000])
        for _ in range(rng.randrange(6)):
            i = rng.randrange(len(w) + 1)
            v = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abç") + w[i:], w[:i] + rng.choice("abç") + w[i + 1 :]])
            if len(v) > 1:
                n.setdefault(v, rng.choice([1, 5, 50, 500, 5000]))
                w = rng.choice([w, v])
    n |= {"z" * 3000: 1, "z" * 2999: 20, "prefix": 1, "suffix": 7}
    df = spark.createDataFrame([(w, c, 9, "x") for w, c in n.items()] + [("ab", 3, 9, "x"), (None, 5, 9, "x"), ("a", 5, 9, "x"), ("", 5, 9, "x")], "word string, n int, near int, root string")
    n["ab"] = n.get("ab", 0) + 3
    right = variants_plainly(n)
    assert sum(f is not None for f, *_ in right.values()) > 50 and any(r != f and f for f, r, *_ in right.values())
    assert got_variants(spelling.variants(df)) == right


@pytest.mark.parametrize("few", [1, 12])
def test_spelling_of_hot_segments(spark, monkeypatch, few):
    """Most words share one half; such segments are halved again until few words share them, without a change in the result."""
    monkeypatch.setattr(spelling, "GROUP", 20)
    monkeypatch.setattr(spelling, "FEW", few)
    rng = random.Random(6)
    tails = {"".join(rng.choice("abcd") for _ in range(rng.randrange(5, 8))) for _ in range(300)}
    n = {w: rng.choice([2, 3, 40, 900]) for t in tails for w in ("inter" + t, t + "ation")}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert got_variants(spelling.variants(df)) == variants_plainly(n)


def test_spelling_query(spark, tmp_path):
    rng = random.Random(8)
    stems = ["".join(rng.choice("abcdeéñxyz") for _ in range(rng.randrange(5, 12))) for _ in range(60)]
    docs = [(rng.choice([None, *range(400)]), " ".join(rng.choice([str.upper, str.lower, str.title])(rng.choice(stems[: rng.randrange(1, 61)])) + rng.choice(["", ",", "9", "×", "œ"]) for _ in range(rng.randrange(200)))) for _ in range(400)]
    docs += [(1, None), (2, ""), (3, "a" * 50_000), (4, "a" * 50_000), docs[5], docs[5]]
    spark.createDataFrame([(*d, "w", 1) for d in docs], "doc_id long, text string, word string, n int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    right = variants_plainly(slips(docs))
    assert sum(f is not None for f, *_ in right.values()) > 20
    assert got_variants(queries.op12_spelling(spark, str(tmp_path))) == right


def test_spelling_of_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([], "word string, n long"), ratio=1)


# 13, whitening.


def whitened_plainly(vectors: list[list[float]]):
    """Grid vectors, fit list, eigenvalues and eigenvectors."""
    x = [[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    sums = [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(len(fit) * a - s) / len(fit) for a, s in zip(row, sums, strict=True)] for row in fit])
    e, v = np.linalg.eigh(centred.T @ centred / len(fit))
    return x, fit, sums, e[::-1], v[:, ::-1]


def check_whitening(rows, vectors, ids):
    x, fit, sums, e, v = whitened_plainly(vectors)
    n, kept = len(fit), min(16, len(sums))
    assert len(rows) == len(vectors) * kept
    by = defaultdict(dict)
    for r in rows:
        by[r.vec_id][r.component] = r
        assert r.n == n and abs(r.explained / (e[r.component - 1] / e.sum()) - 1) < 1e-9 and r.identity_error < 1e-9
    signs = {}
    for i, row in zip(ids, x, strict=True):
        assert set(by[i]) == set(range(1, kept + 1))
        deviation = sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True))
        for k, r in by[i].items():
            right = float(np.array([(n * a - s) / n for a, s in zip(row, sums, strict=True)]) @ v[:, k - 1]) / np.sqrt(e[k - 1])
            assert r.deviation == deviation
            if abs(right) > 1e-3:
                signs.setdefault(k, np.sign(right * r.whitened))
            assert abs(r.whitened - signs.get(k, 1) * right) < 1e-6


def test_whitening_against_brute_force(spark):
    rng = np.random.default_rng(3)
    mixing = rng.normal(size=(20, 20)) * np.logspace(0, -2, 20)
    vectors = [[float(c) for c in np.float32(v)] for v in 3 + rng.normal(size=(400, 20)) @ mixing]
    vectors += [vectors[0]] * 150 + vectors[1:20]  # copies count once
    rows = [(i, v, 1.5, [2.5]) for i, v in enumerate(vectors)]
    odd = [(None, None, 0.0, None), (9000, [float("nan")] * 20, 0.0, None), (9001, [1.0] * 19 + [None], 0.0, None), (9002, [1.0] * 19 + [float("inf")], 0.0, None), (9003, [], 0.0, None), (9004, [1.0] * 19, 0.0, None), (9005, [3e38] * 20, 0.0, None)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, deviation double, whitened array<double>").repartition(5)
    model = whitening.fit(df)
    check_whitening(whitening.components(df, model).collect(), vectors, range(len(vectors)))
    applied = model.apply(df)
    assert applied.count() == len(vectors) and set(applied.columns) == set(df.columns)


def test_whitening_of_doubles_large_values_and_ids(spark):
    rng = np.random.default_rng(4)
    vectors = [[float(c) for c in v] for v in rng.normal(size=(60, 3)) * [5e5, 10.0, 1e3] + [1e12, 0, 0]]
    df = spark.createDataFrame([(f"v{i}", v) for i, v in enumerate(vectors)], "vec_id string, embedding array<double>")
    rows = whitening.components(df, whitening.fit(df)).collect()
    x, fit, sums, e, v = whitened_plainly(vectors)
    assert len(rows) == 180 and {r.component for r in rows} == {1, 2, 3}
    for r in rows:
        right = sum((60 * a - s) ** 2 for a, s in zip(x[int(r.vec_id[1:])], sums, strict=True))
        assert r.deviation == (right if right < 1 << 63 else None)
        assert r.identity_error < 1e-9 and abs(r.explained / (e[r.component - 1] / e.sum()) - 1) < 1e-4
    assert {r.deviation is None for r in rows} == {True, False}


def test_whitening_without_variance(spark):
    same = spark.createDataFrame([(i, [1.0, float(i % 2), 3.0]) for i in range(6)], "vec_id int, embedding array<float>")
    rows = {(r.vec_id, r.component): r for r in whitening.components(same, whitening.fit(same)).collect()}
    assert len(rows) == 18 and all(rows[i, 1].whitened is not None and rows[i, 2].whitened is None and rows[i, 3].explained == 0 for i in range(6))
    assert all(r.n == 2 and abs(abs(r.whitened) - 1) < 1e-12 for (_, k), r in rows.items() if k == 1)
    one = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id int, embedding array<float>")
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in whitening.components(one, whitening.fit(one)).collect()] == [(1, 0, None, None, None)] * 2
    for rows in ([], [(1, None)], [(1, [])]):
        none = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
        assert whitening.components(none, whitening.fit(none)).count() == 0


def test_jacobi_keeps_small_eigenvalues():
    """A scaled matrix whose eigenvalues span twenty powers of ten: the small ones agree with exact rational arithmetic."""
    from fractions import Fraction

    d = np.array([1.0, 1e-5, 1e-10])
    core = np.array([[4.0, 1.0, 0.5], [1.0, 3.0, 0.25], [0.5, 0.25, 2.0]])
    m = core * d[:, None] * d
    e, v = whitening.jacobi(m)
    a = [[Fraction(x) for x in row] for row in m.tolist()]
    det = a[0][0] * (a[1][1] * a[2][2] - a[1][2] ** 2) - a[0][1] * (a[0][1] * a[2][2] - a[1][2] * a[0][2]) + a[0][2] * (a[0][1] * a[1][2] - a[1][1] * a[0][2])
    assert abs(float(Fraction(e[0]) * Fraction(e[1]) * Fraction(e[2]) / det) - 1) < 1e-12
    assert np.abs(v.T @ v - np.eye(3)).max() < 1e-12 and list(e) == sorted(e, reverse=True)
    rng = np.random.default_rng(0)
    b = rng.normal(size=(40, 30))
    e, v = whitening.jacobi(b.T @ b)
    assert np.allclose(e, np.linalg.eigvalsh(b.T @ b)[::-1]) and np.allclose(v @ np.diag(e) @ v.T, b.T @ b)


# Samples that stay samples at any size.


def test_samples_of_very_large_tables(spark):
    from braidwork.llm.common import sampled, threshold

    for rows in (10**6, 10**12, 10**15):
        part = (threshold(20_000 / rows) + (1 << 63)) / 2.0**64
        assert abs(part * rows / 20_000 - 1) < 1e-3
    assert threshold(1.0) == threshold(7.0) == (1 << 63) - 1 and threshold(0.0) == -(1 << 63)
    df = spark.range(100_000)
    assert 1700 < sampled(df, 100_000, 2000, 1, "id").count() < 2300 and sampled(df, 100, 200, 1, "id").count() == 100_000


def test_language_under_one_id(spark):
    """A language whose texts all share an id is learned from a part of them."""
    from braidwork.llm import language_id

    rng = random.Random(0)
    say = lambda words: " ".join(rng.choice(words.split()) for _ in range(12))
    rows = [(1, say("kolo mera tundi sabak vilu"), "xx") for _ in range(3000)] + [(i, say("xyr qwent zlop vhix brau"), "en") for i in range(2, 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, train_texts=500)
    got = language_id.predict(df, model) if hasattr(language_id, "predict") else language_id.identify(df)
    wrong = got.where("doc_id = 1 AND lang_pred != 'xx'").count()
    assert wrong == 0


def test_sharding_of_many_sources_of_one_document(spark):
    """All have the same fractional rank; they are still dealt out, and placed as a sort would."""
    from braidwork.llm import sharding
    from braidwork.llm.common import positions

    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.concat(F.lit("s"), F.col("id") % 5900).alias("source")).repartition(6)
    got = sharding.interleave(df, shards=7).collect()
    sources = Counter(f"1s{i % 5900}" for i in range(6000))
    by_place = sorted(got, key=lambda r: (r.shard, r.slot))
    ones = [r.source_key for r in by_place if sources[r.source_key] == 1]
    assert ones == sorted(ones) and max(Counter(r.shard for r in got).values()) - 6000 // 7 <= 1
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    placed = positions(df.withColumn("f", F.lit(0.5)), ["f", "source", "doc_id"], "at", "test-order")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = placed.collect()
    assert [r.doc_id for r in sorted(rows, key=lambda r: r["at"])] == [r.doc_id for r in df.orderBy("source", "doc_id").collect()]
    chunks = Counter(r["_chunk"] for r in rows)
    assert len(chunks) > 2 and max(chunks.values()) < 4 * 6000 / len(chunks)
