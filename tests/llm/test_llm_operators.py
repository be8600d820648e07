"""Training-data operators against brute force, on tables with nulls, empty and very long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.llm import chat, exact_dedup, jaccard_join, language_id, mixing, neighbours, packing, quality, repeats, sharding
from braidwork.llm.common import prefix_sums
from braidwork.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, shard string, rank string, label int, `group` string, size int, n int"
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of():
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "Eps", "zeta,", "eta.", "été", "naïve", "straße", "日本", "x1"]
    say = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    base, passage = say(60), say(40)
    long = say(9000)
    texts = [None, "", " \t\n", "one", "a b c d", "1234 !!", base, base, base.replace(" ", "\n\t"), base + " tail", "head " + base, base.upper(), passage, say(50) + " " + passage, passage + " " + say(80), say(30) + " " + passage + " " + say(30), long, long[:-5], "z" * 500, "ab " * 200, "日本語 " * 60]
    for i in range(40):
        w = base.split()
        w[rng.randrange(60)] = f"new{i}"
        texts.append(" ".join(w))
    texts += [say(rng.randrange(1, 120)) for _ in range(30)]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s2", "s2", None, ""]), 0) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return [r + ("k", "s", "r", 1, "g", 2, 3) for r in rows]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows_of(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Null ids, one id with several texts, one row twice."""
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    rest = ("en", "s", 0, "k", "s", "r", 1, "g", 2, 3)
    long = " ".join(f"word{i}" for i in range(50))
    rows = [(None, long), (None, None), (1, long), (1, "other text of this id"), (1, long), (2, long + " more"), (3, long + " more"), (3, long + " more")]
    spark.createDataFrame([r + rest for r in rows], SCHEMA).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(df):
    return {r.doc_id: r.text or "" for r in df.collect()}


def test_prefix_sums(docs):
    df = docs.select("doc_id", F.coalesce("source", F.lit("-")).alias("s"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("w"))
    got = prefix_sums(df, "s", "w", ["doc_id"], 100).collect()
    for s in {r.s for r in got}:
        at = 0
        for r in sorted((r for r in got if r.s == s), key=lambda r: (r.before, r.w)):
            assert r.before == at
            at += r.w
        assert {r.total for r in got if r.s == s} == {at}


# 1, packing.


def check_pieces(pieces, texts, tokenizer):
    """texts: (doc_id, text) for every row."""
    ids = Counter()
    for d, t in texts:
        ids[d, tuple(tokenizer.encode(t, add_special_tokens=False).ids + [2])] += 1
    for (d, x), n in ids.items():
        arr = np.array(x, dtype="<u4")
        mine = [p for p in pieces if p.doc_id == d and p.doc_tokens == len(x)]
        assert sum(p.length for p in mine) == len(x) * sum(c for (e, y), c in ids.items() if e == d and len(y) == len(x))
        if sum(c for (e, y), c in ids.items() if e == d and len(y) == len(x)) == 1:
            at = 0
            for p in sorted(mine, key=lambda p: p.start):
                assert p.start == at and zlib.crc32(arr[at : at + p.length].tobytes()) == p.ids_crc32
                at += p.length
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append(p)
    for s, ps in by.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 4096 or s == max(by)
    assert sorted(by) == list(range(len(by)))
    return by


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))


def test_packing(docs, odd, empty, tokenizer):
    path = tokenizer_file("word_bpe_49k.json")
    by = check_pieces(packing.pack(docs, path).collect(), list(texts_of(docs).items()), tokenizer)
    assert len(by) > 5
    check_pieces(packing.pack(odd, path).collect(), [(r.doc_id, r.text or "") for r in odd.collect()], tokenizer)
    assert packing.pack(empty, path).count() == 0
    with_ids = packing.pack(odd, path, with_ids=True).collect()
    assert all(zlib.crc32(np.array(p.ids, dtype="<u4").tobytes()) == p.ids_crc32 for p in with_ids)


@pytest.mark.parametrize("mixture", [None, {"s00": 3, "s01": 1}, {f"s{i:02}": 1 if i < 20 else 2 for i in range(25)}])
def test_more_sources_than_queues(spark, tokenizer, tmp_path, monkeypatch, mixture):
    """The mixture holds, and each source keeps its proportion, those that share a queue too."""
    monkeypatch.setattr(packing, "MAX_QUEUES", 6)
    rng = random.Random(8)
    rows = [(100 * s + i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randrange(90, 110))), f"s{s:02}") for s in range(30) for i in range(50 if s < 2 else 20)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(2).write.parquet(str(tmp_path / "d"))
    pieces = packing.pack(spark.read.parquet(str(tmp_path / "d")), tokenizer_file("word_bpe_49k.json"), mixture=mixture).collect()
    by = check_pieces(pieces, [(d, t) for d, t, _ in rows], tokenizer)
    source, longest = {d: s for d, _, s in rows}, max(p.doc_tokens for p in pieces)
    totals = Counter()
    for p in pieces:
        totals[source[p.doc_id]] += p.length
    weights = dict(totals) if mixture is None else mixture
    fills, given = max(1, int(min(totals[s] / w for s, w in weights.items()) * sum(weights.values()) * 0.9 / 4096)), Counter()
    for w in range(fills):
        for p in by[w]:
            given[source[p.doc_id]] += p.length
        for s in totals:
            assert abs(given[s] - (w + 1) * 4096 * weights.get(s, 0) / sum(weights.values())) <= 2 * longest


def test_encoder_is_exact(tokenizer):
    rng = random.Random(1)
    letters = [chr(i) for i in range(0x20, 0x250)] + ["<|endoftext|>", "'s", " 'll", "\t", "\n", "\x0b", "\x1c", "\x85", "\xa0", "日本", "😂", "İ", "ſ", "!!", "...", "don't", "''s"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["", " ", "Word, word. WORD! word's, it's!!"]
    with open(tokenizer_file("word_bpe_49k.json"), encoding="utf-8") as f:
        enc = packing.ChunkEncoder(f.read(), "<u2")
    for t, x in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(x, dtype="<u2").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("totals", [[10_000_000, 30_000, 500, 1], [5], [4096], [1, 1, 1], [100_000, 100_000], [0, 7000]])
@pytest.mark.parametrize("named", [False, True])
def test_windows_hold_the_mixture(totals, named):
    amounts = np.array(totals, dtype=np.int64)
    weights = np.ones(len(totals)) if named else amounts.astype(float)
    phases = packing.plan_windows(amounts, weights)
    assert (sum(p["each"] * p["times"] for p in phases) == amounts).all()
    filled = [int(w) for p in phases for _ in range(p["times"]) for w in np.diff(p["sums"], axis=0).sum(axis=1)]
    assert all(f == 4096 for f in filled[:-1]) and sum(filled) == amounts.sum()
    if not named and len(totals) == 4:
        takes = np.vstack([np.diff(p["sums"], axis=0) for p in phases for _ in range(p["times"])])
        owed = np.cumsum(takes, axis=0) - np.outer(np.arange(1, len(takes) + 1) * 4096, amounts / amounts.sum())
        assert np.abs(owed[:-1]).max() <= 130  # a period's quota is rounded to whole ids


# 2, neighbours.


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(700, 16)).astype(np.float32).tolist()
    vectors[7] = [0.0] * 16
    vectors[8] = [float("nan")] + [1.0] * 15
    vectors[9] = [None] + [1.0] * 15
    vectors[10] = None
    vectors[11] = [1.0, 2.0]
    vectors[12] = []
    for i in range(100, 160):
        vectors[i] = vectors[100]  # ties: one vector many times
    rows = [(i, v, 1, "x") for i, v in enumerate(vectors)] + [(None, vectors[0], 1, "x"), (3, vectors[3], 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rank string")
    got = {}
    for r in neighbours.nearest(df, k=5, every=50).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = {i: np.array(v, dtype=np.float64) for i, v in enumerate(vectors) if i not in (7, 8, 9, 10, 11, 12)}
    hits = total = 0
    for q in range(0, 700, 50):
        scores = {i: float(good[q] @ v / np.linalg.norm(good[q]) / np.linalg.norm(v)) for i, v in good.items() if i != q}
        best = sorted(scores, key=lambda i: (-round(scores[i], 12), i))[:5]
        assert [r for r, _, _ in sorted(got[q])] == [1, 2, 3, 4, 5]
        assert all(abs(scores[i] - s) < 1e-12 for _, i, s in got[q])
        hits, total = hits + len({i for _, i, _ in got[q]} & set(best)), total + 5
        if q in (100, 150):
            assert [i for _, i, _ in sorted(got[q])] == [i for i in range(100, 160) if i != q][:5]
    assert hits / total >= 0.9
    assert neighbours.nearest(df.where("vec_id < 0"), 5).count() == 0
    few = neighbours.nearest(df.where("vec_id IN (0, 1, 2)"), 5).collect()
    assert sorted((r["rank"], r.vec_id) for r in few) == sorted((r["rank"], r.vec_id) for r in few) and {r.vec_id for r in few} == {1, 2}


# 3, mixing.


@pytest.mark.parametrize("block", [256, 7])
def test_mixing(docs, empty, block):
    got = mixing.mixture_counts(docs, block_words=block).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    sizes = {d: len(WORD.findall(t)) for d, t in texts_of(docs).items()}
    assert {r.doc_id: r.size for r in got} == sizes
    names = sorted({s for s in source.values() if s is not None}, key=lambda s: s.encode()) + [None]
    total = Counter()
    for d, n in sizes.items():
        total[source[d]] += n
    targets, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    weight = {s: [3, 1, 2][i % 3] for i, s in enumerate(names)}
    while open_:
        w = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / w > 2 * total[s]}
        targets |= {s: 2.0 * total[s] for s in above} if above else {s: left * weight[s] / w for s in open_}
        open_ = open_ - above if above else set()
        left = 1.5 * sum(sizes.values()) - sum(targets[s] for s in targets)
    taken = Counter()
    for r in got:
        assert r.source_size == total[source[r.doc_id]] and abs(r.target - targets[source[r.doc_id]]) < 1e-6
        assert r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 1 for s in names)
    assert sorted(got) == sorted(mixing.mixture_counts(docs, block_words=block).collect())
    assert mixing.mixture_counts(empty).count() == 0


def test_mixing_of_many_sources(spark, monkeypatch):
    """Sources in many cells, slots in many ranges: each source near its target, shards of equal size, every slot dealt once."""
    monkeypatch.setattr(mixing, "CELL_SOURCES", 50)
    monkeypatch.setattr(mixing, "RANGE_SLOTS", 7)
    rows = [(i, "w " * (400 if i % 300 == 0 else 1 + i % 5), f"s{i // 2:04d}") for i in range(1200)] + [(-i, "hot words here", "hot") for i in range(1, 600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    facts, pieces, sources = mixing.mix(docs, block_words=5, shards=8)
    plan = {r.source_key: r for r in sources.collect()}
    assert [k for k, _ in sorted(plan.items(), key=lambda x: x[1].source)] == sorted(plan)
    ranges, total = mixing.drawn_counts(sources, 8, 3)
    by_shard, dealt = Counter(), {}
    for r in ranges.collect():
        by_shard[r.shard] += r.high - r.low
        dealt.setdefault(r.source_key, []).append((r.low, r.high))
    assert sum(by_shard.values()) == total and max(by_shard.values()) - min(by_shard.values()) <= 1
    for key, parts in dealt.items():
        parts.sort()
        assert parts[0][0] == 0 and parts[-1][1] == plan[key].slots and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
    got = Counter()
    for r in pieces.collect():
        got[r.source_key] += r.n_words
    assert all(abs(got[k] - p.target) <= 1 and p.target <= 2 * p.words for k, p in plan.items())
    assert abs(sum(p.target for p in plan.values()) - 1.5 * sum(p.words for p in plan.values())) < 1e-6


def test_water_level(spark):
    """As shares that are filled source by source until none is above its bound."""
    rng = random.Random(5)
    for n in (1, 2, 50):
        rows = [(float(rng.choice([3, 1, 2])), rng.randrange(0, 10 ** rng.randrange(1, 7))) for _ in range(n)]
        budget = 1.5 * sum(w for _, w in rows)
        level = mixing.water_level(spark.createDataFrame(rows, "weight double, words long"), budget, 2.0)
        assert abs(sum(min(level * w, 2.0 * size) for w, size in rows) - budget) <= 1e-6 * max(budget, 1)


def test_mixed_documents(docs):
    counts = {r.doc_id: r.taken for r in mixing.mixture_counts(docs).collect()}
    got = Counter()
    texts = texts_of(docs)
    for r in mixing.mixed_documents(docs).collect():
        got[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text) and all(line in texts[r.doc_id] for line in r.text.split("\n") if "\n" not in texts[r.doc_id])
    assert {d: n for d, n in counts.items() if n} == dict(got)


def test_mixing_of_odd_tables(spark, odd, empty):
    """Null and repeated ids: every row is a document of its own, told apart by its text."""
    got = mixing.mixture_counts(odd, block_words=7).collect()
    sizes = sorted((str(r.doc_id), len(WORD.findall(r.text or ""))) for r in odd.collect())
    assert sorted((str(r.doc_id), r.size) for r in got) == sizes
    assert all(r.taken <= 2 * r.size for r in got) and abs(sum(r.taken for r in got) - 1.5 * sum(n for _, n in sizes)) <= 1
    rows = [(None, f"w{i} " * (1 + i % 3), "en" if i % 2 else None, "s") for i in range(60)] + [(None, "same text", "en", "s")] * 20
    many = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    texts = Counter((r.text, r.lang) for r in many.collect())
    out = mixing.mixed_documents(many).collect()
    assert {r.doc_id for r in out} == {None}
    whole = Counter((r.text, r.lang) for r in out if (r.text, r.lang) in texts)
    assert all(n <= 2 * texts[k] for k, n in whole.items()) and sum(texts.values()) <= sum(whole.values())
    assert abs(sum(len(WORD.findall(r.text)) for r in out) - 1.5 * sum(len(WORD.findall(t)) * n for (t, _), n in texts.items())) <= 1
    assert mixing.mixed_documents(empty).count() == 0


def test_permutation_and_counts():
    for size in (1, 2, 3, 17, 1000):
        assert sorted(mixing.permute(np.arange(size), size, 5).tolist()) == list(range(size))
    counts = mixing.draw_counts(np.array([1000, 10, 0, 400]), 7, 1)
    assert counts.sum(axis=0).tolist() == [1000, 10, 0, 400] and np.ptp(counts.sum(axis=1)) <= 1


# 4, chat.


def test_chat_events_fold():
    talk = chat.Conversation(1)
    for kind, target, role, text in [
        ("open", None, "user", "hi"), ("open", None, "assistant", "he"), ("delta", None, "assistant", "llo"), ("open", None, "user", "what"),
        ("edit", 0, "user", "hey"), ("open", None, "assistant", "bad"), ("regenerate", None, "assistant", ""), ("delta", 1, "assistant", "goo"), ("delta", None, "assistant", "d"),
        ("delta", 9, "user", "lost"), ("edit", 7, "user", "lost"), ("nonsense", None, "user", "lost"),
    ]:
        talk.fold(kind, target, role, text)
    assert [(r, "".join(t)) for r, t in talk.messages] == [("user", "hey"), ("assistant", "good")]


@pytest.mark.parametrize("text", ["", "plain", "</s>[INST] ok [/INST]", "<s><<SYS>>x<</SYS>>\\l\\", "[", "\\b[\\", "<<ROLE a>>b<</ROLE>>", "é日本😂"])
def test_chat_template_is_reversible(text):
    turns = [("user", text), ("assistant", text), ("system", text), ("tool>>x", text), ("assistant", ""), ("user", text)]
    talk = chat.Conversation(0)
    for role, t in turns:
        talk.fold("open", None, role, t)
    formatted, spans = talk.rendered()
    assert chat.parse(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert not any(m in chat.escape(text) for m in [*chat.OPENS.values(), *chat.CLOSES.values()])


def test_chat_query(spark):
    rows = [(c, t, r, x, "extra") for c in (1, 2, None) for t, r, x in [(2, "user", "c"), (0, "system", None), (1, "assistant", "b" * 5000), (3, None, "d"), (1, "assistant", "tie")]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.digests(chat.format_events(chat.conversation_events(df), chat.SEQUENCE)).collect()}
    assert set(got) == {1, 2, None}
    turns = [("system", ""), ("assistant", "b" * 5000), ("assistant", "tie"), ("user", "c"), ("user", "d")]
    for r in got.values():
        assert r.n_turns == 5 and r.loss_chars == 5003
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(("b" * 5000 + "tie").encode()).hexdigest()
    assert chat.digests(chat.format_events(chat.conversation_events(df.where("turn < 0")), chat.SEQUENCE)).count() == 0


def test_chat_query_depends_on_the_fold(spark, monkeypatch):
    """Without edits, regenerations or the order of events the query's messages are wrong."""
    df = spark.createDataFrame([(1, t, r, f"{r} says {t} things") for t, r in enumerate(["system", "user", "assistant", "user", "assistant"])], "conv_id long, turn long, role string, text string")
    events = chat.conversation_events(df)
    assert {r.kind for r in events.select("kind").collect()} == {"open", "delta", "edit", "regenerate"}
    right = chat.digests(chat.format_events(events, chat.SEQUENCE)).first()
    assert right.turns_sha256 == hashlib.sha256("".join(f"{r.role}\n{r.text}\n" for r in df.orderBy("turn").collect()).encode()).hexdigest()
    for kind in ("edit", "regenerate", "delta"):
        assert chat.digests(chat.format_events(events.where(F.col("kind") != kind), chat.SEQUENCE)).first().turns_sha256 != right.turns_sha256
    assert chat.digests(chat.format_events(events, ["turn"])).first().turns_sha256 != right.turns_sha256


# 5, language.


def test_language(spark, empty):
    rng = random.Random(0)
    kinds = {"aa": "kolo mera tundi sabak", "bb": "xyr qwent zlop vhix"}
    rows = [(i, " ".join(rng.choice(kinds[l].split()) + rng.choice(["", "s", "n"]) for _ in range(rng.randrange(3, 60))), l, "s", 0, "k", "s", "r", 1, "g", 2, 3) for i in range(300) for l in [rng.choice(["aa", "bb"])]]
    odd = [(1000, None), (1001, ""), (1002, "12 !! ??"), (1003, "日本"), (None, "kolo mera tundi"), (1004, "xyr qwent " * 20_000)]
    rows += [(d, t, None, "s", 0, "k", "s", "r", 1, "g", 2, 3) for d, t in odd]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    held = [r for r in rows if r[0] is not None and r[0] < 1000 and zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert held and all(got[r[0]].lang_pred == r[2] and got[r[0]].held_out for r in held)
    assert [got[d].lang_pred for d in (1000, 1001, 1002, None, 1004)] == ["und", "und", "und", "aa", "bb"]
    assert got[1003].lang_pred in kinds and all(0 <= r.score <= 1 for r in got.values())
    kept = {r.doc_id for r in language_id.keep_identified(df).collect()}
    assert kept == {r[0] for r in rows} - {1000, 1001, 1002, 1003}
    assert language_id.keep_identified(df).columns == df.columns
    assert language_id.identify(empty).count() == 0
    assert {r.lang_pred for r in language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_against_sets(spark):
    """The filters against plain sets of n-grams (few n-grams in wide filters: next to no false positive)."""
    rng = random.Random(8)
    kinds = {k: ["".join(rng.choice(k) for _ in range(6)) for _ in range(30)] for k in ("abcdefgh", "efghijkl", "ijklmnop")}
    rows = [(i, " ".join(rng.choice(kinds[k]) for _ in range(rng.randrange(1, 12))), k) for i in range(240) for k in [rng.choice(list(kinds))]]
    rows += [rows[0], rows[0], (None, rows[1][1], None), (None, rows[1][1], None)]  # repeated rows, null ids
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def grams_of(text):
        padded = f" {text}  ".encode()
        return [padded[i : i + 4] for i in range(len(padded) - 3) if padded[i : i + 4].strip()]

    counts = {k: Counter() for k in kinds}
    for d, text, lang in rows:
        if lang is not None and zlib.crc32(str(d).encode()) % 5:
            counts[lang].update(grams_of(text))
    counts = {k: {g: n for g, n in c.items() if n > 1} for k, c in counts.items()}
    part = {k: {g: n / sum(c.values()) for g, n in c.items()} for k, c in counts.items()}
    own = {k: {g for g, p in c.items() if p >= language_id.OWN * max(part[o].get(g, 0) for o in kinds)} for k, c in part.items()}
    hits = lambda text: [sum(g in own[k] for g in grams_of(text)) for k in sorted(kinds)]
    got = language_id.identify(df).collect()
    assert len(got) == len(rows)
    said = {(r.doc_id, round(r.score, 3), r.lang_pred) for r in got}
    for d, text, _ in rows:
        found = hits(text)
        first, second = sorted(found)[::-1][:2]
        score = first / (first + second) if first else 0.0
        answers = {(p, s) for i, s, p in said if i == d}
        assert len(answers) == 1 and abs(next(iter(answers))[1] - score) < 0.02
        if first - second > 1:
            assert next(iter(answers))[0] == sorted(kinds)[found.index(first)]


def test_more_languages_than_bits_of_a_word(spark):
    """Each of 70 languages is learned, the rare ones too."""
    rng = random.Random(4)
    kinds = {f"l{i:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)] for i in range(70)}
    rows = [(100 * i + j, " ".join(rng.choice(w) for _ in range(30)), l) for i, (l, w) in enumerate(kinds.items()) for j in range(12 if i < 64 else 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(df).collect()}
    assert got == {d: l for d, _, l in rows}
    assert language_id.LanguageFilters([], {}).counts(np.empty(0, np.uint8), np.zeros(2, np.int64)).shape == (1, 0)


def test_false_positives_are_corrected():
    rng = np.random.default_rng(0)
    members = {l: rng.integers(0, 2**32, 400_000, dtype=np.uint64).astype(np.uint32) for l in range(3)}
    filters = language_id.LanguageFilters(["a", "b", "c"], members)
    assert (filters.false_rate > 0.01).all()
    data = rng.integers(97, 123, 40_000).astype(np.uint8)
    raw = filters.counts(data, np.array([0, len(data)]))
    assert raw.max() < 0.01 * len(data)


# 6, Jaccard join.


def brute_components(texts):
    sets = {}
    for d, t in texts.items():
        w = WORD.findall(t.translate(LOWER))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {d: d for d in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize("small", [4, 1])
def test_jaccard(docs, empty, odd, monkeypatch, small):
    monkeypatch.setattr(jaccard_join, "SMALL_RUN", small)
    monkeypatch.setattr(jaccard_join, "RUN_ROWS", 50)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked(docs).collect()}
    assert got == brute_components(texts_of(docs))
    assert jaccard_join.linked(empty).count() == 0
    rows = jaccard_join.linked(odd).collect()
    assert len(rows) == 8
    assert {(r.n_shingles, r.component_id) for r in rows if r.doc_id is None} == {(46, 1), (0, None)}
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, (_, c) in got.items() if d == c}


@pytest.mark.parametrize("sets", [2, 3])
def test_jaccard_tiles(docs, odd, monkeypatch, sets):
    """Clusters cut into tiny tiles: dealt anew, then compared by pairs of tiles."""
    monkeypatch.setattr(jaccard_join, "TILE_SETS", sets)
    monkeypatch.setattr(jaccard_join, "SLICE_TOKENS", 100)
    monkeypatch.setattr(jaccard_join, "CLUSTER_STEPS", sets - 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked(docs).collect()}
    assert got == brute_components(texts_of(docs))
    assert {(r.n_shingles, r.component_id) for r in jaccard_join.linked(odd).collect() if r.doc_id is None} == {(46, 1), (0, None)}


def test_jaccard_under_the_threshold(spark, monkeypatch):
    """Two thousand texts that all share much and mostly don't link: what is emitted grows with the texts, not with the pairs."""
    monkeypatch.setattr(jaccard_join, "TILE_SETS", 600)
    made = []
    stored = jaccard_join.store
    monkeypatch.setattr(jaccard_join, "store", lambda df, tag: made.append((tag, stored(df, tag))) or made[-1][1])
    rng = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(2000):
        words = list(base)
        for at in (7, 22, 37, 52)[: 1 + (i % 50 > 0)]:
            words[at] = f"x{i}"
        if i % 50 == 1:
            words[3] = f"y{i}"
        texts[i] = " ".join(words[:58] if i % 3 else words)
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked(df).collect()}
    assert got == brute_components(texts)
    assert len({c for _, c in got.values()}) > 1500
    for tag, table in made:
        if tag not in ("jaccard-runs", "jaccard-frequent", "jaccard-units", "jaccard-sums", "jaccard-open"):  # these hold a row for each shingle of a prefix at most
            assert table.count() <= 2 * len(texts), tag


def brute_links(sets, label, mark, tile):
    part = {x: x for x in label}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if mark[i] != mark[j] and (len(set(tile)) == 1 or tile[i] != tile[j]) and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(label[i]), root(label[j])
                part[max(x, y)] = min(x, y)
    return {x: root(x) for x in label}


@pytest.mark.parametrize("case", range(12))
def test_tile_is_exact(case):
    rng = random.Random(case)
    size, alike, pools = rng.choice([3, 12, 60]), rng.choice([0.7, 0.9, 0.97]), rng.choice([1, 5])
    sets = []
    for _ in range(rng.choice([2, 9, 50])):
        base = [1000 * rng.randrange(pools) + k for k in range(size)]
        sets.append({b if rng.random() < alike else rng.randrange(10**6, 10**9) for b in base[: rng.randrange(max(1, size * 2 // 3), size + 1)]})
    label = [rng.randrange(len(sets)) for _ in sets] if case % 2 else list(range(len(sets)))
    mark = [rng.randrange(len(sets)) for _ in sets] if case % 3 else list(range(len(sets)))
    tile = [rng.randrange(2) for _ in sets] if case % 4 == 3 else [0] * len(sets)
    order = {x: rng.random() for x in set().union(*sets)}
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    values = np.array([x for s in sets for x in sorted(s, key=order.get)], dtype=np.int64)
    for way in ("compare", "rows", "listed"):
        t = jaccard_join.Tile(np.array(label), np.array(tile), np.array(mark), values, ends)
        if way != "compare":
            t.compare_rows() if way == "rows" else t.compare_listed(np.bincount(t.column) if len(t.column) else np.zeros(0, dtype=np.int64))
            t.compare_rows = t.compare_listed = lambda *_: None
        a, b = t.compare()
        got = {x: x for x in label} | dict(zip(a.tolist(), b.tolist(), strict=True))
        assert got == brute_links(sets, label, mark, tile)


def test_prefix_bound_holds():
    """Sets that just link share a shingle of their prefixes, at places that pass the filters, in any order."""
    rng = random.Random(2)
    for _ in range(3000):
        n1 = rng.randrange(1, 60)
        common = rng.randrange(0, n1 + 1)
        extra = rng.randrange(0, 25)
        a, b = set(range(n1)), set(range(common)) | set(range(100, 100 + extra))
        if not b or 100 * len(a & b) < 75 * len(a | b):
            continue
        order = {x: rng.random() for x in a | b}
        x, y = sorted(a, key=order.get), sorted(b, key=order.get)
        n, m = np.array(len(a)), np.array(len(b))
        p, q = x[: int(jaccard_join.prefix_length(n))], y[: int(jaccard_join.prefix_length(m))]
        first = next(t for t in x if t in b)
        assert first in p and first in q
        assert jaccard_join.may_link(n, np.array(x.index(first)), m, np.array(y.index(first)))
        need = -(-(len(a) + len(b)) * 75 // 175)
        assert len(set(p) & set(q)) >= min(len(p) - len(a) + need, len(q) - len(b) + need)


# 7, repeats.


def brute_repeats(texts):
    seen, out = set(), {}
    for d in sorted(texts):
        b = texts[d].encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            else:
                seen.add(b[i : i + 100])
        runs = len(re.findall(b"\1+", bytes(gone)))
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def test_repeats_of_heavy_tokens(docs, monkeypatch):
    """Tokens that are dealt by context, as a phrase that many documents share would be."""
    monkeypatch.setattr(repeats, "HEAVY", 0)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(docs).collect()}
    assert got == brute_repeats(texts_of(docs))


@pytest.mark.parametrize("together", [128, 1])
def test_repeats(docs, empty, odd, monkeypatch, together):
    monkeypatch.setattr(repeats, "TOGETHER", together)
    monkeypatch.setattr(repeats, "CONTEXTS", 5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(docs).collect()}
    assert got == brute_repeats(texts_of(docs))
    assert repeats.without_repeats(empty).count() == 0
    rows = [(r.doc_id, r.n_removed) for r in repeats.without_repeats(odd).collect()]
    whole = len(" ".join(f"word{i}" for i in range(50)))
    assert sorted(n for d, n in rows if d == 1) == [0, 0, whole] and sorted(n for d, n in rows if d is None) == [0, whole]
    assert [n for d, n in rows if d == 2] == [whole] and [n for d, n in rows if d == 3] == [whole + 5] * 2


@pytest.mark.parametrize("together", [128, 1])
def test_repeats_when_hashes_collide(docs, monkeypatch, together):
    """With 16 bits of the first hash left, tokens and strings collide all the time; no byte goes or stays for that."""

    class Weak(repeats.Rolling):
        def __init__(self, data, seed=0):
            super().__init__(data, seed)
            self.seed = seed

        def of(self, low, high):
            found = super().of(low, high)
            return found if self.seed else found & np.uint64(0xFFFF << 48)

    monkeypatch.setattr(repeats, "TOGETHER", together)
    monkeypatch.setattr(repeats, "Rolling", Weak)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(docs).collect()}
    assert got == brute_repeats(texts_of(docs))


def test_split_points(spark):
    """Even parts of the sorted sample; a token with many sampled suffixes is named, whatever its rows."""
    tokens = list(range(1000)) + [500] * 300 + [(1 << 64) - 1]
    rows = [(t - (1 << 63), i % 7) for i, t in enumerate(tokens)]
    splitters, heavy = repeats.split_points(spark.createDataFrame(rows, "token long, doc long").repartition(5), 10)
    assert heavy.tolist() == [500]
    assert splitters.tolist() == sorted({sorted(tokens)[-(-len(tokens) * i // 10)] for i in range(1, 10)})
    assert [len(x) for x in repeats.split_points(spark.createDataFrame([], "token long, doc long"), 10)] == [0, 0]


def test_multikey_quicksort():
    rng = np.random.default_rng(0)
    keys = [rng.integers(0, 50, 20_000), rng.integers(0, 9, 20_000), rng.integers(0, 1000, 20_000)]
    order = repeats.multikey_quicksort(keys, small=64)
    rows = list(zip(*(k[order].tolist() for k in keys), strict=True))
    assert rows == sorted(zip(*(k.tolist() for k in keys), strict=True)) and len(set(order.tolist())) == 20_000


# 8, quality.


def test_quality(spark, docs, empty):
    rng = random.Random(0)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        words = [rng.choice("river stone garden walking slowly under trees window".split()) for _ in range(rng.randrange(5, 80))]
        text = " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words)
        rows.append((i, text, None, "s", 0, "k", "s", "r", 1, "g", 2, 3))
        labels.append((i, int(good), 0))
    labels += [(5000, 1, 0), (None, 0, 0), (3, None, 0)]
    rows += [(6000, None, None, "s", 0, "k", "s", "r", 1, "g", 2, 3), (6001, "", None, "s", 0, "k", "s", "r", 1, "g", 2, 3)]
    df, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score(df, marks).collect()}
    assert len(got) == 402 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [(i, g) for i, g, _ in labels if i in got and got[i].held_out and g is not None]
    assert np.mean([got[i].predicted == g for i, g in held]) > 0.95
    assert quality.score(empty, marks).count() == 0
    assert {r.score for r in quality.score(df, marks.where("quality = 9")).collect()} == {0.5}


def test_quality_against_one_solve(spark, docs, odd):
    """Partition-summed equations give the ridge weights of the whole matrix solved at once; odd rows get their scores."""
    rows = [(i, r.text, i % 3 % 2) for i, r in enumerate(docs.collect())]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark int").repartition(5)
    marks = df.selectExpr("doc_id", "mark AS quality")
    model = quality.fit(quality.described(df), marks)
    learn = [(t or "", m) for d, t, m in rows if zlib.crc32(str(d).encode()) % 5]
    stats = np.vstack([quality.statistics(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])) for t, _ in learn])
    assert np.allclose(model.mean, stats.mean(axis=0), atol=1e-4)
    x, y = model.features(stats), np.array([m for _, m in learn], float)
    weights = np.linalg.solve(x.T @ x + quality.RIDGE * len(x) / quality.FEATURES * np.eye(x.shape[1]), x.T @ y)
    assert np.allclose(x @ model.weights, x @ weights, atol=1e-3)
    bins = model.bins(stats)
    pooled = [[y[bins == b].sum(), (bins == b).sum(), [b]] for b in sorted(set(bins))]
    while (fall := next((i for i in range(len(pooled) - 1) if pooled[i][0] * pooled[i + 1][1] >= pooled[i + 1][0] * pooled[i][1]), None)) is not None:
        a, b = pooled[fall], pooled.pop(fall + 1)
        pooled[fall] = [a[0] + b[0], a[1] + b[1], a[2] + b[2]]
    levels = np.maximum.accumulate([(p + 0.5) / (n + 1) for p, n, _ in pooled])
    expected = {b: v for v, (_, _, at) in zip(levels, pooled, strict=True) for b in at}
    assert np.allclose([model.levels[b] for b in bins], [expected[b] for b in bins])
    scores = quality.score(odd, marks).collect()
    assert len(scores) == 8 and all(len({r.score for r in scores if r.doc_id == d}) == 1 for d in (2, 3))
    long = spark.createDataFrame([(1, "word " * 400_000), (2, "word " * 400_000)], "doc_id long, text string")
    assert len({r.score for r in quality.score(long, marks).collect()}) == 1


def test_isotonic_levels_rise():
    count, positive = np.array([4.0, 0, 2, 5, 0, 3]), np.array([1.0, 0, 2, 2, 0, 3])
    levels = quality.isotonic(count, positive)
    assert (np.diff(levels) >= 0).all() and 0 < levels[0] and levels[-1] < 1


def test_statistics_of_odd_texts():
    texts = ["", "a", "\n\n", "AAA!! BBB!!", "é" * 10, " "]
    raw = [t.encode() for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    all_ = quality.statistics(np.frombuffer(b"".join(raw), dtype=np.uint8), starts)
    assert all_.shape == (6, quality.STATISTICS) and np.isfinite(all_).all()
    for i, r in enumerate(raw):
        alone = quality.statistics(np.frombuffer(r, dtype=np.uint8), np.array([0, len(r)]))
        assert np.allclose(alone[0], all_[i])


# 9, sharding.


def test_sharding(docs, odd, empty):
    got = sharding.interleave(docs, shards=7).collect()
    texts, source = texts_of(docs), {r.doc_id: r.source for r in docs.collect()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {d: (len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in texts.items()}
    shards = [[r for r in got if r.shard == s] for s in range(7)]
    assert max(map(len, shards)) - min(map(len, shards)) <= 1
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in shards)
    for name in set(source.values()):
        share = [sum(source[r.doc_id] == name for r in s) for s in shards]
        assert max(share) - min(share) <= 2
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    assert sharding.interleave(odd).count() == 8 and sharding.interleave(empty).count() == 0


def test_sharding_against_sort_and_cut(spark, docs):
    """All rows hashed, ranked within their source, sorted by fractional rank and cut, on one heap."""
    key = ["doc_id", "text_crc32", "size"]
    for df in (docs, docs.withColumn("doc_id", F.lit(None).cast("long"))):
        facts = df.select("doc_id", "source", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), (F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 16).alias("size"))
        rows = [(r.source is None, (r.source or "").encode(), r.h, r.doc_id or 0, r.text_crc32, r["size"]) for r in facts.withColumn("h", F.xxhash64(F.lit(9), *key)).collect()]
        cell = lambda r: (r[2] % 2**64 >> 20) % 256
        ranked, sources = [], {}
        for r in rows:
            sources.setdefault(r[:2], []).append(r)
        for source, of in sources.items():
            for i, r in enumerate(sorted(of, key=lambda r: (cell(r), r[2:]))):
                ranked.append(((i + 0.5) / len(of), source, i, r[3:]))
        ranked.sort()
        expected = sorted((i * 7 // len(ranked), *r[3]) for i, r in enumerate(ranked))
        got = sharding.interleave(df, shards=7).collect()
        assert sorted((r.shard, r.doc_id or 0, r.text_crc32, r["size"]) for r in got) == expected


# 10, exact.


def test_exact(docs, odd, empty):
    groups = {}
    for d, t in texts_of(docs).items():
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t), []).append(d)
    expected = {d: (min(g), len(g), d == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g}
    for capacity in (1 << 18, 1):
        got = exact_dedup.exact_groups(docs, capacity).collect()
        assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == expected
    assert max(r.bucket for r in got) < 1 << 16
    rows = exact_dedup.exact_groups(odd).collect()
    assert len(rows) == 8 and {r.keep_id for r in rows if r.group_size == 3} == {1, 2}
    assert {r.kept for r in rows if r.doc_id is None} == {False, True}
    assert exact_dedup.exact_groups(empty).count() == 0
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(map(min, groups.values()))


def test_exact_goes_through_its_directory(docs):
    """Buckets split until they hold one key; entries whose prefix the directory sends elsewhere are not found."""
    entries = exact_dedup.exact_entries(docs).select("doc_id", "text_sha256")
    keyed = docs.select("doc_id", exact_dedup.normalised().alias("norm")).withColumn("key64", F.xxhash64("norm")).withColumn("digest", F.unhex(F.sha2("norm", 256)))
    guide = exact_dedup.directory(keyed, 1)
    assert guide.where("depth > 8").count() > 0 and guide.groupBy("bucket").count().where("count > 1").count() == 0
    index = exact_dedup.build_index(keyed, guide)
    assert exact_dedup.look_up(keyed, guide, index).count() == entries.count()
    one = guide.orderBy("prefix").first().prefix
    wrong = guide.withColumn("bucket", F.expr(f"IF(prefix = {one}, bucket + 1, bucket)"))
    found = {r.doc_id for r in exact_dedup.look_up(keyed, wrong, index).collect()}
    lost = {r.doc_id for r in exact_dedup.look_up(keyed, guide, index).where(F.shiftrightunsigned("key64", 48) == one).collect()}
    assert lost and found == set(texts_of(docs)) - lost


@pytest.mark.parametrize("drop", [exact_dedup.drop_copies, jaccard_join.keep_one])
def test_rows_decide_one_by_one(spark, drop):
    """Null and repeated ids: a row goes for its own text, never for that of another row with its id."""
    say = lambda k: " ".join(f"{k}w{i}" for i in range(30))
    rows = [(None, say("a")), (None, say("b")), (None, say("c")), (1, say("c")), (2, say("d")), (2, say("c")), (2, say("e")), (3, None), (None, say("f")), (None, say("f"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(str, drop(df).collect())) == sorted(str(r) for r in df.collect() if (r.doc_id, r.text) not in {(None, say("c")), (2, say("c"))})
