"""The pipeline, stage by stage, on generated documents."""

from __future__ import annotations

import os
import random
from collections import Counter

import corpus_pipeline
import duckdb
import pyarrow as pa
import pytest
from braidwork.llm import language_id
from braidwork.llm.queries import ORACLES, QUERIES


def test_stages(spark, tmp_path):
    rng = random.Random(5)
    vocabulary = [f"{a}{b}{c}" for a in "kmt" for b in "aeio" for c in ("ran", "lis", "dop", "ven")]
    rows = []
    for i in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 200))]
        rows.append((i, " ".join(words), "en", rng.choice(["a", "b", None]), 0))
    rows += [(200 + i, rows[i][1].replace(" ", "  "), "en", "a", 0) for i in range(10)]  # exact copies
    rows += [(300 + i, rows[20 + i][1] + " koran", "en", "b", 0) for i in range(10)]  # near copies
    rows += [(400, None, None, "a", 0), (401, "12 !!", None, "b", 0), (402, "", None, None, 0)]  # no language
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out, str(tmp_path)).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        seen.append(out.collect())
        assert name == "packing" or out.columns == corpus_pipeline.COLUMNS
    language, exact, near, mixed, packed = ([r.doc_id for r in rows_] for rows_ in seen)
    assert set(language) == {r[0] for r in rows} - {400, 401, 402}
    assert set(exact) == set(language) - set(range(200, 210))
    assert set(near) == set(exact) - set(range(300, 310))
    assert set(mixed) <= set(near) and max(Counter(mixed).values()) <= 2
    assert set(packed) == set(mixed)
    tokens = Counter()
    for p in seen[4]:
        tokens[p.sequence_id] += p.length
    assert all(n == 4096 for s, n in tokens.items() if s != max(tokens))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen[4])


def test_odd_tables(spark, tmp_path):
    """An empty table gives nothing; rows with null and repeated ids go through for their own texts, extra columns don't disturb."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard string, kept int"
    say = lambda k: " ".join(f"{k}{w}" for w in ("kolo mera tundi sabak vren dilo " * 8).split())
    rows = [(None, say(k), "en", "s", 0, "x", 1) for k in "abc"] + [(7, say(k), "en", None, 0, "x", 1) for k in "de"]
    rows += [(None, say("a"), "en", "s", 0, "x", 1), (8, say("d"), "en", "s", 0, "x", 1), (9, "  ", None, None, 0, "x", 1), (10, None, None, None, None, None, None)]
    for name, of in (("none", []), ("odd", rows), ("blank", rows[-2:])):
        folder = str(tmp_path / name)
        spark.createDataFrame(of, schema).write.parquet(f"{folder}/documents.parquet")
        found = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
        assert found == ({None, 7} if name == "odd" else set())


def test_short_texts_stay(spark):
    """The language stage drops what op5 calls `und`, and nothing else."""
    words = ["kolo mera tundi sabak", "mera sabak kolo", "tundi tundi mera"]
    rows = [(i, words[i % 3] * 3, "en", "a", 0) for i in range(60)]
    rows += [(100, "Re.", "en", "a", 0), (101, "A.", "en", "b", 0), (102, "q", None, "a", 0), (103, "xyzw vux", None, "a", 0), (104, "\u65e5", None, "a", 0), (105, " ", None, "a", 0), (106, "7.", "en", "a", 0), (107, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.keep_languages(spark, docs, "").collect()}
    assert kept == {r[0] for r in rows} - {105, 106, 107}
    assert kept == {r.doc_id for r in language_id.identify(docs).collect() if r.lang_pred != "und"}


def test_language_found_is_used(spark, tmp_path):
    """Documents get the language that is found in their text, and windows are filled from each language in its part."""
    rng = random.Random(8)
    words = {"aa": ["kolo", "mera", "tundi", "sabak"], "bb": ["wihe", "xoqu", "zyfre", "pluge"]}
    rows = [(i, " ".join(rng.choice(words[l]) for _ in range(900)), l, "s", 0) for i, l in enumerate(["aa"] * 20 + ["bb"] * 20)]
    rows += [(40, "kolo mera tundi", None, "s", 0), (41, "wihe xoqu zyfre", "aa", "s", 0), (42, "\u65e5", None, "s", 0), (43, "\u65e5", "aa", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    found = corpus_pipeline.keep_languages(spark, docs, "")
    langs = {r.doc_id: r.lang for r in found.collect()}
    assert langs == {r[0]: r[2] for r in rows} | {40: "aa", 41: "bb"}
    mislabelled = found.where("doc_id < 40")
    pieces = corpus_pipeline.pack_windows(spark, mislabelled, "").collect()
    windows = {}
    for p in pieces:
        windows.setdefault(p.sequence_id, Counter())[langs[p.doc_id]] += p.length
    totals = sum(windows.values(), Counter())
    share = totals["aa"] / totals.total()
    full = [w for w in windows.values() if w.total() == 4096]
    assert len(full) > 5 and all(abs(w["aa"] / 4096 - share) < 0.05 for w in full[:-1])


def test_one_letter_has_an_ngram():
    data, starts = language_id.bytes_of(pa.array(["a", "", "Re.", "!"]))
    keys, text = language_id.grams(data, starts)
    assert text.tolist() == [0, 2, 2, 2] and keys[0] == int.from_bytes(b" a  ", "little")


def test_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
@pytest.mark.parametrize("name", list(ORACLES))
def test_sql(spark, name):
    """Each query that has SQL against DuckDB."""
    data = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for table in ("documents", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{data}/{table}.parquet')")
    got = QUERIES[name](spark, data)
    found = duck.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(found)
