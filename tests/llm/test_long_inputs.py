"""Long texts, many languages, many lines, scripts without spaces, and rows of one id."""

from __future__ import annotations

import time
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitsports.llm import html, language, lines, pii, registry, segmentation, tokens
from pitsports.llm.common import scratch
from tests.oracle import check

public_tokenizers = pytest.importorskip("public_tokenizers")


def counts(n_langs, each, seed=0):
    rng = np.random.default_rng(seed)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz \0", np.uint8).astype(np.int64)
    rows = []
    for k in range(n_langs):
        g = letters[rng.integers(0, 28, (each, 4))]
        g[:, 3] = letters[rng.integers(0, 27, each)]
        gram, n = np.unique((g[:, 0] << 24) | (g[:, 1] << 16) | (g[:, 2] << 8) | g[:, 3], return_counts=True)
        rows.append(pd.DataFrame({"lang": f"l{k:03}", "gram": gram, "n": n}))
    return pd.concat(rows)


def test_language_memory_follows_neither_text_nor_languages():
    rng = np.random.default_rng(1)
    text = "".join(np.array(list("abcdefghij klmnop"))[rng.integers(0, 17, 200_000)])
    model = language.Model(counts(3, 5_000))
    long = text * 100  # 20 MB
    tracemalloc.start()
    got = model.lengths(["short one", long, text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20
    assert got[1] == pytest.approx(got[2] * 100, rel=1e-4) and got[0] == pytest.approx(model.lengths(["short one"])[0])
    many = language.Model(counts(200, 5_000))
    tracemalloc.start()
    many.lengths([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20 and len(many.langs) == 200


def test_language_lengths_do_not_depend_on_blocks(monkeypatch):
    model = language.Model(counts(4, 3_000, 5))
    texts = ["abc def", "", "é ü 字 abcabc", "z" * 300, "hello world " * 40]
    whole = model.lengths(texts)
    for block in (1, 3, 7, 64):
        monkeypatch.setattr(language, "BLOCK", block)
        assert model.lengths(texts) == pytest.approx(whole, abs=1e-9)
        assert np.vstack([model.lengths([t]) for t in texts]) == pytest.approx(whole, abs=1e-9)


def test_a_document_of_many_lines(spark):
    n = 60_000
    text = "\n".join(f"line {i % 20_000} of all" if i % 3 else f"own {i}" for i in range(n))
    rows = [(s, text.replace("own", f"own {s}"), f"s{s}") for s in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    began = time.perf_counter()
    got = lines.clean(df).select("doc_id", "_n_lines", "_n_removed", F.length("text").alias("n")).collect()
    assert time.perf_counter() - began < 40
    assert {(r["_n_lines"], r["_n_removed"]) for r in got} == {(n, n * 2 // 3)}
    assert all(r.n == len("\n".join(f"own {r.doc_id} {i}" for i in range(0, n, 3))) for r in got)


def test_line_sql_with_null_text(spark, tmp_path):
    import duckdb

    df = spark.createDataFrame([(1, None, "a"), (2, "x\ny", "b"), (3, "", None)], "doc_id long, text string, source string")
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    check(spark, con, str(tmp_path), registry.QUERIES["op3_line_dedup"], registry.ORACLE_SQL["op3_line_dedup"])


@pytest.mark.parametrize(
    "article",
    [
        "昨日、東京都内で新しい図書館が開館し、多くの市民が訪れた。館内には約二十万冊の本が並び、静かな閲覧室も用意されている。",
        "新的图书馆昨天在市中心开放，许多市民前来参观。馆内藏书约二十万册，还设有安静的阅览室，深受读者欢迎。",
        "ห้องสมุดแห่งใหม่เปิดให้บริการเมื่อวานนี้ในใจกลางเมืองและมีประชาชนจำนวนมากเข้าเยี่ยมชมภายในมีหนังสือประมาณสองแสนเล่มและห้องอ่านหนังสือที่เงียบสงบ",
        "Новая библиотека открылась вчера в центре города, и её посетило множество жителей. Внутри находится около двухсот тысяч книг, а также тихие читальные залы, которыми можно пользоваться каждый день с утра до позднего вечера, причём совершенно бесплатно.",
    ],
)
def test_articles_without_known_stop_words(article):
    page = f"<html><body><div><a href='/'>ホーム</a> <a href='/x'>more</a></div><p>{article}</p><p><a href='/y'>more</a></p></body></html>"
    assert html.extract(page) == article
    inside = f"<body><ul><li><a href='#'>トップ</a></li></ul><article><h1>題</h1><p>{article}</p></article><div class='footer'><p>{article}</p></div></body>"
    assert article in html.extract(inside) and html.extract(inside).count(article) == 1


def test_dropped_elements_leave_no_text():
    prose = "The new library was opened in the middle of the town and many of the people who live there came to see what it is like."
    page = f"""<body><article><p>{prose} <select><option>XXL</option><option>XL</option></select></p><object data=x><object>inner</object>fall back</object>
<math><mi>x</mi><mo>=</mo></math><svg><text>drawn</text></svg><p>{prose}</p><textarea>typed</textarea><template><p>{prose} hidden</p></template><p>{prose}</p></article></body>"""
    assert html.extract(page) == "\n".join([prose] * 3)
    assert html.extract(f"<article><p>{prose}</p><select><option>open").startswith(prose)  # an end that never comes takes no article with it
    assert html.extract(f"<article><object><p>{prose}</p></article>") == prose


def test_start_follows_the_files_for_rows_of_one_id(spark):
    rows = [(1, "a b c d e f"), (1, "international understanding"), (1, None), (2, "x"), (None, "y z"), (1, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = scratch(spark)
    tokens.write(df, path, public_tokenizers.path("word_bpe_49k.json"))
    files = sorted(tokens.read(spark, path).collect(), key=lambda r: (r.part, r.row))
    assert [r.doc_id for r in files] == [None, 1, 1, 1, 1, 2]
    starts, at = {}, 0
    for r in files:
        starts.setdefault((r.doc_id, r.n_tokens), []).append(at)
        at += r.n_tokens
    got = {}
    for r in tokens.digest(spark, path).collect():
        got.setdefault((r.doc_id, r.n_tokens), []).append(r.start)
    assert {k: sorted(v) for k, v in got.items()} == starts


def all_segmentations(vocabulary, text):
    """{ids: probability} of every way to write ``text`` with pieces of the vocabulary (bytes stand for what no piece covers)."""
    lat = segmentation.Lattices(vocabulary, [text])
    out = {}

    def walk(node, ids, p):
        if node == lat.end[0]:
            out[ids] = out.get(ids, 0.0) + p
            return
        for e in range(lat.first[node], lat.first[node + 1]):
            walk(int(lat.dst[e]), (*ids, int(lat.ids[e])), p * lat.p[e])

    walk(int(lat.root[0]), (), 1.0)
    return out


def test_samples_are_bit_equal_alone_and_in_batches():
    rng = np.random.default_rng(3)
    words = "the of and to in der die und le la que straße été 字 keit ment".split()
    texts = [segmentation._marked(" ".join(words[i] for i in rng.integers(0, len(words), n))) for n in rng.integers(1, 60, 120)]
    keys = np.arange(len(texts))
    vocabulary = segmentation.Vocabulary(segmentation.model_path())
    plain = lambda found: [[(tuple(ids.tolist()), *rest) for ids, *rest in some] for some in found]
    whole = plain(segmentation.Sampler(vocabulary).sample(texts, keys))
    for cut in ([[i] for i in range(len(texts))], [range(0, 7), range(7, 80), range(80, len(texts))], [range(len(texts) - 1, -1, -1)]):
        got = {}
        for part in cut:
            part = list(part)
            got |= dict(zip(part, plain(segmentation.Sampler(vocabulary).sample([texts[i] for i in part], keys[part])), strict=True))
        assert [got[i] for i in range(len(texts))] == whole


@pytest.mark.parametrize("text", ["there", "und", "aab"])
def test_top_k_of_enumerated_lattices(text):
    """Ordered pairs of samples come as often as without-replacement draws of all segmentations would give them."""
    vocabulary = segmentation.Vocabulary(segmentation.model_path())
    marked = segmentation._marked(text)
    exact = all_segmentations(vocabulary, marked)
    assert sum(exact.values()) == pytest.approx(1.0)
    n = 6000
    found = segmentation.Sampler(vocabulary, 2).sample([marked] * n, np.arange(n))
    pairs, first = {}, {}
    for some in found:
        a, b = (tuple(s[0].tolist()) for s in some)
        assert a != b and some[0][1] == pytest.approx(np.log(exact[a])) and some[1][1] == pytest.approx(np.log(exact[b]))
        pairs[a, b] = pairs.get((a, b), 0) + 1
        first[a] = first.get(a, 0) + 1
    for a, p in exact.items():
        assert abs(first.get(a, 0) - n * p) <= 5 * np.sqrt(n * p * (1 - p)) + 1
        for b, q in exact.items():
            if a != b:
                both = p * q / (1 - p)
                assert abs(pairs.get((a, b), 0) - n * both) <= 5 * np.sqrt(n * both) + 1


def test_spans_apart_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(120):
        spans = lambda n: [(int(k), int(s), int(s + d), "v") for k, s, d in zip(rng.integers(0, 4, n), rng.integers(0, 4 * n + 1, n), rng.integers(1, 9, n))]
        n = [0, 1, 5, 70, 200][i % 5]
        rows.append((i, spans(n), spans([0, 3, 40, 150][i % 4]), [int(x) for x in rng.integers(0, 5, n)]))
    span = "array<struct<k:int,s:int,e:int,v:string>>"
    df = spark.createDataFrame(rows, f"i int, found {span}, base {span}, worst array<int>")
    scored = F.zip_with("found", "worst", lambda x, w: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), w.cast("double").alias("worst")))
    got = df.select("i", pii.clear_of(F.col("found"), F.col("base")).alias("clear"), pii.best_apart(scored).alias("best")).collect()
    hit = lambda a, b: a[1] < b[2] and b[1] < a[2]
    for r in got:
        _, found, base, worst = rows[r.i]
        assert sorted(tuple(x) for x in r.clear) == sorted(x for x in found if not any(hit(x, y) for y in base))
        taken = []
        for _, s, k, e in sorted((w, x[1], x[0], x[2]) for x, w in zip(found, worst, strict=True)):
            if not any(hit((k, s, e), y) for y in taken):
                taken.append((k, s, e))
        assert sorted(tuple(x) for x in r.best) == sorted(taken)


def test_a_text_of_many_spans(spark):
    class All(pii.Selector):
        def score(self, x):
            return F.lit(0.5) + x["digits"] / 1000 + x["cue"] / 10

    n = 20_000
    text = " ".join(f"é user{i}@mail.example.org, 0049 30 {2000000 + i}; call" for i in range(n))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.perf_counter()
    got = pii.find(df, All([], [], [0.5] * 4)).select(F.size("base").alias("base"), F.size("spans").alias("spans")).first()
    assert time.perf_counter() - began < 60
    assert tuple(got) == (n, 2 * n)
