"""Nulls, repeated and missing ids, clashing column names, long texts and empty tables; more brute-force twins."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pitsports.llm import contamination, html, jaccard, language, lines, pii, quality, segmentation, suffixes, tokens
from pitsports.llm.common import scratch
from tests.llm.fixtures import SCHEMA, documents, sentence

public_tokenizers = pytest.importorskip("public_tokenizers")

#: Names that operators use inside or return.
CLASHING = "_id string, _key int, _lost string, _doc string, _row string, quality string, n_words string, kept string, llr string, row int, doc int, h int, sig int, n int, _n_lines int, _n_removed string, label int"
SHARED = "a line of boiler plate that is on many of the sites here"


def rows_with_odd_ids():
    rng = random.Random(8)
    passage = sentence(rng, 60)
    texts = [sentence(rng, 90) + "\n" + SHARED for _ in range(12)]
    texts += [passage + " " + texts[0], passage + " " + texts[1], texts[2], texts[2], None, "", "x"]
    ids = [None, None, 7, 7, 7, 2**53 + 1, *range(20, 20 + len(texts) - 6)]
    return [(i, t, "en", f"s{k % 12}", None if t is None else len(t), k, k, "c") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]


@pytest.fixture(scope="module")
def odd(spark):
    rows = rows_with_odd_ids()
    extra = ["x", 1, "x", "x", "x", "x", "words", "maybe", "x", 1, 1, 1, 1, 1, 1, "none", 1]
    return spark.createDataFrame([(*r, *extra) for r in rows], f"{SCHEMA}, {CLASHING}").repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], f"{SCHEMA}, {CLASHING}")


def labels(spark):
    return spark.createDataFrame([(7, 1), (20, 0), (21, 1), (22, 0)], "doc_id long, quality int")


def ids(rows, name="doc_id"):
    return sorted(str(x[name]) for x in rows)


EVERY = sorted(str(r[0]) for r in rows_with_odd_ids())


def test_line_dedup_carries_clashing_columns(spark, odd, none):
    import corpus_pipeline

    out = lines.clean(odd, min_sites=5, min_words=1).collect()
    assert ids(out) == EVERY and all(x._lost == "x" and x._id == "x" for x in out)
    assert sum(x._n_removed for x in out) == 16 and all(SHARED not in (x.text or "") for x in out)
    stage = corpus_pipeline.line_dedup(spark, odd, "")
    assert stage.columns == odd.columns and {x._n_lines for x in stage.collect()} == {1}
    assert corpus_pipeline.line_dedup(spark, none, "").count() == 0


def test_quality_carries_clashing_columns(spark, odd, none, tmp_path):
    import corpus_pipeline

    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    out = quality.judge(odd, labels(spark)).collect()
    assert ids(out) == EVERY and {type(x.kept) for x in out} == {bool} and {x._id for x in out} == {"x"}
    stage = corpus_pipeline.quality_rules(spark, odd, str(tmp_path))
    assert stage.columns == odd.columns and all(x.n_words == "words" and x.kept == "maybe" for x in stage.collect())
    assert stage.count() > 5 and corpus_pipeline.quality_rules(spark, none, str(tmp_path)).count() == 0


def test_quality_places_beyond_a_long(odd, monkeypatch):
    before = {(x.text, x.n_repeat_words) for x in quality.base_columns(odd).collect()}
    monkeypatch.setattr(quality, "PLACE_BITS", 3)
    assert {(x.text, x.n_repeat_words) for x in quality.base_columns(odd).collect()} == before


def test_quality_model_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, sentence(rng, rng.randint(1, 40))) for i in range(40)] + [(90, None), (91, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    model = quality.fit(d, marks, buckets=64)
    h = {x.w: x.h for x in d.select(F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("w")).distinct().select("w", F.xxhash64("w").alias("h")).collect()}

    def grams(text):
        x = [h[w] & (2**64 - 1) for w in (text or "").split()]
        turn = lambda a: ((a << 23) | (a >> 41)) & (2**64 - 1)
        return [a & 63 for a in x] + [(turn(a) ^ b) & 63 for a, b in zip(x, x[1:], strict=False)]

    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i < 20 and i % 2:
            target.update(grams(t))
    expected = [math.log((target[b] + 1) / (sum(target.values()) + 64)) - math.log((raw[b] + 1) / (sum(raw.values()) + 64)) for b in range(64)]
    assert np.allclose(model, expected)
    for x in quality.base_columns(d, model).collect():
        g = grams(x.text)
        assert x.llr is None if not g else abs(x.llr - sum(expected[b] for b in g) / len(g)) < 1e-9


def brute_marks(rows):
    seen, out = set(), []
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    for k in order:
        b = (rows[k][1] or "").encode()
        cover = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                cover[s : s + 100] = b"\1" * 100
            else:
                seen.add(w)
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        out.append((str(rows[k][0]), len(b), sum(cover), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup_of_odd_ids(odd, none):
    got = [(str(x.doc_id), x.n_bytes, x.n_removed, x.kept_sha256) for x in suffixes.remove(odd).collect()]
    expected = brute_marks(rows_with_odd_ids())
    assert sorted(x[:2] for x in got) == sorted(x[:2] for x in expected)
    assert sum(x[2] for x in got) == sum(x[2] for x in expected)  # which of two rows of one id is first is settled by row key
    assert {x for x in got if x[0] not in ("7", "None")} == {x for x in expected if x[0] not in ("7", "None")}
    assert suffixes.remove(none).count() == 0


def test_suffix_index_takes_further_batches(spark):
    rows = sorted((d, t) for d, t, *_ in documents())
    store, got = scratch(spark), {}
    for a in range(0, len(rows), 25):
        part = spark.createDataFrame(rows[a : a + 25], "doc_id long, text string").repartition(2)
        got |= {x.doc_id: (x.n_bytes, x.n_removed, x.kept_sha256) for x in suffixes.add_batch(part, store).collect()}
    assert got == {int(d): (n, gone, sha) for d, n, gone, sha in brute_marks(rows)}
    n = -(-len(rows) // 25)
    assert sorted(map(int, suffixes._manifest(spark, store)["levels"])) == [i for i in range(8) if n >> i & 1]


def test_a_batch_can_be_repeated(spark, tmp_path):
    store = f"{tmp_path}/store"
    passage = "".join(random.Random(8).choices("abcdefghijklm", k=150))
    frame_of = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    rows = lambda df: sorted((x.doc_id, x.n_bytes, x.n_removed, x.kept_sha256) for x in df.collect())
    first = frame_of([(1, passage + "one"), (2, "q" * 10 + passage)])
    second = frame_of([(3, "new " + passage[::-1]), (4, passage)])
    a = rows(suffixes.add_batch(first, store, "a"))
    assert [x[2] for x in a] == [0, 150] and rows(suffixes.add_batch(first, store, "a")) == a
    b = rows(suffixes.add_batch(second, store, "b"))
    assert [x[2] for x in b] == [0, 150]
    for _ in range(2):  # the call is made again: the batch does not meet itself
        assert rows(suffixes.add_batch(second, store, "b")) == b
    (tmp_path / "store" / "level-half").mkdir()  # what a lost call leaves behind is not read
    (tmp_path / "store" / "level-half" / "part-0.parquet").write_bytes(b"broken")
    with pytest.raises(ValueError, match="last batch"):
        suffixes.add_batch(first, store, "a")
    assert [x[2] for x in rows(suffixes.add_batch(first, store, "c"))] == [153, 160]
    assert suffixes._manifest(spark, store)["batches"] == ["a", "b", "c"]


def test_levels_merge_in_order():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 500, 100).astype("S8")) for _ in range(2))
    assert suffixes.Level(a).merged(suffixes.Level(b)).items.tolist() == sorted([*a.tolist(), *b.tolist()])


def test_jaccard_of_clashing_columns(odd, none):
    kept = jaccard.first_of_groups(odd)
    assert kept.columns == odd.columns and kept.count() == len(EVERY) - 2  # one text in three rows; sets that are empty link with none
    assert jaccard.first_of_groups(none).count() == 0


@pytest.mark.parametrize("hot", [(8_000, 8), (10**6, 2)])
def test_rarest_signatures_lose_no_link(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard, "SAMPLE", hot[0])
    monkeypatch.setattr(jaccard, "HOT", hot[1])
    rng = random.Random(11)
    passage, base = sentence(rng, 150), [sentence(rng, 300).split() for _ in range(6)]
    rows = []
    for i in range(60):
        w = list(base[i % 6])
        for _ in range(i // 6 * 2):
            w[rng.randrange(len(w))] = f"new{rng.random()}"
        if i % 2:
            w = passage.split() + w
        rows.append((i, " ".join(w)))
    sets = [frozenset(tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)) for _, t in rows]
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(60):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = {x.doc_id: x.component_id for x in jaccard.connect(spark.createDataFrame(rows, "doc_id long, text string"), jaccard.Rule(5, 80, 100)).collect()}
    assert got == {i: find(i) for i in range(60)} and len(set(got.values())) > 6


def test_containment_of_odd_ids(spark, odd, none):
    item = " ".join(rows_with_odd_ids()[2][1].split()[:40])
    bench = spark.createDataFrame([(1, item), (2, item), (None, item)], "item_id long, text string")
    for limit in (10**6, 0):
        assert sorted((x.doc_id, x.item_id) for x in contamination.search(odd, bench, limit).collect()) == [(doc, item) for doc in (7, 28, 29) for item in (1, 2)]
        assert contamination.search(none, bench, limit).count() == 0


def test_sketch_alone_finds_every_containment():
    rng = np.random.default_rng(3)
    for n in (1, 2, 4, 5, 9, 10, 31, 63, 64, 200):
        h = np.sort(rng.integers(0, 2**63, n))
        top = 2 ** (int(math.log2(n)) + 1) - 1
        m = min(n, top // 5 + contamination.SURPLUS)
        index = contamination.Index(pd.DataFrame({"item_id": 1, "h": h, "in_sketch": np.arange(n) < m}))
        for _ in range(20):
            own = rng.permutation(h)[n // 5 :].astype(np.uint64)
            assert len(index.candidates(own, np.zeros(len(own), np.int64))[0]) == 1


def test_segmentation_of_odd_ids_and_empty_tables(odd, none):
    model = segmentation.model_path()
    out = segmentation.encode(odd, model).collect()
    assert {str(x.doc_id) for x in out} == set(EVERY) and all(x.round_trip for x in out)
    assert sum(x.sample == 1 for x in out) == len(EVERY)
    assert segmentation.encode(none, model).count() == 0


def test_segmentation_of_long_chunks():
    vocabulary = segmentation.Vocabulary(segmentation.model_path())
    rng = random.Random(3)
    texts = ["漢字語文" * 3000, "a" * 3000, "".join(rng.choice("abcdefghij") for _ in range(20_000)), "the cat " * 500]
    out = segmentation.Sampler(vocabulary, 2).sample([segmentation._marked(t) for t in texts], np.arange(4))
    for text, rows in zip(texts, out, strict=True):
        assert all(vocabulary.decode(ids) == text for ids, *_ in rows) and len({tuple(r[0]) for r in rows}) == len(rows)


def test_long_units_have_the_same_probabilities(monkeypatch):
    vocabulary = segmentation.Vocabulary(segmentation.model_path())
    chunks = [segmentation._marked(x) for x in ("unbelievable", "aaaaaaaaaaaaaaaa", "naïve漢字")]
    usual = segmentation.Lattices(vocabulary, chunks)
    for long in (0, 4):
        monkeypatch.setattr(segmentation, "LONG", long)
        other = segmentation.Lattices(vocabulary, chunks)
        e = {(a, b): p for a, b, p in zip(usual.src.tolist(), usual.dst.tolist(), usual.p.tolist(), strict=True)}
        assert all(abs(e[a, b] - p) < 1e-9 for a, b, p in zip(other.src.tolist(), other.dst.tolist(), other.p.tolist(), strict=True))


def test_inclusion_is_the_share_of_draws():
    vocabulary = segmentation.Vocabulary(segmentation.model_path())
    n = 8000
    out = segmentation.Sampler(vocabulary, 2).sample([segmentation._marked("the cat")] * n, np.arange(n))
    estimate = defaultdict(float)  # 1 / inclusion is an unbiased count: each segmentation's expectation is 1
    for rows in out:
        for ids, _, _, include in rows:
            estimate[tuple(ids.tolist())] += 1 / include / n
    likely = Counter(tuple(ids.tolist()) for rows in out for ids, *_ in rows).most_common(3)
    assert all(abs(estimate[s] - 1) < 0.2 for s, _ in likely)


def brute_ppm(train, text):
    counts = [defaultdict(Counter) for _ in range(4)]
    for t in train:
        e = b"\0\0\0" + t.encode()
        for i in range(3, len(e)):
            if e[i]:
                for k in range(4):
                    counts[k][e[i - k : i]][e[i]] += 1
    e, bits = b"\0\0\0" + text.encode(), 0.0
    for i in range(3, len(e)):
        excluded = set()
        for k in (3, 2, 1, 0):
            context = counts[k].get(e[i - k : i])
            if not context:
                continue
            left = {s: n for s, n in context.items() if s not in excluded}
            total, distinct = sum(left.values()), len(left)
            if e[i] in left:
                bits -= math.log2(left[e[i]] / (total + distinct))
                break
            if distinct:
                bits -= math.log2(distinct / (total + distinct))
            excluded |= set(context)
        else:
            bits += math.log2(256 - len(counts[0][b""]))
    return bits


def test_code_lengths_against_brute_force():
    rng = random.Random(2)
    train = {lang: [sentence(rng, 30) + extra for _ in range(4)] for lang, extra in (("a", " über"), ("b", " 漢字"))}
    counts = pd.concat(list(language._grams([pd.DataFrame([(k, t) for k, v in train.items() for t in v], columns=["lang", "text"])])))
    model = language.Model(counts.groupby(["lang", "gram"], as_index=False)["n"].sum())
    texts = [train["a"][0], sentence(rng, 20), "Zürich \0 漢 ★ qqq", "x"]
    for j, lang in enumerate(model.langs):
        assert np.allclose(model.lengths(texts)[:, j], [brute_ppm(train[lang], t) for t in texts], rtol=1e-5)


def test_language_learns_from_no_null_id(odd, none, spark):
    d = odd.withColumn("lang", F.when(F.col("doc_id").isNull(), "zz").otherwise("en"))
    model = language.fit(d)
    assert model.langs == ["en"]
    out = language.predict(odd.withColumn("held_out", F.lit(False)), model).collect()
    assert ids(out) == EVERY
    assert language.predict(none.withColumn("held_out", F.lit(False)), model).count() == 0
    many = spark.createDataFrame([(i, f"word{i} text", f"l{i:04d}") for i in range(1500)], "doc_id long, text string, lang string")
    assert len(language.fit(many).langs) == 1500


def slow_labels(blocks, labels):
    final = list(labels)
    for i, b in enumerate(blocks):
        if labels[i] in ("good", "bad"):
            continue
        same = [j for j, x in enumerate(blocks) if labels[j] in ("good", "bad") and (not b.article or x.article and not x.boilerplate)]
        before, after = max((j for j in same if j < i), default=None), min((j for j in same if j > i), default=None)
        if b.heading and after is not None:
            before = None
        sides = {labels[j] for j in (before, after) if j is not None}
        if not sides:
            final[i] = "good" if b.article or labels[i] == "near" or not b.link_chars else "bad"
        elif len(sides) == 1:
            final[i] = sides.pop()
        elif labels[i] == "near" or b.article:
            final[i] = "good"
        else:
            final[i] = labels[before] if i - before <= after - i else labels[after]
    return final


def test_second_pass_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        blocks = [html.Block("x", rng.choice([0, 1]), rng.random() < 0.2, 0, rng.random() < 0.6, rng.random() < 0.2) for _ in range(rng.randint(0, 25))]
        labels = ["bad" if b.boilerplate else rng.choice(["good", "bad", "near", "short", "short"]) for b in blocks]
        assert html.final_labels(blocks, labels) == slow_labels(blocks, labels)


def test_extraction_keeps_text_with_odd_attributes():
    text = "This is the text of the page and it has a lot of the words that we need in it."
    assert html.extract(f"<article><p title=it's>{text}</p><p class='share-price'>It is at 5.</p></article>") == f"{text}\nIt is at 5."
    assert html.extract(f"<article><p>{text}</p><div class='share-bar'>Share it.</div><p class=ad>Buy.</p></article>") == text
    assert html.extract(f"<article><p>{text}</p><p>a &lt; b &amp;amp; <b title='x > y'>c</b></p></article>") == f"{text}\na < b &amp; c"


def test_extraction_of_many_and_deep_blocks(spark):
    assert html.extract("<li>a b" * 30_000).count("\n") == 29_999
    assert html.extract("<div>" * 30_000 + "x" + "</div>" * 30_000) == "x"
    pages = spark.createDataFrame([(1, "u", "<p>x", 5)] * 2 + [(None, None, None, 1)], "page_id long, url string, html string, text int")
    assert sorted(str((x.page_id, x.text, x.n_chars)) for x in html.main_text(pages).collect()) == ["(1, 'x', 1)", "(1, 'x', 1)", "(None, '', 0)"]
    assert html.main_text(pages.limit(0)).count() == 0


def test_personal_data_in_long_and_odd_texts(spark, odd, none):
    plain = pii.Selector([], [], [2.0] * 4)
    texts = ["a@" + "b." * 100_000 + "c", "x@y.zz " * 3000, "+1 (" * 20_000, "1 2 " * 20_000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {x.doc_id: [(s.k, s.s, s.e) for s in x.spans] for x in pii.find(d, plain).collect()}
    assert found[0] == [(0, 0, len(texts[0]))] and found[1] == [(0, 7 * i, 7 * i + 6) for i in range(3000)] and found[2] == found[3] == []
    assert ids(pii.find(odd, pii.fit(odd)).collect()) == EVERY
    assert pii.find(none, plain).count() == 0 and pii.fit(none).trees == []


def test_running_sums_by_block(spark):
    for n in (0, 1, 63, 64, 65, 128, 1000):
        got = spark.range(1).select(pii.running(F.array_repeat(F.lit(2), n)).alias("x")).first().x
        assert got == [2 * (i + 1) for i in range(n)]


def test_pii_learns_from_every_document(spark):
    """Only a tenth of 24,000 documents holds a number, the tenth with the highest hashes."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)
    d = spark.range(24_000).withColumnRenamed("id", "doc_id").withColumn("text", F.when(place >= 0.9, F.concat(F.lit("call +49 30 1234 "), (1000 + F.col("doc_id") % 9000).cast("string"))).otherwise("room 123 456 7890"))
    assert pii.fit(d).trees


def test_trees_find_formats_that_base_does_not(spark):
    rng = np.random.default_rng(5)
    number = lambda: f"{rng.integers(1, 99)} ({rng.integers(200, 999)}) {rng.integers(200, 999)}-{rng.integers(1000, 9999)}"
    name = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    texts = [f"mail {name()}@{name()}.com or call +{number()} for more" if i % 2 else f"lot {rng.integers(100, 999)} {rng.integers(1000, 9999)} was sold [at] noon" for i in range(600)]
    held_out = [f"mail {name()} [at] {name()} [dot] com or call 00{number()} for more" for _ in range(40)]
    d = spark.createDataFrame(list(enumerate(texts + held_out)), "doc_id long, text string")
    out = {x.doc_id: x for x in pii.find(d, pii.fit(d.where("doc_id < 600"))).collect()}
    found = [{s.k for s in out[i].spans} for i in range(600, 640)]
    assert np.mean([0 in x for x in found]) > 0.9 and np.mean([3 in x for x in found]) > 0.9
    assert all(len(out[i].spans) == 0 for i in range(0, 600, 2))
    assert all({(s.k, s.s, s.e) for s in x.base} <= {(s.k, s.s, s.e) for s in x.spans} for x in out.values())


def test_tokens_of_odd_ids_and_chosen_rows(spark, odd, none):
    from tokenizers import Tokenizer

    path, empty, model = scratch(spark), scratch(spark), public_tokenizers.path("word_bpe_49k.json")
    tokens.write(odd, path, model)
    t = Tokenizer.from_file(model)
    expected = Counter((str(i), zlib.crc32(np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for i, text, *_ in rows_with_odd_ids())
    got = tokens.digest(spark, path).collect()
    assert Counter((str(x.doc_id), x.ids_crc32) for x in got) == expected
    at = 0
    for x in sorted(got, key=lambda x: x.start):
        assert x.start == at
        at += x.n_tokens
    tokens.write(none, empty, model)
    assert tokens.digest(spark, empty).count() == 0
    assert ids(tokens.read(spark, path, [7, 21, 999]).collect()) == ["21", "7", "7", "7"]
    assert ids(tokens.read(spark, path, between=(20, 22)).collect()) == ["20", "21", "22"]


def test_selective_reads_skip_pages_and_columns(spark):
    rng = random.Random(5)
    d = spark.createDataFrame([(i, sentence(rng, 30)) for i in range(6000)], "doc_id long, text string").coalesce(1)
    path = scratch(spark)
    tokens.write(d, path, public_tokenizers.path("word_bpe_49k.json"))
    chosen = tokens.read(spark, path, between=(100, 109), columns=["doc_id", "n_tokens"])
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(doc_id,100\)", plan) and "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert chosen.count() == 10
    import glob

    groups = [(f, g) for f in glob.glob(f"{path}/*.parquet") for m in [pq.ParquetFile(f).metadata] for g in range(m.num_row_groups)]
    assert groups
    for f, g in groups:
        columns = {c.path_in_schema: c for c in (pq.ParquetFile(f).metadata.row_group(g).column(k) for k in range(pq.ParquetFile(f).metadata.num_columns))}
        token = next(c for name, c in columns.items() if name.startswith("ids"))
        assert "RLE_DICTIONARY" in token.encodings and "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
        assert columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index and columns["doc_id"].statistics.has_min_max
        assert pq.ParquetFile(f).metadata.row_group(g).total_byte_size <= 32 << 20


def test_documents_fixture_has_the_cases():
    rows = documents()
    assert any(r[1] is None for r in rows) and any(r[1] == "" for r in rows) and max(len(r[1] or "") for r in rows) > 20_000


def test_every_labelled_document_counts(spark, monkeypatch):
    """More labels than the former bound of 20,000, sent to all tasks or joined by shuffle."""
    labels = spark.range(25_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    docs = spark.range(25_000).selectExpr("id as doc_id", "if(id % 2 = 1, concat('good', id % 7), concat('bad', id % 5)) as text")
    assert quality.labelled(labels).count() == 25_000
    sent = quality.fit(docs, labels, 64), quality.threshold(docs, labels, [0.01 * i for i in range(64)])
    monkeypatch.setattr(quality, "SENT", 10)
    assert (quality.fit(docs, labels, 64), quality.threshold(docs, labels, [0.01 * i for i in range(64)])) == sent
