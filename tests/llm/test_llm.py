"""The ten operators against brute force, SQL, exact round trips or held-out accuracy."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitsports.llm import contamination, html, jaccard, language, lines, pii, quality, registry, segmentation, suffixes, tokens
from pitsports.llm.common import scratch
from tests.conftest import SF
from tests.llm.fixtures import documents, frame
from tests.oracle import check, connect

WHITE = "[\x20\x09-\x0d]+"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
public_tokenizers = pytest.importorskip("public_tokenizers")


def words(text, lower=True):
    text = (text or "").translate(ASCII_LOWER) if lower else (text or "")
    return [w for w in re.split(WHITE, text) if w]


def shingles(text, k, whole):
    w = words(text)
    if len(w) < k:
        return frozenset([tuple(w)] if w and whole else [])
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, name):
    check(spark, connect(SF), SF, registry.QUERIES[name], registry.ORACLE_SQL[name])


# 1: containment


def test_containment_against_brute_force(spark, docs):
    items = [(1, " ".join(words(documents()[0][1] or "a b c d e f g")[:40])), (2, "a b"), (3, None), (4, "")]
    passage = next(t for _, t, *_ in documents() if t and len(t) > 600)
    items += [(5, " ".join(passage.split()[10:60])), (6, " ".join(passage.split()[10:58]) + " zz yy"), (5, " ".join(passage.split()[10:60]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = set()
    for item, text in items:
        s = shingles(text, 5, False)
        for doc, t, *_ in documents():
            common = len(s & shingles(t, 5, False))
            if s and 5 * common >= 4 * len(s):
                expected.add((doc, item, len(s), common))
    for limit in (10**6, 0):
        got = {tuple(x) for x in contamination.search(docs, bench, broadcast_limit=limit).select("doc_id", "item_id", "n_item_shingles", "n_common").collect()}
        assert got == expected and expected


def test_containment_of_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination.search(docs, none).count() == 0
    assert contamination.search(empty, none).count() == 0


# 2: sampled segmentation


def test_segmentation_round_trip_and_distinct(docs):
    got = segmentation.encode(docs, segmentation.model_path(), samples=3).collect()
    by = defaultdict(list)
    for x in got:
        by[x.doc_id].append(x)
    assert set(by) == {d[0] for d in documents()}
    texts = {d[0]: d[1] or "" for d in documents()}
    for doc, rows in by.items():
        assert all(x.round_trip for x in rows)
        assert len({tuple(x.ids) for x in rows}) == len(rows) and [x.sample for x in sorted(rows, key=lambda x: -x.score)] == list(range(1, len(rows) + 1))
        assert all(0 <= x.inclusion <= 1 for x in rows)
        if not texts[doc]:
            assert len(rows) == 1 and list(rows[0].ids) == [] and rows[0].inclusion == 1


def test_segmentation_does_not_depend_on_partitions(docs):
    key = lambda df: sorted((x.doc_id, x.sample, tuple(x.ids), round(x.score, 9)) for x in df.collect())
    model = segmentation.model_path()
    assert key(segmentation.encode(docs.limit(20), model)) == key(segmentation.encode(docs.limit(20).repartition(5), model))


def test_segmentation_decodes_by_column(docs):
    model = segmentation.model_path()
    back = segmentation.decode(segmentation.encode(docs.limit(10), model), model).select("doc_id", "text").collect()
    texts = {d[0]: d[1] or "" for d in documents()}
    assert all(x.text == texts[x.doc_id] for x in back)


def test_segmentation_follows_the_distribution_without_replacement():
    v = segmentation.Vocabulary(segmentation.model_path())
    n = 4000
    out = segmentation.Sampler(v, 2).sample([segmentation._marked("the cat")] * n, np.arange(n))
    p = {tuple(ids.tolist()): np.exp(lp) for rows in out for ids, lp, _, _ in rows}
    first, second = Counter(tuple(r[0][0].tolist()) for r in out), Counter(tuple(r[1][0].tolist()) for r in out)
    for s, q in p.items():
        assert abs(first[s] / n - q) < 0.02
        assert abs(second[s] / n - sum(a * q / (1 - a) for t, a in p.items() if t != s)) < 0.03


def test_segmentation_ids_reach_the_results(spark, docs, tmp_path):
    import corpus_pipeline

    few = docs.limit(12).cache()
    few.write.parquet(f"{tmp_path}/documents.parquet")
    vocabulary = segmentation.Vocabulary(segmentation.model_path())
    texts = {x.doc_id: x.text or "" for x in few.collect()}
    for found in (segmentation.op2_sentencepiece_sampling(spark, str(tmp_path)), corpus_pipeline.encoding(spark, few, str(tmp_path))):
        rows = found.collect()
        assert {x.doc_id for x in rows} == set(texts)
        for x in rows:
            assert vocabulary.decode(np.array(x.ids, np.int64)) == texts[x.doc_id] and x.round_trip
            assert (x.n_tokens, x.ids_crc32) == (len(x.ids), zlib.crc32(np.array(x.ids, "<u4").tobytes()))


# 3: lines


def test_line_dedup_against_brute_force(docs):
    got = {x.doc_id: (x.text, x._n_removed) for x in lines.clean(docs, min_sites=3, min_words=2).collect()}
    spread = defaultdict(set)
    strip = " \t\n\x0b\x0c\r"
    for _, t, _, s, *_ in documents():
        for line in (t or "").split("\n"):
            if s is not None:
                spread[line.strip(strip)].add(s)
    for doc, t, *_ in documents():
        if t is None:
            assert got[doc] == (None, 0)
            continue
        gone = [len(words(x)) >= 2 and len(spread[x.strip(strip)]) >= 3 for x in t.split("\n")]
        assert got[doc] == ("\n".join(x for x, g in zip(t.split("\n"), gone, strict=True) if not g), sum(gone))


def test_line_dedup_repeats_and_removals(spark):
    rows = [(i, "shared line of boiler plate\nown line number " + "x" * i, None, f"s{i}", 1, 1, 1, "c") for i in range(12)]
    out = lines.clean(frame(spark, rows + rows)).collect()
    assert len(out) == 24 and all(x._n_removed == 1 and x.text.startswith("own") for x in out)


def test_line_dedup_of_short_lines(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, f"own line number {i} of this text\nMenu\n Read more \n\nseen on few sites" if i < 9 else f"own line number {i} of this text\nMenu\n Read more \n", None, f"s{i}", 1, 1, 1, "c") for i in range(12)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: (x.n_lines, x.n_removed) for x in lines.op3_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: (5 if i < 9 else 4, 2) for i in range(12)}
    left = {x.doc_id: x.text for x in corpus_pipeline.line_dedup(spark, frame(spark, rows), str(tmp_path)).collect()}
    assert left == {i: f"own line number {i} of this text\n" + ("\nseen on few sites" if i < 9 else "") for i in range(12)}


# 4: suffixes


def brute_marks(rows):
    seen, out = set(), {}
    for doc, t, *_ in sorted(rows):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                cover[s : s + 100] = b"\1" * 100
            else:
                seen.add(w)
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        out[doc] = (len(b), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [(128, 12), (2, 1)])
def test_suffix_dedup_against_brute_force(docs, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot[0])
    monkeypatch.setattr(suffixes, "HOT_IN_TASK", hot[1])
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffixes.remove(docs).collect()}
    assert got == brute_marks(documents())


def test_suffix_levels_merge_geometrically():
    family = suffixes.Family()
    for i in range(7):
        seen = family.scan(np.array([f"{i:03d}".encode() + b"a" * 105, b"zzz" + b"a" * 105], "S108"))
        assert seen.tolist() == [False, i > 0]
    assert sorted(family.levels) == [0, 1, 2]


# 5: language


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    d = d.withColumn("held_out", F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2)
    out = language.predict(d.drop("lang"), language.fit(d.where("not held_out"), sample=200)).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([x.lang == x.lang_pred for x in out]) > 0.98 and all(0 <= x.score <= 1 for x in out)


def test_language_code_lengths_sum_to_one():
    import pandas as pd

    text = b"\0\0\0the cat and the hat"
    grams = [int.from_bytes(text[i : i + 4], "big") for i in range(len(text) - 3)]
    model = language.Model(pd.DataFrame({"lang": "en", "gram": grams, "n": 1}))
    p = np.exp2(-model.bits.reshape(-1, model.size).astype(float))
    assert np.allclose(p.sum(1), 1, atol=1e-4)


def test_language_edge_cases(docs, empty):
    model = language.fit(docs)
    out = {x.doc_id: x for x in language.predict(docs.withColumn("held_out", F.lit(False)), model).collect()}
    for doc, t, *_ in documents():
        und = not any(c.isalpha() for c in t or "")
        assert (out[doc].lang_pred == "und") == und and (not und or out[doc].score == 0)
    nothing = language.fit(empty)
    assert {x.lang_pred for x in language.predict(docs.withColumn("held_out", F.lit(False)), nothing).collect()} == {"und"}


# 6: html


def test_extraction_rules():
    page = """<html><head><title>T</title><script>var a = "</p>";</script></head><body><header>Site</header><nav><a href="/x">Menu</a></nav>
    <div class="cookie-notice">We use cookies and that is the way it is in the world for all of us.</div>
    <article><h1>Head &amp; line</h1><p>The  first\nparagraph of the text has a lot of the words that we need in it.<p>Short one.</p>
    <div class="ad">Buy it now and you will be the one that has it in the end of the day.</div></article>
    <div id="comments"><p>I think that this is the best of the articles that I have read in the year.</p></div>
    <form>Name of the reader that is to be in the list of the names</form><footer>&copy; x</footer>"""
    assert html.extract(page) == "Head & line\nThe first paragraph of the text has a lot of the words that we need in it.\nShort one."


def test_extraction_of_bare_pages():
    text = "This is the text of the page and it has a lot of the words that we need in it."
    page = f"<body><div><a href='a'>Home</a> <a href='b'>News</a></div><p>{text}</p><p>And so on.</p><p>{text}</p><ul><li><a href=c>Old</a></li></ul></body>"
    assert html.extract(page) == f"{text}\nAnd so on.\n{text}"
    assert html.extract(None) == html.extract("") == "" and html.extract("<p>Tiny &#233;") == "Tiny é"


def test_extraction_frame(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>x</p></article>"), (2, None, None), (None, "v", "<p")], "page_id long, url string, html string")
    assert sorted((x.page_id or 0, x.text, x.n_chars) for x in html.main_text(pages).collect()) == [(0, "", 0), (1, "x", 1), (2, "", 0)]


# 7: personal data

PII = ["a.b@c.de x_d@e.f y@z 1.2.3.4.5.6.7.8 999.1.1.1 4111 1111 1111 1111 +1 (301) 555-0346 4111111111111111 +49-30 1234567 é é +12345678",
       "x@y@z.com 0255.1.2.3 4111-1111-1111-1112 ++1 23456789 @", None, "", "1" * 5000, "a" * 20000 + "@b.c"]


def brute_pii(t):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, p in patterns.items():
        for m in re.finditer(p, t or ""):
            v, d = m.group(), re.sub("[^0-9]", "", m.group())
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            ok = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in v.split(".")) or kind == "card" and 16 <= len(d) <= 19 and luhn or kind == "phone" and 8 <= len(d) <= 15
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_against_brute_force(spark):
    d = spark.createDataFrame(list(enumerate(PII)), "doc_id long, text string")
    found = pii.find(d, pii.Selector([], [], [2.0] * 4)).select("doc_id", pii._written("base").alias("base"), pii._written("spans").alias("spans")).collect()
    for x in found:
        assert x.base == x.spans == ",".join(brute_pii(PII[x.doc_id]))


def test_trees_add_spans_and_keep_base(spark):
    rng = np.random.default_rng(2)
    texts = []
    for i in range(400):
        phone = f"+1 ({rng.integers(100, 999)}) 555-{rng.integers(1000, 9999)}"
        texts.append(f"word {phone} and more text" if i % 4 else f"sold {rng.integers(100, 999)} {rng.integers(1000, 9999)} of them")
    texts.append("call +1 (301) 555-0346 190.137.223.20 now")
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {x.doc_id: x for x in pii.find(d, pii.fit(d)).select("doc_id", pii._written("base").alias("base"), pii._written("spans").alias("spans")).collect()}
    assert all(set(x.base.split(",")) <= set(x.spans.split(",")) for x in out.values() if x.base)
    assert "phone:5:22" in out[400].spans and "phone" not in out[400].base


# 8: quality rules


def test_quality_columns_against_brute_force(docs):
    got = {x.doc_id: x for x in quality.base_columns(docs).collect()}
    for doc, t, *_ in documents():
        w = words(t, lower=False)
        at = defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i : i + 3])].append(i)
        cover = {j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
        full = [x for x in (t or "").split("\n") if words(x)]
        x = got[doc]
        assert (x.n_words, x.word_chars, x.n_dup_lines, x.n_repeat_words) == (len(w), sum(map(len, w)), len(full) - len(set(full)), len(cover))
        assert x.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert x.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w))


def test_quality_model_separates_labels(spark):
    rows = [(i, " ".join(["good plain words in order"] * 15 + [f"w{i}"]) if i % 2 else " ".join(["bad### sym%%% noise&&&"] * 20 + [f"w{i}"])) for i in range(200)]
    d = spark.createDataFrame(rows + [(999, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    model = quality.fit(d, labels)
    cut = quality.threshold(d, labels, model)
    out = quality.base_columns(d, model).collect()
    assert all((x.llr >= cut) == bool(x.doc_id % 2) for x in out if x.doc_id < 200)
    assert [x.llr for x in out if x.doc_id == 999] == [None]


def test_quality_of_empty_tables(empty, spark):
    assert quality.judge(empty, spark.createDataFrame([], "doc_id long, quality int")).count() == 0


# 9: Jaccard join


def brute_components(rows, k, num, den):
    sets = {d: shingles(t, k, True) for d, t, *_ in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("rule", [jaccard.Rule(), jaccard.Rule(5, 80, 100), jaccard.Rule(2, 30, 100)])
def test_components_against_brute_force(docs, rule):
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.connect(docs, rule).collect()}
    assert got == brute_components(documents(), rule.width, rule.num, rule.den)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(5)
    rule = jaccard.Rule()
    for n in (5, 8, 20, 60, 200, 900):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        for _ in range(5):
            drop = int(rule.allowed(2 * n) // 2)
            b = np.unique(np.concatenate((rng.permutation(a)[drop:], rng.integers(0, 2**63, drop, dtype=np.uint64))))
            common = len(np.intersect1d(a, b))
            if 100 * common < 85 * (len(a) + len(b) - common):
                continue
            sig, own = jaccard.signatures(rule, np.concatenate((a, b)), np.repeat([0, 1], [len(a), len(b)]), np.array([len(a), len(b)]))
            assert np.intersect1d(sig[own == 0], sig[own == 1]).size


def test_sketch_distance_never_exceeds_the_difference():
    rng = np.random.default_rng(6)
    for n, m in ((100, 110), (500, 560), (3000, 4500)):
        a, b = (np.unique(rng.integers(0, 6000, k, dtype=np.uint64)) for k in (n, m))
        x, y = (np.frombuffer(jaccard._sketches(s, np.zeros(len(s), np.int64), np.array([len(s)]))[0], np.uint64) for s in (a, b))
        w = min(len(x), len(y))
        assert np.bitwise_count(jaccard._folded(x, w) ^ jaccard._folded(y, w)).sum() <= len(np.setxor1d(a, b))


def test_chain_becomes_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    assert {x.comp for x in jaccard.components(links).collect()} == {1, 100}


def test_rows_with_null_or_repeated_ids(spark, tmp_path):
    import corpus_pipeline

    text = lambda k: " ".join(f"w{k}x{i}" for i in range(80))
    near = lambda k: text(k) + " more"
    texts = [(7, text(1)), (7, text(1)), (7, near(1)), (None, text(2)), (None, near(2)), (None, text(3)), (2**53 + 1, near(4)), (None, text(4)), (5, text(5))]
    rows = [(i, t, None, "s", len(t), 1, 1, "c") for i, t in texts]
    d = frame(spark, rows)
    got = sorted(((x.doc_id, x.component_id) for x in jaccard.connect(d).collect()), key=str)
    assert got == sorted([(7, 7)] * 3 + [(None, None)] * 3 + [(2**53 + 1, 2**53 + 1), (None, 2**53 + 1), (5, 5)], key=str)
    kept = corpus_pipeline.near_duplicates(spark, d, SF).collect()
    assert sorted((str(x.doc_id), x.text.split("x")[0]) for x in kept) == sorted([("7", "w1"), ("None", "w2"), ("None", "w3"), (str(2**53 + 1), "w4"), ("5", "w5")])
    spark.createDataFrame([(1, text(3))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = corpus_pipeline.decontamination(spark, d, str(tmp_path)).collect()
    assert len(clean) == len(rows) - 1 and text(3) not in {x.text for x in clean}


def test_components_of_empty_table(empty):
    assert jaccard.connect(empty).count() == 0


# 10: token files


def test_token_files_round_trip(spark, docs):
    from tokenizers import Tokenizer

    path, model = scratch(spark), public_tokenizers.path("word_bpe_49k.json")
    tokens.write(docs, path, model)
    t = Tokenizer.from_file(model)
    start, expected = 0, []
    for doc, text, *_ in sorted(documents()):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        expected.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(x) for x in tokens.digest(spark, path).collect()) == expected
    exact = scratch(spark)
    tokens.write(docs, exact, model, exact=True)
    assert sorted(tuple(x) for x in tokens.digest(spark, exact).collect()) == expected


def test_token_words_match_whole_texts():
    encoder = tokens.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["It's a DOG's \"life\", isn't it?  we'll", "İstanbul ΣΑΣ ﬁne\x1c x² ½,", "<|endoftext|> a<|startoftext|>b", "café., naïve's A.B", "a b　c, d​e.", ""]
    flat, sizes = encoder.encode(texts)
    at = 0
    for text, n in zip(texts, sizes, strict=True):
        assert flat[at : at + n].tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 1]
        at += n


# pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    d = spark.read.parquet(f"{SF}/documents.parquet")
    before = d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == d.columns and after.count() <= before.count(), name
        before = after
    ids = {x.doc_id for x in before.collect()}
    assert ids and ids == {x.doc_id for x in corpus_pipeline.STAGES[-1][1](spark, before, SF).collect()}
    near = corpus_pipeline.near_duplicates(spark, d, SF).select("doc_id").collect()
    comp = brute_components([(x.doc_id, x.text) for x in d.collect()], 5, 80, 100)
    assert {x.doc_id for x in near} == {c for _, c in comp.values()}
