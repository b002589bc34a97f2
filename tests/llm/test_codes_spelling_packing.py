"""Vector codes, spelling variants and packing against brute force, the tokenizer and round trips."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pitsports.llm import codes, packing, registry, spelling
from tests.conftest import SF
from tests.llm.fixtures import documents, frame

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


# vector codes


def brute_codes(rows, n_parts=4, n_entries=256, rounds=4):
    kept = [(i, v, y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    longest = max((len(v) for _, v, _ in kept), default=0)
    width = -(-longest // n_parts)
    vecs = [(i, [math.floor(1024 * x) for x in v] + [0] * (width * n_parts - len(v)), y) for i, v, y in kept]
    vecs.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books = [[v[p * width : (p + 1) * width] for _, v, _ in vecs[:n_entries]] for p in range(n_parts)]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            got = defaultdict(list)
            for _, v, _ in vecs:
                x = v[p * width : (p + 1) * width]
                got[nearest(book, x)[1]].append(x)
            books[p] = [[sum(c) // len(got[j]) for c in zip(*got[j], strict=True)] if j in got else e for j, e in enumerate(book)]
    out, labels = [], Counter()
    for i, v, y in vecs:
        found = [nearest(book, v[p * width : (p + 1) * width]) for p, book in enumerate(books)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), y))
        labels[y] += out[-1][2]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted(((i, c, e, labels[y], digest) for i, c, e, y in out), key=repr)


def run_codes(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    vecs = codes.integers(df)
    entries = codes.trained(vecs)
    got = codes.with_label_error(codes.encoded(vecs, entries)).collect()
    return sorted(((r.vec_id, r.code, r.error, r.label_error, codes.fingerprint(entries)) for r in got), key=repr)


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    f32 = lambda v: [float(np.float32(x)) for x in v]
    rows = [(int(i), f32(rng.normal(0, 0.3, 8)), int(i % 3) if i % 7 else None) for i in rng.permutation(400)]
    rows += [(1000 + i, f32([0.25] * 8), 1) for i in range(40)]  # copies: ties everywhere
    rows += [(2000, None, 1), (2001, [0.1, None] * 4, 1), (2002, [float("nan")] * 8, 1), (2003, [float("-inf")] * 8, 2)]
    rows += [(None, f32(rng.normal(0, 1, 8)), 2), (7, f32(rng.normal(0, 1, 8)), None), (7, f32(rng.normal(0, 1, 8)), None), (2004, [], 0), (2005, f32([9.5, -700.0, 3.25]), 0)]
    assert run_codes(spark, rows) == brute_codes(rows)


def test_codes_of_few_and_no_rows(spark):
    rows = [(3, [0.5, 0.5, 0.5, 0.5], 1), (1, [0.1, 0.2, 0.3, 0.4], None)]
    rows = [(i, [float(np.float32(x)) for x in v], y) for i, v, y in rows]
    assert run_codes(spark, rows) == brute_codes(rows)
    assert run_codes(spark, [(1, None, 1)]) == []
    vecs = codes.integers(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    entries = codes.trained(vecs)
    back = codes.decoded(codes.encoded(vecs, entries), entries)
    assert {r.vec_id: r.vec for r in back.collect()} == {r.vec_id: r.vec for r in vecs.collect()}  # two rows, two entries


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 90), st.integers(1, 5), st.sampled_from([1, 20, 10**8]))
def test_sliced_masks_find_the_nearest_entry(seed, n, width, spread):
    rng = np.random.default_rng(seed)
    entries, x = rng.integers(-spread, spread + 1, (n, width)), rng.integers(-2 * spread, 2 * spread + 1, (50, width))
    far = ((x[:, None] - entries[None]) ** 2).sum(2)
    best, least = codes.Slices(entries).nearest(x)
    assert (best == far.argmin(1)).all() and (least == far.min(1)).all()


def test_codes_query_equals_brute_force(spark):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").limit(300).collect()]
    assert run_codes(spark, rows) == brute_codes(rows)
    got = registry.QUERIES["op11_vector_codes"](spark, SF)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert got.count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()


# spelling variants


def brute_words(rows, every):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += 1
    return {w: n for w, n in total.items() if n >= 5 and len(w) >= 6}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(vocabulary):
    near = {w: [v for v in vocabulary if one_edit(w, v)] for w in vocabulary}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-vocabulary[v], v), default=None)
        form[w] = best if best is not None and vocabulary[best] >= 5 * vocabulary[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n, len(near[w]), vocabulary[form[w]] if form[w] else None) for w, n in vocabulary.items())


def rows_of(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def noisy_vocabulary(seed, n=60):
    rng = random.Random(seed)
    out = {}
    for _ in range(n):
        w = "".join(rng.choice("abeé÷z") for _ in range(rng.randint(6, 8)))
        out[w] = rng.choice([5, 5, 30, 200, 1500])
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(w))
            v = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abeé") + w[i:], w[:i] + rng.choice("abeé") + w[i + 1 :]])
            if len(v) >= 6:
                out.setdefault(v, rng.choice([5, 6, 7, 40]))
            w = rng.choice([w, v]) if len(v) >= 6 else w
    out["q" * 300], out["q" * 299 + "x"], out["q" * 299], out["q" * 255], out["q" * 256] = 5, 50, 5000, 5, 30
    return out


@pytest.mark.parametrize("depth,seed", [(1, 1), (3, 2), (27, 3), (None, 4)])
def test_variants_equal_brute_force(spark, depth, seed, monkeypatch):
    vocabulary = noisy_vocabulary(seed)
    df = spark.createDataFrame(list(vocabulary.items()), "word string, n long").repartition(3)
    monkeypatch.setattr(spelling, "LEAF", 8)
    if depth:
        monkeypatch.setattr(spelling, "depth_of", lambda v: depth)
    assert rows_of(spelling.variants(df)) == brute_variants(vocabulary)


def test_cells_too_large_are_cut(spark):
    vocabulary = noisy_vocabulary(9)
    df = spark.createDataFrame(list(vocabulary.items()), "word string, n long").repartition(2)
    whole = lambda d: sorted(map(tuple, d.collect()))
    assert whole(spelling.near_pairs(df, spelling.GROUPS, questions=2)) == whole(spelling.near_pairs(df, 2))
    assert spelling.depth_of(df, cell=10**6) == 1
    assert spelling.depth_of(df, cell=1) == spelling.GROUPS


def test_words_and_query_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 50)
    rows = [(r[0], r[1]) for r in documents()] + [(None, "Straßenbahn ÀÉÎöü " * 6), (None, None), (5, "x" * 5000 + " " + "longword" * 40)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, word string").repartition(3)
    for every in (0, 3, 199):
        got = {r.word: r.n for r in spelling.words(df, every).collect()}
        assert got == brute_words(rows, every)
    assert rows_of(spelling.variants(spelling.words(df, 3))) == brute_variants(brute_words(rows, 3))
    assert rows_of(spelling.variants(spelling.words(df.limit(0)))) == []
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = rows_of(registry.QUERIES["op12_spelling_variants"](spark, SF))
    vocabulary = brute_words(rows, 199)
    assert {(g[0], g[3]) for g in got} == set(vocabulary.items())
    some = dict(sorted(vocabulary.items())[::5])
    df = spark.createDataFrame(list(some.items()), "word string, n long")
    assert rows_of(spelling.variants(df)) == brute_variants(some)


# packing


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 4), max_size=8), st.integers(1, 64))
def test_pattern_fills_the_window_best(counts, window):
    used = packing.pattern(counts, window)
    assert all(0 < n <= counts[x] for x, n in used.items())
    fits = [x for x in counts if x <= window]
    if fits:
        sums = {max(fits)}
        for x, n in counts.items():
            copies = n - (x == max(fits))
            sums = {s + x * k for s in sums for k in range(copies + 1) if s + x * k <= window}
        assert sum(x * n for x, n in used.items()) == max(sums) and used[max(fits)]
    else:
        assert used == {}


def check_packed(texts, rows, window):
    """Every id of every text in one piece, sequences gapless and either a window or a power of two long."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTE_BPE)
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, x in ids.items():
        at = 0
        for start, length in sorted(by_doc[i]):
            assert start == at
            at += length
        assert at == len(x)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == window or at < window and at & (at - 1) == 0


@pytest.mark.parametrize("window,block", [(2048, 1 << 20), (64, 256), (16, 100)])
def test_packed_pieces(spark, window, block, monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 700)
    monkeypatch.setattr(packing, "SHORT", 6)
    rows = [r for r in documents() if r[0] is not None] + [(10**6, "a <|endoftext|>  b　c  d \n\ne\nf  \n g\t\th 's it's  ", None, None, None, 0, 0, "")]
    packed = packing.pieces(frame(spark, rows), BYTE_BPE, window, block)
    got = packed.withColumn("ids_crc32", F.crc32("ids")).collect()
    check_packed({r[0]: r[1] for r in rows}, got, window)
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    assert {k: v.length for k, v in whole.items()} == {r.sequence_id: sum(x.length for x in got if x.sequence_id == r.sequence_id) for r in got}
    assert all(whole[r.sequence_id].ids[4 * r.offset : 4 * (r.offset + r.length)] == r.ids for r in got)


def test_packing_of_equal_lengths_nulls_and_repeats(spark):
    rows = [(1, "word " * 1499)] * 9 + [(None, None), (None, ""), (2, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int").coalesce(1)
    got = packing.pieces(df, BYTE_BPE).collect()
    assert sum(r.length for r in got) == 9 * 1501 + 3
    sizes = Counter()
    for r in got:
        sizes[r.sequence_id] += r.length
    assert sorted(sizes.values())[-6:] == [2048] * 6 and all(n & (n - 1) == 0 for n in sizes.values())
    assert packing.pieces(df.limit(0), BYTE_BPE).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x0b\x1c\x85 　'sllA1.é字"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=4))
def test_piece_encoder_equals_the_tokenizer(texts):
    encoder = _encoder()
    got = [x.tolist() for x in encoder.encoded([t.encode() for t in texts])]
    assert got == [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]


_made: list = []


def _encoder():
    if not _made:
        _made.append(packing.PieceEncoder(BYTE_BPE))
    return _made[0]


def test_packing_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = registry.QUERIES["op13_sequence_packing"](spark, SF)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check_packed(texts, got.collect(), 2048)
