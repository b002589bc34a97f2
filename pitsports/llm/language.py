"""Language identification by prediction by partial matching (PPM).

For each language a variable-order context tree over bytes is counted: for every context of 0 to 3 bytes, how often each
byte followed it. A byte is predicted by the longest context seen; a byte new there costs an escape (method C: the number
of distinct bytes seen against the number of bytes) and is then predicted by the next shorter context, where the bytes
already excluded no longer count; below order 0 all bytes not seen at all are equal. The statistics are frozen after
training, so a text's code length in bits is a sum over its bytes, exact for the tree, and the language with the shortest
code wins.

Training takes a bounded sample of labelled documents (``sample`` a language and ``TOTAL`` in all, whole texts, those
whose id hashes lowest); every language has its share, and every context of the sample is kept. Counting runs on Spark;
only the summed counts of the bounded sample come to the driver. Scoring visits every whole text.

*Scoring.* Trained strings are found through a hash table; of a block of bytes the distinct four-byte strings are coded in
the trees, once for each language, and summed text by text.

Edge cases: a null text or one without a letter is ``und`` with score 0; ties go to the language first in the alphabet;
rows with null ids or null languages are scored but not learned from; an empty training set predicts ``und`` for all;
repeated rows are scored alike; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitsports.llm.common import batches

ORDER = 3
#: Documents that are learned from (documented bounds): of each language, and of all languages together.
SAMPLE, TOTAL = 2_000, 200_000
#: Bytes of text that are worked on at a time, however long the texts are.
BLOCK = 1 << 20


def _grams(frames):
    """Counts of (language, ORDER bytes of context and the byte after it), summed inside each block.

    Every text starts after ORDER zero bytes, so its first bytes have contexts too.
    """
    for pdf in frames:
        for lang, part in pdf.groupby("lang"):
            for piece in batches([part]):
                data = b"".join(b"\0" * ORDER + t.encode("utf-8", "surrogatepass") for t in piece["text"]) + b"\0" * ORDER
                for _, key in _windows(np.frombuffer(data, np.uint8)):
                    key, n = np.unique(key[key & 0xFF != 0], return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": key.astype(np.int64), "n": n.astype(np.int64)})


def _windows(raw: np.ndarray):
    """(first place, all ORDER + 1 bytes from each place on as one number) of ``raw``, in blocks of bounded size."""
    for a in range(0, max(0, len(raw) - ORDER), BLOCK):
        x = raw[a : a + BLOCK + ORDER].astype(np.uint32)
        yield a, (x[:-3] << 24) | (x[1:-2] << 16) | (x[2:-1] << 8) | x[3:]


def count(docs: DataFrame, sample: int = SAMPLE) -> pd.DataFrame:
    """Order-3 counts (lang, gram, n) of the training sample of ``docs`` (``doc_id``, ``text``, ``lang``)."""
    usable = docs.where("text is not null and lang is not null and doc_id is not null").select("doc_id", "text", "lang")
    sizes = usable.groupBy("lang").agg(F.count("*").alias("in_lang"))
    n_langs = sizes.count()
    if not n_langs:
        return pd.DataFrame({"lang": [], "gram": [], "n": []})
    each = max(1, min(sample, TOTAL // n_langs))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = usable.select("doc_id", "lang").join(F.broadcast(sizes) if n_langs <= TOTAL else sizes, "lang")
    chosen = chosen.where(place < F.lit(float(each)) / F.col("in_lang")).select("doc_id", "lang")
    texts = usable.join(F.broadcast(chosen) if n_langs <= TOTAL else chosen, ["doc_id", "lang"], "left_semi")
    counts = texts.select("text", "lang").mapInPandas(_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = counts.toArrow()  # numbers, and one name a row group: no objects by row
    names = found.column("lang").combine_chunks().dictionary_encode()
    lang = pd.Categorical.from_codes(names.indices.to_numpy(), names.dictionary.to_pylist()) if len(found) else []
    return pd.DataFrame({"lang": lang, "gram": found.column("gram").to_numpy(), "n": found.column("n").to_numpy()})


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in sorted ``keys``, and which of them are there."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of ``n`` for each."""
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, n)


class Tree:
    """The context tree of one language. A string of a context of k bytes and the byte after it is one number."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        #: by order: strings and their counts
        self.strings = [_summed(gram & ((1 << 8 * (k + 1)) - 1), n) for k in range(ORDER + 1)]
        self._fill()
        # 32 bits hold every string and every count of the bounded sample
        self.strings = [(s.astype(np.uint32), c.astype(np.uint32)) for s, c in self.strings]
        self.contexts = [tuple(x.astype(np.uint32) for x in c) for c in self.contexts]

    def _fill(self) -> None:
        #: by order: contexts, the bytes after each, the distinct ones, and both of the next shorter context without these
        self.contexts = []
        for k, (strings, counts) in enumerate(self.strings):
            contexts, at = np.unique(strings >> 8, return_inverse=True)
            total, distinct = np.bincount(at, counts), np.bincount(at).astype(float)
            shorter_total = shorter_distinct = np.zeros(len(contexts))
            if k:
                below, below_counts = self.strings[k - 1]
                excluded = np.bincount(at, below_counts[_at(below, strings & ((1 << 8 * k) - 1))[0]])
                up, _ = _at(self.contexts[k - 1][0], contexts & ((1 << 8 * (k - 1)) - 1))
                shorter_total = self.contexts[k - 1][1][up] - excluded
                shorter_distinct = self.contexts[k - 1][2][up] - distinct
            self.contexts.append((contexts, total, distinct, shorter_total, shorter_distinct))

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each four-byte string after the three before it."""
        out = np.zeros(len(gram))
        live = np.arange(len(gram))
        total = distinct = np.full(len(gram), -1.0)  # of the context at hand, exclusions made; -1: as counted
        gram = gram.astype(np.uint32)
        for k in range(ORDER, -1, -1):
            g = gram[live] & np.uint32((1 << 8 * (k + 1)) - 1)
            contexts, all_total, all_distinct, next_total, next_distinct = self.contexts[k]
            c, known = _at(contexts, g >> np.uint32(8))
            t = np.where(total < 0, all_total[c], total)
            d = np.where(total < 0, all_distinct[c], distinct)
            s, hit = _at(self.strings[k][0], g)
            hit &= known
            out[live[hit]] -= np.log2(self.strings[k][1][s[hit]].astype(float) / (t[hit] + d[hit]))
            escaped = known & ~hit & (d > 0)  # where nothing is left but excluded bytes, the escape is certain
            out[live[escaped]] -= np.log2(d[escaped] / (t[escaped] + d[escaped]))
            total = np.where(known, next_total[c], total)[~hit]
            distinct = np.where(known, next_distinct[c], distinct)[~hit]
            live = live[~hit]
        out[live] += np.log2(256 - float(self.contexts[0][2][0]))
        return out


class Table:
    """Places of distinct 32-bit keys: open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.uint32)
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.slots = np.full((1 << self.bits) + 1, -1, np.int32)
        at, left = self._first(self.keys), np.arange(len(keys))
        while len(left):
            free = self.slots[at] < 0
            where, first = np.unique(at[free], return_index=True)
            self.slots[where] = left[free][first]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        keys = keys.astype(np.uint32)
        at = self._first(keys)
        found = self.slots[at]
        live = np.flatnonzero((found >= 0) & (self.keys[found] != keys)) if len(self.keys) else np.zeros(0, np.int64)
        while len(live):
            at[live] = (at[live] + 1) & ((1 << self.bits) - 1)
            found[live] = self.slots[at[live]]
            live = live[(found[live] >= 0) & (self.keys[found[live]] != keys[live])]
        return found


class Model:
    """Frozen code lengths: a tree for each language, and the places of all trained strings."""

    size = 256

    def __init__(self, counts: pd.DataFrame):
        gram, n = counts["gram"].to_numpy(np.int64), counts["n"].to_numpy(np.float64)
        codes, names = pd.factorize(counts["lang"], sort=True)
        self.langs = [str(x) for x in names]
        order = np.argsort(codes, kind="stable")
        ends = np.cumsum(np.bincount(codes, minlength=len(self.langs)))[:-1] if self.langs else []
        self.trees = [Tree(gram[x], n[x]) for x in (np.split(order, ends) if self.langs else [])]
        self.grams = np.unique(gram).astype(np.uint32)
        self.table = Table(self.grams)

    def _of(self, gram: np.ndarray) -> np.ndarray:
        return np.column_stack([t.bits(gram) for t in self.trees]) if self.trees else np.zeros((len(gram), 0))

    @property
    def bits(self) -> np.ndarray:
        """Code lengths of all ``size`` bytes after each context of ``ORDER`` bytes met in training, for each language."""
        return self._of(((np.unique(self.grams.astype(np.int64) >> 8)[:, None] << 8) + np.arange(self.size)).ravel())

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Code length in bits of every text under every language.

        The bytes of all texts are worked on in blocks; the distinct strings of a block are coded once for each language,
        and a text's sum adds up block by block, so memory depends neither on a text's length nor on the languages.
        """
        enc = [b"\0" * ORDER + t.encode("utf-8", "surrogatepass") for t in texts]
        starts = np.cumsum([0, *map(len, enc)])
        out = np.zeros((len(texts), len(self.langs)))
        for first, gram in _windows(np.frombuffer(b"".join(enc), np.uint8)):
            row = self.table.find(gram)
            new = row < 0
            rare, place = np.unique(gram[new], return_inverse=True)
            met = np.zeros(len(self.grams), bool)
            met[row[~new]] = True
            known = np.flatnonzero(met)
            number = np.cumsum(met) - 1
            at = np.empty(len(gram), np.int64)
            at[~new] = number[row[~new]]
            at[new] = len(known) + place
            distinct = np.concatenate((self.grams[known], rare))
            # windows that begin in a text's last ORDER bytes reach into the next text and count for none
            low, high = np.searchsorted(starts, first, "right") - 1, np.searchsorted(starts, first + len(gram), "left")
            begin = np.clip(starts[low:high] - first, 0, len(gram))
            end = np.clip(starts[low + 1 : high + 1] - ORDER - first, begin, len(gram))
            edges = np.stack((begin, end), 1).ravel()
            for k, tree in enumerate(self.trees):
                each = np.append(tree.bits(distinct)[at], 0.0)
                sums = np.add.reduceat(each, np.minimum(edges, len(gram)))[::2]
                out[low:high, k] += np.where(end > begin, sums, 0.0)
        return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (``doc_id``, ``held_out``, ``text``) to doc_id, held_out, lang_pred, score.

    ``score`` is the winner's share when each language weighs 2 to the power of minus its code length a byte, times 8.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames):
        m = shared.value
        for pdf in batches(frames):
            lang, score = np.full(len(pdf), "und", object), np.zeros(len(pdf))
            usable = [i for i, t in enumerate(pdf["text"]) if t is not None and m.langs and any(c.isalpha() for c in t)]
            if usable:
                texts = [pdf["text"].iat[i] for i in usable]
                bits = m.lengths(texts)
                size = np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], float)[:, None]
                best = bits.argmin(1)
                gap = (bits - bits.min(1, keepdims=True)) / size
                share = 1.0 / np.exp2(-8.0 * gap).sum(1)
                lang[usable] = np.array(m.langs, object)[best]
                score[usable] = share
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "lang_pred": lang, "score": score})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "held_out", "text")  # as text, ids stay exact beside nulls
    return rows.mapInPandas(run, "doc_id string, held_out boolean, lang_pred string, score double").withColumn("doc_id", F.col("doc_id").cast("long"))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    return Model(count(docs, sample))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False)))
    model = fit(docs.where("not held_out"))
    return predict(docs.drop("lang"), model)
