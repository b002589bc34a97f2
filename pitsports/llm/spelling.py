"""Spelling variant grouping by a frequency-vector trie.

Words (maximal runs of Latin letters) are counted over all texts. A word's frequency vector holds how often each letter
group occurs (26 letters, one group for the others); a trie arranges the words by the counts of successive groups. Two words
are near if one letter is inserted, deleted or replaced, so that their vectors differ by a surplus of at most one and a
deficit of at most one. A depth-first search takes a set of words down the trie, spends that budget, and compares at the
leaves. Each unordered pair is looked for once: from the shorter word to the longer, or, at equal length, from the word whose
first differing count is the smaller.

The trie's upper levels are a shuffle key: length and the counts of the first groups, as many as keep the largest cell below
``CELL`` words. A word travels to its own cell as an entry and, as a question, to each cell that the budget reaches. Cells
that stay too large at full depth are cut: the questions are dealt over copies of their entries.

Edge cases: null texts have no words; a null id counts as the empty text before the colon; repeated rows count each time;
texts of any length are counted in pieces; ties go to the smaller word in code-point order; words of any length are compared
whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitsports.llm.common import settle

MIN_LENGTH, MIN_COUNT, TIMES, EVERY = 6, 5, 5, 199
#: Letters by how common they are (the usual order for English); the last group is every other letter. Fixed values.
LETTERS = b"etaoinshrdlcumwfgypbvkjxqz"
GROUPS = len(LETTERS) + 1
#: Words in a cell of the trie, questions that meet one copy of a cell, pairs left to compare at a leaf or at a time.
CELL, QUESTIONS, LEAF, TOGETHER = 2_000, 200_000, 4_096, 1 << 20
#: Distinct words that a task counts before it passes them on, and characters that it cuts into words at a time.
WORDS, PIECE = 500_000, 1 << 20
_TO_WORDS = bytes(c if 97 <= c < 123 or c >= 0xC0 else 32 for c in range(256))
_GROUP = np.full(256, GROUPS - 1)
_GROUP[list(LETTERS)] = np.arange(GROUPS - 1)
_GAP = re.compile("[^A-Za-zÀ-ÿ]")


# counting


def _pieces(text: str):
    """``text`` in pieces of about ``PIECE`` characters, cut where no word goes on."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + PIECE)
        stop = gap.start() if gap else len(text)
        yield text[at:stop]
        at = stop


def _counted(every: int):
    def run(batches):
        total: Counter = Counter()

        def out():
            words = [w.decode("latin-1") for w in total]
            rows = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return rows

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for piece in _pieces(text.as_py() or ""):
                    # every letter is one byte in this encoding, everything else becomes a space
                    runs = Counter(piece.encode("latin-1", "replace").lower().translate(_TO_WORDS).split())
                    runs = {w: n for w, n in runs.items() if len(w) >= MIN_LENGTH}
                    spelled = [w if w.isascii() else w.decode("latin-1").encode() for w in runs]
                    for (w, n), h in zip(runs.items(), map(crc32, spelled, repeat(start)), strict=True):
                        if every and not h % every:
                            w = w[: h % len(w)] + w[h % len(w) + 1 :]
                            if len(w) < MIN_LENGTH:
                                continue
                        total[w] += n
                if len(total) >= WORDS:
                    yield out()
        yield out()

    return run


def words(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """word, n: the words of ``docs`` (``doc_id``, ``text``) of at least ``MIN_LENGTH`` letters and ``MIN_COUNT`` occurrences.

    In a document whose checksum with a word is divisible by ``every``, the word loses one letter, which
    makes misspellings; 0 leaves all words as they are."""
    counts = docs.select("doc_id", "text").mapInArrow(_counted(every), "word string, n long")
    return settle(counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT))


# the trie


class _Words:
    """Words as bytes of one buffer, with lengths and frequency vectors."""

    def __init__(self, column: pa.Array):
        texts = [w.encode("latin-1") for w in column.to_pylist()]
        self.bytes = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
        self.length = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.cumsum(self.length) - self.length
        owner = np.repeat(np.arange(len(texts)), self.length)
        self.vector = np.bincount(owner * GROUPS + _GROUP[self.bytes[:-1]], minlength=len(texts) * GROUPS).reshape(len(texts), GROUPS)
        # a bit for each letter that occurs, one for each that occurs again: one more or one less flips one bit at most
        two = np.uint64(1) << np.arange(2 * GROUPS, dtype=np.uint64)
        self.bits = np.where(np.concatenate((self.vector > 0, self.vector > 1), 1), two, np.uint64(0)).sum(1, dtype=np.uint64)

    def letters(self, rows: np.ndarray, width: int) -> np.ndarray:
        """The first ``width`` letters of each of ``rows``; zeros behind a word's end."""
        at = np.arange(width)
        place = np.minimum(self.start[rows][:, None] + at, len(self.bytes) - 1)
        return np.where(at < self.length[rows][:, None], self.bytes[place], 0)


def _keys(length: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary keys of cells; a byte for each number where all fit, else four."""
    rows = np.column_stack((length, counts))
    texts = [r.tobytes() for r in rows.astype(np.uint8)]
    for i in np.flatnonzero(length > 255):
        texts[i] = rows[i].astype("<u4").tobytes()
    return pa.array(texts, pa.binary())


def _routed(depth: int):
    """Each word as an entry of its own cell (``up`` -1), and as a question (the budget that is left) to the cells in reach."""

    def steps(w: _Words):
        top = w.vector[:, :depth]
        everyone = np.ones(len(top), bool)
        yield everyone, w.length, top, -1, -1
        yield everyone, w.length, top, 1, 1
        yield everyone, w.length + 1, top, 1, 0
        for i in range(depth):
            more = top.copy()
            more[:, i] += 1
            yield everyone, w.length, more, 0, 1
            yield everyone, w.length + 1, more, 0, 0
            for j in range(i + 1, depth):
                less = more.copy()
                less[:, j] -= 1
                yield top[:, j] > 0, w.length, less, 0, 0

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                w = _Words(batch.column("word"))
                for who, length, top, up, down in steps(w):
                    some = pa.array(who)
                    n = int(who.sum())
                    budget = [pa.array(np.full(n, v, np.int8)) for v in (up, down)]
                    yield pa.RecordBatch.from_arrays([_keys(length[who], top[who]), *budget, batch.column("word").filter(some), batch.column("n").filter(some)], ["cell", "up", "down", "word", "n"])

    return run


def _leaves(w: _Words, entries: np.ndarray, questions: np.ndarray, up: np.ndarray, down: np.ndarray, depth: int):
    """Depth-first search of a cell's trie: yields the (entries, questions) that meet at each leaf reached."""
    entries = entries[np.lexsort(w.vector[entries, depth:].T[::-1])] if depth < GROUPS else entries
    stack = [(0, len(entries), depth, questions, up, down)]
    while stack:
        low, high, level, asked, more, less = stack.pop()
        if not len(asked):
            continue
        if (high - low) * len(asked) <= LEAF or level == GROUPS:
            yield entries[low:high], asked
            continue
        counts = w.vector[entries[low:high], level]
        cuts = [0, *(np.flatnonzero(np.diff(counts)) + 1), len(counts)]
        own = w.vector[asked, level]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            diff = counts[a] - own
            left, kept = more - np.maximum(diff, 0), less - np.maximum(-diff, 0)
            live = (left >= 0) & (kept >= 0)
            stack.append((low + a, low + b, level + 1, asked[live], left[live], kept[live]))


def _near(w: _Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether ``b`` is ``a`` with one letter replaced or one inserted."""
    out = np.zeros(len(a), bool)
    order = np.argsort(w.length[b], kind="stable")
    at = 0
    while at < len(order):
        width = int(w.length[b[order[at]]])
        same = np.searchsorted(w.length[b[order]], width, "right") if at == 0 else at + np.searchsorted(w.length[b[order[at:]]], width, "right")
        stop = min(same, at + max(1, (1 << 22) // (width + 1)))
        rows = order[at:stop]
        x, y = w.letters(a[rows], width), w.letters(b[rows], width + 1)
        differs = x != y[:, :width]
        shorter = w.length[a[rows]] < width
        first = np.where(differs.any(1), differs.argmax(1), width)
        later = (x[:, : width - 1] != y[:, 1:width]) & (np.arange(width - 1) >= first[:, None])
        out[rows] = np.where(shorter, ~later.any(1), differs.sum(1) == 1)
        at = stop
    return out


def _searched(depth: int):
    """Near pairs of the cells of a task, which come one after another; each pair once in each direction."""

    def pairs(rows: pa.Table):
        w = _Words(rows.column("word").combine_chunks())
        cell = rows.column("cell").combine_chunks().dictionary_encode().indices.to_numpy()
        up, down = rows.column("up").to_numpy(), rows.column("down").to_numpy()
        edges = np.concatenate(([0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]))
        found, held = [], 0

        def compared():
            a, b = np.concatenate([q for q, _ in found]), np.concatenate([e for _, e in found])
            found.clear()
            a, b = (x[np.bitwise_count(w.bits[a] ^ w.bits[b]) <= 2] for x in (a, b))
            good = _near(w, a, b)
            a, b = a[good], b[good]
            twice = (up[a] == 1) & (down[a] == 1)  # questions that meet the words of their own cell see each pair twice
            one_way = np.zeros(len(a), bool)
            width = int(w.length[b[twice]].max(initial=0))
            x, y = w.letters(a[twice], width), w.letters(b[twice], width)
            place = (x != y).argmax(1) if len(x) else np.zeros(0, np.int64)
            one_way[twice] = x[np.arange(len(x)), place] > y[np.arange(len(x)), place]
            return a[~one_way], b[~one_way]

        def out(a, b):
            word, n = rows.column("word").combine_chunks(), rows.column("n").combine_chunks()
            both = [pa.array(np.concatenate(x)) for x in ((a, b), (b, a))]
            return pa.RecordBatch.from_arrays([word.take(both[0]), word.take(both[1]), n.take(both[1])], ["word", "near", "near_n"])

        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            members = np.arange(lo, hi)
            entries, asked = members[up[lo:hi] < 0], members[up[lo:hi] >= 0]
            for e, q in _leaves(w, entries, asked, up[asked], down[asked], depth) if len(entries) and len(asked) else ():
                found.append((np.repeat(q, len(e)), np.tile(e, len(q))))
                held += len(e) * len(q)
                if held >= TOGETHER:
                    yield out(*compared())
                    held = 0
        if found:
            yield out(*compared())

    def run(batches):
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # a batch's last cell may go on in the next one; whole cells before it can be searched
            last, cells = batch.column("cell")[-1], batch.column("cell").to_pylist()
            begins = next(i for i in range(len(cells)) if cells[i] == last.as_py())
            if begins or kept and kept[-1].column("cell")[-1] != last:
                kept.append(batch.slice(0, begins))
                yield from pairs(pa.Table.from_batches(kept))
                kept = []
            kept.append(batch.slice(begins))
        if kept:
            yield from pairs(pa.Table.from_batches(kept))

    return run


def depth_of(vocabulary: DataFrame, cell: int = CELL) -> int:
    """How many letter groups the shuffle key holds: the fewest for which no cell has more than ``cell`` words, or all."""
    tops = [f"c{i}" for i in range(GROUPS)]
    letters = [chr(x) for x in LETTERS] + [LETTERS.decode()]
    counts = [F.length(F.translate("word", x, "")).alias(c) for x, c in zip(letters, tops, strict=True)]  # as telling as the counts
    rows = vocabulary.select(F.length("word").alias("_len"), *counts)
    cells = settle(rows.groupBy("_len", *tops).agg(F.count("*").alias("_n")))
    for depth in range(1, GROUPS):
        largest = cells.groupBy("_len", *tops[:depth]).agg(F.sum("_n").alias("_n")).agg(F.max("_n")).first()[0]
        if (largest or 0) <= cell:
            return depth
    return GROUPS


def near_pairs(vocabulary: DataFrame, depth: int | None = None, questions: int = QUESTIONS) -> DataFrame:
    """word, near, near_n: every ordered pair of near words of ``vocabulary`` (``word``, ``n``)."""
    depth = depth or depth_of(vocabulary)
    routed = vocabulary.mapInArrow(_routed(depth), "cell binary, up byte, down byte, word string, n long")
    asked = routed.where("up >= 0").groupBy("cell").agg(F.count("*").alias("_asked"))
    large = settle(asked.where(F.col("_asked") > questions)) if depth == GROUPS else None
    if large is not None and not large.isEmpty():
        copies = large.select("cell", F.ceil(F.col("_asked") / questions).cast("int").alias("_copies"))
        routed = routed.join(copies, "cell", "left").withColumn("_copies", F.coalesce("_copies", F.lit(1)))
        dealt = F.when(F.col("up") < 0, F.sequence(F.lit(0), F.col("_copies") - 1)).otherwise(F.array(F.pmod(F.xxhash64("word"), F.col("_copies")).cast("int")))
        routed = routed.withColumn("_copy", F.explode(dealt))
        routed = routed.withColumn("cell", F.concat("cell", F.col("_copy").cast("string").cast("binary"))).drop("_copies", "_copy")
    cells = routed.repartition("cell").sortWithinPartitions("cell")
    return cells.mapInArrow(_searched(depth), "word string, near string, near_n long")


# forms and roots


def variants(vocabulary: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word: its most frequent near word if that is ``times`` as frequent, and
    the last form that following forms leads to."""
    best = near_pairs(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    is_form = -F.col("best.less") >= times * F.col("n")
    rows = vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")
    )
    rows = settle(rows)
    # each step at least doubles the part of the chain that is followed; chains grow by ``times`` a link, so they are short
    chain = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = chain.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        chain = settle(chain.join(on, chain["root"] == on["_word"], "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("_moved")))
        moved = not chain.where("_moved").isEmpty()
        chain = chain.drop("_moved")
        if not moved:
            return rows.join(chain, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(words(spark.read.parquet(f"{sf_dir}/documents.parquet")))
