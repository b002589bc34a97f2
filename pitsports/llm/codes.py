"""Vector code compression: product codes whose nearest entries are found by slicing and intersecting bit masks.

Each vector becomes integers ``floor(1024 * x)`` and is cut into ``PARTS`` equal parts; each part is replaced by the number
of the nearest entry of its position's codebook. The codebook's coordinates are sorted in each dimension, and every place of
a sorted list carries the mask (64-bit words) of the entries before it. A radius selects a range in each dimension; the
masks at the range's ends differ in exactly the entries inside, and ANDing over the dimensions leaves the entries of a
cube. The first radius is the usual distance between neighbouring entries. A cube that is empty is doubled; one whose best
entry lies within the radius holds the nearest; else the best entry's distance is the next radius, whose cube cannot miss a
nearer one. Distances are integers, so ties are exact and go to the lower index.

A round is one pass over the settled integer vectors: tasks assign and sum up their parts, one row for each part, entry and
component meets the others in one aggregation, and the new codebooks (at most 256 entries) travel to the tasks.

Edge cases: null vectors and vectors with null or non-finite components give no row; vectors of unequal lengths are padded
with zeros to the longest, and its length to a multiple of the parts; fewer than 256 rows give as many entries; null ids
come last, rows of one id are ordered by their vectors; components are held within a bound (2^27 for 64 dimensions) that
keeps squared distances inside 64 bits; a label's error beyond 64 bits is null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitsports.llm.common import settle

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors that a task compares at a time, and copies of each label's sum that spread a frequent label over tasks.
BLOCK, SALT = 2048, 32


def _isqrt(x: np.ndarray) -> np.ndarray:
    s = np.sqrt(x.astype(float)).astype(np.int64)
    s -= s * s > x
    return s + ((s + 1) * (s + 1) <= x)


class Slices:
    """The codebook of one part position, indexed for exact nearest-entry search."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n, width = entries.shape
        words = -(-n // 64)
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, 0)
        own = np.zeros((n, words), np.uint64)
        own[np.arange(n), np.arange(n) // 64] = np.uint64(1) << (np.arange(n) % 64).astype(np.uint64)
        self.before = np.zeros((width, n + 1, words), np.uint64)
        for d in range(width):
            self.before[d, 1:] = np.bitwise_or.accumulate(own[order[:, d]], axis=0)
        self.all = np.bitwise_or.reduce(own, axis=0)
        gaps = ((entries[:, None] - entries[None]) ** 2).sum(2) if n > 1 else np.zeros((1, 1), np.int64)
        np.fill_diagonal(gaps, np.iinfo(np.int64).max if n > 1 else 0)
        self.radius = max(1, int(_isqrt(np.sort(gaps.min(1))[n // 2 : n // 2 + 1])[0]))

    def inside(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (row of ``x``, entry) whose coordinates differ by at most the row's ``radius`` everywhere, in order."""
        masks = np.tile(self.all, (len(x), 1))
        for d in range(x.shape[1]):
            low = np.searchsorted(self.sorted[:, d], x[:, d] - radius, "left")
            high = np.searchsorted(self.sorted[:, d], x[:, d] + radius, "right")
            masks &= self.before[d][high] ^ self.before[d][low]
        bits = np.unpackbits(masks.astype("<u8").view(np.uint8), axis=1, bitorder="little")
        return np.nonzero(bits)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row and its squared distance; of equally near ones the lowest."""
        best, least = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        open_, radius = np.arange(len(x)), np.full(len(x), self.radius, np.int64)
        while len(open_):
            row, entry = self.inside(x[open_], radius)
            far = np.zeros(len(row), np.int64)
            for d in range(x.shape[1]):
                far += (x[open_[row], d] - self.entries[entry, d]) ** 2
            radius = radius * 2
            if len(row):
                first = np.flatnonzero(np.diff(row, prepend=-1))
                found, low = row[first], np.minimum.reduceat(far, first)
                hit = np.flatnonzero(far == np.repeat(low, np.diff(first, append=len(row))))
                hit = hit[np.diff(row[hit], prepend=-1) > 0]
                best[open_[found]], least[open_[found]] = entry[hit], low
                reach, was = _isqrt(low), radius[found] // 2
                radius[found] = np.where(reach <= was, -1, reach)
            open_, radius = open_[radius >= 0], radius[radius >= 0]
        return best, least


def _assigned(batch: pa.RecordBatch, books: list[Slices]):
    """Blocks of (first row, vectors, indexes by part, squared distances by part)."""
    vec = batch.column("vec")
    width = sum(b.entries.shape[1] for b in books)
    flat = vec.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
    for a in range(0, batch.num_rows, BLOCK):
        x = flat[a : a + BLOCK]
        got = [b.nearest(part) for b, part in zip(books, np.split(x, len(books), axis=1), strict=True)]
        yield a, x, np.stack([g[0] for g in got], 1), np.stack([g[1] for g in got], 1)


def _sums(entries: np.ndarray):
    """A task's sums and counts of the parts that it assigns to each entry."""

    def run(batches):
        books = [Slices(e) for e in entries]
        parts, n, width = entries.shape
        total, count = np.zeros((parts * n, width), np.int64), np.zeros(parts * n, np.int64)
        for batch in batches:
            for _, x, index, _ in _assigned(batch, books):
                slot = (index + np.arange(parts) * n).ravel()
                np.add.at(total, slot, x.reshape(len(slot), width))
                count += np.bincount(slot, minlength=parts * n)
        used = np.flatnonzero(count)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * width, pa.int32()), pa.array(total[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array((used // n).astype(np.int32)), pa.array((used % n).astype(np.int32)), pa.array(count[used]), sums], ["part", "entry", "n", "sums"])

    return run


def _codes(entries: np.ndarray):
    def run(batches):
        books = [Slices(e) for e in entries]
        for batch in batches:
            code, error = [], []
            for _, _, index, far in _assigned(batch, books):
                digits, size = index.astype(np.uint8).tobytes().hex(), 2 * len(books)
                code += [digits[i : i + size] for i in range(0, len(digits), size)]
                error.append(far.sum(1))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(np.concatenate([np.zeros(0, np.int64), *error]))], ["vec_id", "label", "code", "error"])

    return run


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, label and ``vec`` (integers, padded to one length) of the rows whose vector is whole and finite; settled."""
    x = F.col("embedding")
    whole = vectors.where(x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | F.abs(v).isin(float("inf"))))
    longest = whole.agg(F.max(F.size(x))).first()[0] or 0
    width = -(-longest // PARTS) * PARTS
    bound = float(2 ** ((62 - max(1, width - 1).bit_length()) // 2 - 1))
    whole_number = lambda v: F.floor(F.greatest(F.least(v.cast("double") * SCALE, F.lit(bound)), F.lit(-bound))).cast("long")
    padded = F.concat(F.transform(x, whole_number), F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(x)))
    return settle(whole.select("vec_id", "label", padded.alias("vec")))


def trained(vecs: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x components) after ``rounds`` rounds over all rows of ``integers``."""
    first = vecs.select("vec_id", "vec").orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(ENTRIES).collect()
    start = np.array([r.vec for r in first], np.int64)
    entries = np.stack(np.split(start, PARTS, axis=1)) if len(first) else np.zeros((PARTS, 0, 0), np.int64)
    for _ in range(rounds if len(first) else 0):
        sums = vecs.mapInArrow(_sums(entries), "part int, entry int, n long, sums array<long>").select("part", "entry", "n", F.posexplode("sums").alias("at", "value"))
        entries = entries.copy()
        for r in sums.groupBy("part", "entry", "at").agg(F.sum("value").alias("total"), F.sum("n").alias("n")).collect():
            entries[r.part, r.entry, r["at"]] = r.total // r.n
    return entries


def encoded(vecs: DataFrame, entries: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of every row of ``integers``, settled."""
    if not entries.shape[1]:
        return vecs.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0)
    label = vecs.schema["label"].dataType.simpleString()
    vec_id = vecs.schema["vec_id"].dataType.simpleString()
    return settle(vecs.mapInArrow(_codes(entries), f"vec_id {vec_id}, label {label}, code string, error long"))


def decoded(codes: DataFrame, entries: np.ndarray) -> DataFrame:
    """``codes`` with ``vec``, the integers that each code stands for."""
    books = F.array(*[F.array(*[F.array(*[F.lit(int(v)) for v in e]) for e in book]) for book in entries])
    part = lambda p: F.element_at(F.element_at(books, p + 1), F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") + 1)
    return codes.withColumn("vec", F.concat(*[part(p) for p in range(len(entries))]))


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` with the sum of error over equal labels (nulls together); a frequent label's rows are spread over tasks."""
    sums = codes.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    sums = sums.select(F.col("label").alias("_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_copy"))
    salted = codes.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALT)).cast("int"))
    return salted.join(sums, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_copy"))).drop("_label", "_copy", "_salt")


def fingerprint(entries: np.ndarray) -> str:
    """sha256 of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    entries = trained(vecs)
    out = with_label_error(encoded(vecs, entries))
    return out.select("vec_id", "code", "error", "label_error", F.lit(fingerprint(entries)).alias("codebooks_sha256"))
