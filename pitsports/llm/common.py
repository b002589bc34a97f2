"""Helpers that the operators of this subpackage share: scratch tables, output columns and word hashing.

A *word* is a maximal run of characters other than ASCII white space (space, tab, newline, vertical tab, form feed,
carriage return). Word and shingle hashes are 64 bits wide and are computed with NumPy over the bytes of a whole
Arrow batch at a time, so the cost per byte does not depend on how texts are cut into rows.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
#: Odd 64-bit multipliers of the hash functions (fixed values).
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def scratch(spark: SparkSession) -> str:
    """A new path below the folder that the cluster shares (``spark.checkpoint.dir``).

    Where it is unset, a local session gets a folder of its own; a cluster must name one that all executors share. All
    paths of an application lie in one folder, which its driver deletes when it ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="pitsports-")
        spark.conf.set("spark.checkpoint.dir", root)
    own = f"{root.rstrip('/')}/pitsports-{spark.sparkContext.applicationId}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)
    return f"{own}/{uuid.uuid4().hex}"


def settle(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage with files that outlive any executor."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path) if partition_by else df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_row_key(df: DataFrame) -> DataFrame:
    """``_doc`` (a struct of the columns of ``df``) and a distinct long ``_row`` for each row, settled, so that every later
    read sees the same keys."""
    return settle(packed(df).withColumn("_row", F.monotonically_increasing_id()))


def packed(df: DataFrame) -> DataFrame:
    """``df`` as one column ``_doc``, a struct of its columns, so that none of their names can meet an operator's own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_doc"))


def unpacked(df: DataFrame, without=(), **changed: Column) -> list[Column]:
    """The columns inside ``_doc``, under their names and in their order, but for ``without``; those in ``changed`` replaced."""
    return [changed.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in df.schema["_doc"].dataType.names if c not in without]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> U(30))) * U(MIX_1)
    x = (x ^ (x >> U(27))) * U(MIX_2)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and ``BASE**-i`` modulo 2**64 for i in 0..n, grown by doubling and kept for the worker's life."""
    size = max(_powers, default=0)
    if size <= n:
        size = 1 << max(16, int(n + 1).bit_length())
        _powers.clear()
        up = np.full(size, U(BASE))
        down = np.full(size, U(BASE_INVERSE))
        up[0] = down[0] = U(1)
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def joined(texts) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, each followed by a newline, and the end offset of each (None counts as empty)."""
    parts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)))
    return np.frombuffer(b"\n".join(parts) + b"\n" if parts else b"", np.uint8), ends


def word_hashes(texts, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word in order, and for each text the number of words up to its end (cumulative)."""
    buf, ends = joined(texts)
    if not len(buf):
        return np.empty(0, U), np.zeros(len(ends), np.int64)
    if lower:
        buf = LOWER[buf]
    white = WHITE[buf]
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    if not white[0]:
        edge = np.concatenate(([0], edge))
    starts, stops = edge[0::2], edge[1::2]  # the buffer ends in white space, so that every start has a stop
    up, down = powers(len(buf))
    prefix = np.zeros(len(buf) + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * up[: len(buf)], out=prefix[1:])
    h = mix((prefix[stops] - prefix[starts]) * down[starts] ^ (stops - starts).astype(U) << U(40))
    return h, np.searchsorted(stops, ends, "right")


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int, whole_if_short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k``-word shingles and the text that each belongs to.

    A text of fewer than ``k`` words (but at least one) gives its whole sequence as one shingle if ``whole_if_short``,
    else none.
    """
    n_texts = len(counts)
    sizes = np.diff(counts, prepend=0)
    owner = np.repeat(np.arange(n_texts), sizes)
    n = max(0, len(words) - k + 1)
    h = np.zeros(n, U)
    for j in range(k):
        h = h * U(BASE) + words[j : j + n]
    inside = owner[:n] == owner[k - 1 : k - 1 + n] if n else np.empty(0, bool)
    h, owner_of = mix(h[inside]), owner[:n][inside]
    if whole_if_short:
        short = np.flatnonzero((sizes > 0) & (sizes < k))
        extra = np.array([mix(np.array([_fold(words[counts[i] - sizes[i] : counts[i]])], U))[0] for i in short], U)
        h, owner_of = np.concatenate((h, extra)), np.concatenate((owner_of, short))
        order = np.argsort(owner_of, kind="stable")
        h, owner_of = h[order], owner_of[order]
    return h, owner_of


def _fold(words: np.ndarray) -> int:
    h = len(words)
    for w in words.tolist():
        h = (h * BASE + w) & 0xFFFFFFFFFFFFFFFF
    return h


def distinct_per_owner(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, hash) pairs, ordered by owner, then hash."""
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[new], owner[new]
    return h, owner


def batches(frames, budget: int = 1 << 21):
    """Cut pandas batches into pieces of about ``budget`` characters of ``text``, whole rows each."""
    for pdf in frames:
        lengths = pdf["text"].str.len().fillna(0).to_numpy()
        piece = (np.cumsum(lengths) // budget).astype(np.int64)
        cuts = np.concatenate(([0], np.flatnonzero(piece[1:] != piece[:-1]) + 1, [len(pdf)])) if len(pdf) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield pdf.iloc[a:b]
