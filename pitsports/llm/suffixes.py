"""Suffix-array dedup with a logarithmic index family.

Every byte that lies in a ``LENGTH``-byte string which also starts earlier (smaller doc_id, or the same document at an
earlier place) is removed; strings are judged on the input. Matches never cross documents.

*Segments.* A window is a ``LENGTH``-byte string. Each window is represented by one place inside it, the leftmost of its
``GRAM``-byte grams with the smallest hash, so equal windows have their place at the same offset. Neighbouring windows
with the same place form a segment, about 1 for every 40 bytes; a segment's key is the hash of its gram, and its
signature the hash of all its bytes. Equal windows therefore meet under one key, and only there.

*Whole segments.* Under each key, segments with equal signatures but the first are removed whole. This happens inside
each map task first, so a passage that a third of all documents share reaches its key once a task.

*Index family.* Keys with several different segments need the bytes. Their segments go, in document order, in batches
to the tasks that own their keys. Each batch gets a suffix array: its window suffixes, sorted by key and their first
``LENGTH`` bytes. The batch is merge-scanned against the arrays of all existing levels for suffixes that match for at
least ``LENGTH`` bytes, those are marked, the rest become a new level, and levels of equal size merge, so a task holds
a logarithmic number of sorted arrays.

*Batches of documents.* ``add_batch`` keeps the family of a growing corpus as tables: each level holds the segments that
some batches left, with their bytes. A new batch is scanned against all levels, whose segments count as earlier
documents, and its own new segments become a level; while two levels have one number they merge into the next.

*Hot keys.* A key that holds more than ``HOT`` different segments would load one task. Its segments are split into
single windows, keyed by the window's own hash and compared by a second 64-bit hash, again first inside each map task.

Marks are joined with the texts once, at the end. Nothing is dropped or capped.

Edge cases: a null text is empty; texts shorter than ``LENGTH`` bytes keep all bytes; rows are told apart by a row key,
so that rows with equal or null ids are documents like others, in the order of their keys; rows with a null id come after
all others; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitsports.llm.common import BASE, MIX_1, MIX_2, U, mix, powers, settle, with_row_key

LENGTH = 100
GRAM = 24
#: Different segments under one key from which the key counts as hot: in all, and inside one map task.
HOT, HOT_IN_TASK = 128, 12
ROWS = "kind int, key long, sig long, doc long, row long, start int, n int"
MARK, SEGMENT, HOT_SEGMENT, HOT_FLAG = 0, 1, 2, 3
PIECE = 1 << 20


def gram_hashes(buf: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hash of the ``size`` bytes from each place on (the last ones run over the end and are not used)."""
    h = mix(buf.astype(U) + U(BASE))
    out, done, at = None, 0, 1
    while done < size:
        if size & at:
            if out is None:
                out = h
            else:
                out = out.copy()
                out[: len(h) - done] = mix(out[: len(h) - done] * U(MIX_1) + h[done:])
            done += at
        if done < size:
            g = h * U(MIX_2)
            g[:-at] += h[at:]
            h = g ^ (g >> U(29))
            at *= 2
    return mix(out)


def sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest of ``width`` values from each place on; hashes are compared by their high bits."""
    bits = max(1, int(len(h) - 1).bit_length())
    low = U((1 << bits) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=U)
    span = 1
    while span < width:
        step = min(span, width - span)
        m[:-step] = np.minimum(m[:-step], m[step:])
        span += step
    return (m & low).astype(np.int64)


def segments_of(texts: list[bytes]):
    """Segments of all windows: (text number, start, windows, key, signature), and the gram hashes they come from."""
    sizes = np.array([len(t) for t in texts], np.int64)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    n = len(buf)
    if n < LENGTH:
        z = np.zeros(0, np.int64)
        return z, z, z, z.view(U), z.view(U)
    h = gram_hashes(buf)
    place = sliding_argmin(h, LENGTH - GRAM + 1)
    stops = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = np.arange(n) + LENGTH <= stops[owner]
    change = np.ones(n, bool)
    change[1:] = (place[1:] != place[:-1]) | ~inside[:-1] | (owner[1:] != owner[:-1])
    first = np.flatnonzero(inside & change)
    windows = np.cumsum(inside)
    upto = np.append(windows[first] - 1, windows[-1])
    count = np.diff(upto)
    up, down = powers(n)
    prefix = np.zeros(n + 1, U)
    np.cumsum(h * up[:n], out=prefix[1:])
    stop = first + count - 1 + LENGTH - GRAM + 1
    sig = mix((prefix[stop] - prefix[first]) * down[first] ^ count.astype(U) ^ (place[first] - first).astype(U) << U(32))
    return owner[first], first - (stops - sizes)[owner[first]], count, h[place[first]], sig


def window_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each ``LENGTH``-byte string; every text is one run of windows, and all runs are concatenated."""
    sizes = np.array([len(t) for t in texts], np.int64)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    up, down = powers(len(buf))
    starts = np.concatenate([np.arange(a, a + k - LENGTH + 1) for a, k in zip(np.cumsum(sizes) - sizes, sizes, strict=True)])
    out = []
    for salt in (U(MIX_1), U(MIX_2)):
        prefix = np.zeros(len(buf) + 1, U)
        np.cumsum(mix(buf.astype(U) + salt) * up[: len(buf)], out=prefix[1:])
        out.append(mix((prefix[starts + LENGTH] - prefix[starts]) * down[starts]))
    return out[0], out[1]


def _first_of_each(key, sig, doc, row, start):
    """Order by (key, sig, doc, row, start), and which rows are the first of their (key, sig)."""
    order = np.lexsort((start, row, doc, sig, key))
    k, s = key[order], sig[order]
    first = np.ones(len(order), bool)
    first[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
    return order, first


def _frame(kind, key, sig, doc, row, start, n):
    size = len(doc)
    return pd.DataFrame(
        {
            "kind": np.full(size, kind, np.int32) if np.isscalar(kind) else np.asarray(kind, np.int32),
            "key": np.asarray(key).view(np.int64),
            "sig": np.asarray(sig).view(np.int64),
            "doc": np.asarray(doc, np.int64),
            "row": np.asarray(row, np.int64),
            "start": np.asarray(start, np.int32),
            "n": np.asarray(n, np.int32),
        }
    )


def _spread(row: np.ndarray) -> np.ndarray:
    """A key that deals rows out evenly, for rows that only pass through."""
    return mix(row.astype(np.int64).view(U) + U(BASE))


def _joined_marks(row, start, n):
    """Marks of neighbouring runs become one."""
    order = np.lexsort((start, row))
    row, start, n = row[order], start[order].astype(np.int64), n[order].astype(np.int64)
    if not len(row):
        return row, start, n
    stop = start + n
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] > stop[:-1])
    at = np.flatnonzero(new)
    top = np.maximum.reduceat(stop, at)
    return row[at], start[at], top - start[at]


def _marks(row, start, n) -> pd.DataFrame:
    row, start, n = _joined_marks(row, start, n)
    return _frame(MARK, _spread(row), np.zeros(len(row), U), row, row, start, n)


def _map_side(frames):
    """Segments of all texts; repeats inside the task and keys that are hot inside it are settled here."""
    held, size = [], 0

    def settle_held():
        own, row, start, n, key, sig = (np.concatenate(x) for x in zip(*held, strict=True))
        order, first = _first_of_each(key, sig, own, row, start)
        again = order[~first]
        yield _marks(row[again], start[again], n[again])
        keep = order[first]
        same = np.ones(len(keep), bool)
        same[1:] = key[keep][1:] != key[keep][:-1]
        group = np.cumsum(same) - 1
        hot = np.bincount(group)[group] > HOT_IN_TASK if len(keep) else np.zeros(0, bool)
        cold = keep[~hot]
        yield _frame(SEGMENT, key[cold], sig[cold], own[cold], row[cold], start[cold], n[cold])
        warm = keep[hot]
        yield _frame(HOT_SEGMENT, _spread(row[warm]), np.zeros(len(warm), U), own[warm], row[warm], start[warm], n[warm])
        flag = keep[hot & same]
        zero = np.zeros(len(flag), np.int64)
        yield _frame(HOT_FLAG, key[flag], zero.view(U), zero, zero, zero, zero)

    for pdf in frames:
        texts = pdf["text"].tolist()
        docs, rows = pdf["doc"].to_numpy(np.int64), pdf["row"].to_numpy(np.int64)
        cut = np.cumsum([len(t) for t in texts]) // PIECE
        for piece in np.unique(cut):
            at = np.flatnonzero(cut == piece)
            own, start, n, key, sig = segments_of([texts[i] for i in at])
            held.append((docs[at][own], rows[at][own], start, n, key, sig))
            size += len(own)
        if size > 1_000_000:
            yield from settle_held()
            held, size = [], 0
    if held:
        yield from settle_held()


def _whole_groups(frames, column: str = "key"):
    """Cut a stream that is sorted by ``column`` so that no group is split between two pieces."""
    rest = None
    for pdf in frames:
        if rest is not None:
            pdf = pd.concat((rest, pdf), ignore_index=True)
        k = pdf[column].to_numpy()
        edge = np.searchsorted(k, k[-1]) if len(k) else 0
        rest = pdf.iloc[edge:]
        if edge:
            yield pdf.iloc[:edge]
    if rest is not None and len(rest):
        yield rest


def _by_key(frames):
    """Under each key: mark repeats of a signature, pass on different segments that share the key, drop single ones."""
    for pdf in _whole_groups(frames):
        kind = pdf["kind"].to_numpy()
        through = pdf[(kind == MARK) | (kind == HOT_SEGMENT)]
        if len(through):
            yield through
        rows = pdf[(kind == SEGMENT) | (kind == HOT_FLAG)]
        if not len(rows):
            continue
        key, sig, doc, row = rows["key"].to_numpy().view(U), rows["sig"].to_numpy().view(U), rows["doc"].to_numpy(), rows["row"].to_numpy()
        start, n, flag = rows["start"].to_numpy(), rows["n"].to_numpy(), (rows["kind"] == HOT_FLAG).to_numpy()
        flagged = np.unique(key[flag])
        key, sig, doc, row, start, n = (x[~flag] for x in (key, sig, doc, row, start, n))
        order, first = _first_of_each(key, sig, doc, row, start)
        again = order[~first]
        yield _marks(row[again], start[again], n[again])
        keep = order[first]
        if not len(keep):
            continue
        new = np.ones(len(keep), bool)
        new[1:] = key[keep][1:] != key[keep][:-1]
        group = np.cumsum(new) - 1
        count = np.bincount(group)[group]
        hot = np.isin(key[keep], flagged) | (count > HOT)
        cold = keep[~hot & (count > 1)]
        yield _frame(SEGMENT, key[cold], sig[cold], doc[cold], row[cold], start[cold], n[cold])
        warm = keep[hot]
        yield _frame(HOT_SEGMENT, _spread(row[warm]), np.zeros(len(warm), U), doc[warm], row[warm], start[warm], n[warm])


def _cut_out(frames):
    """Bytes of cold segments, and hashes of the windows of hot ones (the first of each inside the task)."""
    held, size = [], 0

    def settle_held():
        key, sig, doc, row, start = (np.concatenate(x) for x in zip(*held, strict=True))
        order, first = _first_of_each(key, sig, doc, row, start)
        again = order[~first]
        yield _marks(row[again], start[again], np.ones(len(again), np.int64)).assign(bytes=None)
        keep = order[first]
        yield _frame(HOT_SEGMENT, key[keep], sig[keep], doc[keep], row[keep], start[keep], np.ones(len(keep))).assign(bytes=None)

    for pdf in frames:
        cold, texts, docs, rows, starts = [], [], [], [], []
        for doc, row, text, segments in zip(pdf["doc"], pdf["row"], pdf["text"], pdf["segments"], strict=True):
            for x in segments:
                a, n = x["start"], x["n"]
                piece = text[a : a + n - 1 + LENGTH]
                if x["kind"] == SEGMENT:
                    cold.append((SEGMENT, x["key"], 0, doc, row, a, n, piece))
                else:
                    texts.append(piece)
                    docs.append(np.full(n, doc, np.int64))
                    rows.append(np.full(n, row, np.int64))
                    starts.append(np.arange(a, a + n))
        if cold:
            yield pd.DataFrame(cold, columns=["kind", "key", "sig", "doc", "row", "start", "n", "bytes"])
        if texts:
            held.append((*window_hashes(texts), np.concatenate(docs), np.concatenate(rows), np.concatenate(starts)))
            size += len(held[-1][0])
        if size > 1_000_000:
            yield from settle_held()
            held, size = [], 0
    if held:
        yield from settle_held()


class Level:
    """One sorted array of suffixes: (key, first ``LENGTH`` bytes) in order."""

    def __init__(self, items: np.ndarray):
        self.items = items

    def has(self, sorted_items: np.ndarray) -> np.ndarray:
        """Which of the sorted suffixes occur here: one merge-scan of two sorted arrays."""
        at = np.searchsorted(self.items, sorted_items)
        at[at == len(self.items)] = 0
        return self.items[at] == sorted_items if len(self.items) else np.zeros(len(sorted_items), bool)

    def merged(self, other: Level) -> Level:
        both = np.empty(len(self.items) + len(other.items), self.items.dtype)
        at = np.searchsorted(self.items, other.items, "right") + np.arange(len(other.items))
        rest = np.ones(len(both), bool)
        rest[at] = False
        both[at], both[rest] = other.items, self.items
        return Level(both)


class Family:
    """Levels of geometric sizes; level ``i`` holds what ``2**i`` batches left."""

    def __init__(self):
        self.levels: dict[int, Level] = {}

    def scan(self, suffixes: np.ndarray) -> np.ndarray:
        """Which of the sorted, distinct suffixes an earlier batch had; the others are added."""
        seen = np.zeros(len(suffixes), bool)
        for level in self.levels.values():
            seen |= level.has(suffixes)
        new, i = Level(suffixes[~seen]), 0
        while i in self.levels:
            new = self.levels.pop(i).merged(new)
            i += 1
        self.levels[i] = new
        return seen


def suffixes_of(key: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window suffixes of segments as fixed strings (key, then ``LENGTH`` bytes), with segment number and offset."""
    sizes = np.array([len(p) - LENGTH + 1 for p in pieces], np.int64)
    number = np.repeat(np.arange(len(pieces)), sizes)
    offset = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.empty((len(number), 8 + LENGTH), np.uint8)
    out[:, :8] = key.astype(">u8").view(np.uint8).reshape(-1, 8)[number]
    buf = np.frombuffer(b"".join(pieces), np.uint8)
    bases = np.cumsum([0, *[len(p) for p in pieces]])[:-1]
    out[:, 8:] = np.lib.stride_tricks.sliding_window_view(buf, LENGTH)[bases[number] + offset]
    return out.view(f"S{8 + LENGTH}").ravel(), number, offset


def _index(frames):
    """Batches in document order against the level family; hot windows by their hashes."""
    family = Family()
    hot: list[pd.DataFrame] = []
    for pdf in frames:
        kind = pdf["kind"].to_numpy()
        through = pdf[kind == MARK]
        if len(through):
            yield through[["row", "start", "n"]]
        if (kind == HOT_SEGMENT).any():
            hot.append(pdf.loc[kind == HOT_SEGMENT, ["key", "sig", "doc", "row", "start"]])
        rows = pdf[kind == SEGMENT]
        for a in range(0, len(rows), 4000):
            part = rows.iloc[a : a + 4000]
            items, number, offset = suffixes_of(part["key"].to_numpy().view(U), part["bytes"].tolist())
            order = np.argsort(items, kind="stable")  # rows come in document order, so equal suffixes stay in it
            sorted_items = items[order]
            first = np.ones(len(order), bool)
            first[1:] = sorted_items[1:] != sorted_items[:-1]
            seen = family.scan(sorted_items[first])
            marked = order[~first | np.repeat(seen, np.diff(np.append(np.flatnonzero(first), len(order))))]
            row = part["row"].to_numpy()[number[marked]]
            start = part["start"].to_numpy()[number[marked]] + offset[marked]
            yield _marks(row, start, np.ones(len(marked), np.int64))[["row", "start", "n"]]
    if hot:
        key, sig, doc, row, start = (np.concatenate([x[c].to_numpy() for x in hot]) for c in ("key", "sig", "doc", "row", "start"))
        order, first = _first_of_each(key, sig, doc, row, start)
        again = order[~first]
        yield _marks(row[again], start[again], np.ones(len(again), np.int64))[["row", "start", "n"]]


def marks(docs: DataFrame) -> DataFrame:
    """Rows (row, start, n): windows of ``docs`` (``row``, a key; ``doc``, its order; ``text``, binary) that also start earlier,
    as runs of n starts."""
    found = docs.mapInPandas(_map_side, ROWS)
    found = found.repartition("key").sortWithinPartitions("key").mapInPandas(_by_key, ROWS)
    found = settle(found)
    wanted = (
        found.where(f"kind in ({SEGMENT}, {HOT_SEGMENT})")
        .groupBy("row")
        .agg(F.collect_list(F.struct("kind", "key", "start", "n")).alias("segments"))
    )
    cut = docs.join(wanted, "row").mapInPandas(_cut_out, f"{ROWS}, bytes binary")
    late = cut.repartition("key").sortWithinPartitions("doc", "row", "start").mapInPandas(_index, "row long, start int, n int")
    return settle(found.where(f"kind = {MARK}").select("row", "start", "n").unionByName(late))


def _numbered(docs: DataFrame) -> DataFrame:
    keyed = with_row_key(docs.select("doc_id", "text"))
    doc_id = F.col("_doc.doc_id").cast("long").alias("doc_id")
    return keyed.select(F.col("_row").alias("row"), F.coalesce(doc_id, F.lit(2**63 - 1)).alias("doc"), doc_id, F.col("_doc.text").cast("binary").alias("text"))


def remove(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256 of each row of ``docs`` (``doc_id``, ``text``)."""
    numbered = _numbered(docs)
    return _without(numbered, marks(numbered.select("row", "doc", "text").where("text is not null")))


def _segments(frames):
    """Bytes of each text's segments, once for each signature of a batch."""
    for pdf in frames:
        texts = pdf["text"].tolist()
        own, start, n, key, sig = segments_of(texts)
        _, once = np.unique(np.stack((key, sig)), axis=1, return_index=True)
        cut = [texts[own[i]][start[i] : start[i] + n[i] - 1 + LENGTH] for i in once]
        yield pd.DataFrame({"key": key[once].view(np.int64), "sig": sig[once].view(np.int64), "text": cut})


def _manifest(spark: SparkSession, store: str) -> dict:
    """The newest manifest of a store: its number, the batches it holds, its levels' folders, and those before the last batch."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(store).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folder = hadoop(f"{store}/manifests")
    numbers = [int(n) for x in fs.listStatus(folder) if (n := x.getPath().getName()).isdigit()] if fs.exists(folder) else []
    if not numbers:
        return {"number": 0, "batches": [], "levels": {}, "before": {}}
    return json.loads(spark.read.text(f"{store}/manifests/{max(numbers)}", wholetext=True).first()[0])


def _publish(spark: SparkSession, store: str, manifest: dict) -> None:
    """Write a manifest beside its place and rename it: readers see it whole or not at all, and a number is given once."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(store).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    draft, place = (hadoop(f"{store}/manifests/{n}") for n in (f"draft-{uuid.uuid4().hex}", manifest["number"]))
    out = fs.create(draft)
    out.writeBytes(json.dumps(manifest))
    out.close()
    if fs.exists(place) or not fs.rename(draft, place):
        fs.delete(draft, False)
        raise RuntimeError("another call has added a batch to this store")


def add_batch(docs: DataFrame, store: str, batch: str | None = None) -> DataFrame:
    """As :func:`remove`, for the next batch of a corpus: what earlier batches hold counts as earlier, and the batch joins them.

    ``store`` is a folder that all executors share. The order of batches is the order of the calls; each call reads every
    level once. A call that is repeated with the name ``batch`` of the last one gives the same rows and adds nothing, so a
    call whose result was lost can be made again. Levels are folders of their own that a manifest names; a batch counts
    from its manifest on, which appears whole. Folders that neither the newest manifest nor the one before it names go.
    """
    spark = docs.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(store).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    now = _manifest(spark, store)
    batch = uuid.uuid4().hex if batch is None else batch
    again = now["batches"][-1:] == [batch]
    if batch in now["batches"] and not again:
        raise ValueError(f"batch {batch} lies before later ones; only the last batch can be repeated")
    folders = now["before"] if again else now["levels"]
    levels = {int(i): spark.read.parquet(f"{store}/{x}") for i, x in folders.items()}
    numbered = _numbered(docs)
    rows = numbered.select("row", "doc", "text").where("text is not null")
    every = rows
    for level in levels.values():
        every = every.unionByName(level.select((-1 - F.col("place")).alias("row"), F.lit(-(2**62)).alias("doc"), "text"))
    out = settle(_without(numbered, marks(every).where("row >= 0")))
    if again:
        return out
    new = rows.select("text").mapInPandas(_segments, "key long, sig long, text binary")
    kept = dict(folders)
    i = 0
    while i in levels:
        new = new.unionByName(levels[i].select("key", "sig", "text"))
        del kept[str(i)]
        i += 1
    merged = new.dropDuplicates(["key", "sig"]).repartition("key").sortWithinPartitions("key", "sig")
    settled = settle(merged.withColumn("place", F.monotonically_increasing_id() + F.lit(i) * F.lit(1 << 55)))
    kept[str(i)] = f"level-{uuid.uuid4().hex}"
    settled.write.parquet(f"{store}/{kept[str(i)]}")
    _publish(spark, store, {"number": now["number"] + 1, "batches": [*now["batches"], batch], "levels": kept, "before": folders})
    for x in {*now["before"].values()} - {*kept.values(), *folders.values()}:
        fs.delete(hadoop(f"{store}/{x}"), True)
    return out


def _without(numbered: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``numbered`` without the windows ``found``."""
    grouped = found.groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("runs"))

    def run(frames):
        for pdf in frames:
            out = []
            for doc_id, text, runs in zip(pdf["doc_id"], pdf["text"], pdf["runs"], strict=True):
                raw = b"" if text is None else text
                spans = []
                if runs is not None:
                    for a, b in sorted((r["start"], r["start"] + r["n"] - 1 + LENGTH) for r in runs):
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = max(b, spans[-1][1])
                        else:
                            spans.append([a, b])
                keep, at = [], 0
                for a, b in spans:
                    keep.append(raw[at:a])
                    at = b
                keep.append(raw[at:])
                kept = b"".join(keep)
                out.append((doc_id, len(raw), len(raw) - len(kept), len(spans), kept, hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    joined = numbered.join(grouped, "row", "left").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "runs")
    schema = "doc_id string, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    return joined.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove(docs).drop("kept")
