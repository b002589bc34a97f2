"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A text's shingles are its distinct runs of five words (lower-cased A-Z). A document holds an item if at least 80 % of
the item's shingles are among its own, however long the document is.

*Sketches.* The items are partitioned by size. Each gets a bottom-m MinHash sketch: its ``m`` shingles of smallest hash,
with ``m = floor(0.2 * largest size of the class) + SURPLUS``, never more than the item has. A document that holds an
item of ``n`` shingles lacks at most ``floor(0.2 * n)`` of them, so it has at least ``m - floor(0.2 * n)`` of the
sketch, three or more for all but the smallest items: the search for documents with so many sketch hashes finds every
such pair, whatever the document's length, and a common phrase alone makes no candidate.

*Verification.* Only candidate pairs are held against the item's whole set, exactly (64-bit hashes).

While the items' counted shingles stay below ``broadcast_limit``, their index travels to all tasks, and both steps are
made where the document is read, without a shuffle. Beyond it the documents' hashes meet the sketches in a shuffle
join, and the hashes of candidate documents meet the items' sets in another.

Edge cases: rows with a null id are skipped; null or blank texts and texts of fewer than five words have no shingles and
match nothing; items that repeat under several ids match under each; a doc_id that repeats is searched row by row, and
equal results are given once; empty tables give no pairs; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitsports.llm.common import U, batches, distinct_per_owner, settle, shingle_hashes, word_hashes

WIDTH = 5
CONTAINMENT = (4, 5)
#: Shingles of a sketch beyond those that a document may lack.
SURPLUS = 3
#: Largest number of item shingles whose index is broadcast (at most 24 bytes each).
BROADCAST_LIMIT = 2_000_000
RESULT = "doc_id string, item_id long, n_item_shingles long, n_common long"


def _sets(id_column: str):
    """Rows (id, h): the distinct shingle hashes of each text."""

    def run(frames):
        for pdf in batches(frames):
            h, owner = distinct_per_owner(*shingle_hashes(*word_hashes(pdf["text"].tolist()), WIDTH, False))
            yield pd.DataFrame({id_column: pdf[id_column].to_numpy()[owner], "h": h.view(np.int64)})

    return run


class Index:
    """The items' sets, the sorted distinct sketch hashes, and the items that have each of these in their sketch."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values(["item_id", "h"], kind="stable")
        item, h, sketch = rows["item_id"].to_numpy(np.int64), rows["h"].to_numpy(np.int64).view(U), rows["in_sketch"].to_numpy(bool)
        self.items, number, self.sizes = np.unique(item, return_inverse=True, return_counts=True)
        self.sets, self.starts = h, np.cumsum(self.sizes) - self.sizes
        self.need = np.bincount(number, sketch, len(self.items)).astype(np.int64) - allowed(self.sizes)
        order = np.flatnonzero(sketch)[np.argsort(h[sketch], kind="stable")]
        self.keys, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.holder = number[order].astype(np.int32)

    def candidates(self, h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (text, item) that share enough of the item's sketch; ``h`` and ``owner`` are the texts' shingles."""
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == h if len(self.keys) else np.zeros(len(h), bool)
        at, owner = distinct_per_owner(at[hit], owner[hit])
        n = self.count[at]
        item = self.holder[np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())].astype(np.int64)
        pair, shared = np.unique(np.repeat(owner, n) * len(self.items) + item, return_counts=True)
        owner, item = pair // max(1, len(self.items)), pair % max(1, len(self.items))
        enough = shared >= self.need[item]
        return owner[enough], item[enough]

    def common(self, item: int, h: np.ndarray) -> int:
        """How many of an item's shingles are among the sorted ``h``."""
        own = self.sets[self.starts[item] : self.starts[item] + self.sizes[item]]
        at = np.searchsorted(h, own)
        at[at == len(h)] = 0
        return int(np.count_nonzero(h[at] == own)) if len(h) else 0


def allowed(n):
    """How many of its ``n`` shingles an item may lack."""
    return n - -(-n * CONTAINMENT[0] // CONTAINMENT[1])


def _found_in_task(index):
    """Rows of ``RESULT``: candidates by sketch, then exact containment."""

    def run(frames):
        items = index.value
        for pdf in batches(frames):
            h, owner = shingle_hashes(*word_hashes(pdf["text"].tolist()), WIDTH, False)
            texts, found = items.candidates(h, owner)
            keep = np.isin(owner, texts)
            h, owner = distinct_per_owner(h[keep], owner[keep])
            ends = np.searchsorted(owner, texts), np.searchsorted(owner, texts, "right")
            common = np.array([items.common(i, h[a:b]) for i, a, b in zip(found, *ends, strict=True)], np.int64)
            n = items.sizes[found]
            good = n - common <= allowed(n)
            ids = pdf["doc_id"].to_numpy()
            yield pd.DataFrame({"doc_id": ids[texts[good]], "item_id": items.items[found[good]], "n_item_shingles": n[good], "n_common": common[good]})

    return run


def sketches(items: DataFrame) -> DataFrame:
    """Rows (item_id, h, n, need, in_sketch): all shingles of each item, its size, whether the shingle is in its sketch, and
    how many of these a document that holds the item has at least."""
    shingles = items.select("item_id", "text").where("item_id is not null").dropDuplicates().mapInPandas(_sets("item_id"), "item_id long, h long").distinct()
    sized = shingles.groupBy("item_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("h")).alias("hs"))
    top = F.pow(F.lit(2.0), F.floor(F.log2(F.col("n").cast("double"))) + 1).cast("long") - 1  # the largest size of n's class
    num, den = CONTAINMENT
    lacking = lambda n: F.floor(n * (den - num) / den)
    m = F.least(F.col("n"), lacking(top) + SURPLUS).cast("int")
    sized = sized.select("item_id", "n", m.alias("m"), (m - lacking(F.col("n"))).alias("need"), F.posexplode("hs").alias("at", "h"))
    return sized.select("item_id", "h", "n", "need", (F.col("at") < F.col("m")).alias("in_sketch"))


def _by_shuffle(docs: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of ``RESULT`` where the index is too large for a task."""
    keyed = settle(docs.withColumn("row", F.monotonically_increasing_id()))
    hashes = keyed.select("row", "text").mapInPandas(_sets("row"), "row long, h long")
    shared = hashes.join(index.where("in_sketch").select("item_id", "h", "need").hint("merge"), "h").groupBy("row", "item_id").agg(F.count("*").alias("k"), F.first("need").alias("need"))
    candidates = settle(shared.where("k >= need").select("row", "item_id"))
    few = keyed.join(candidates.select("row").distinct(), "row", "left_semi").select("row", "text").mapInPandas(_sets("row"), "row long, h long")
    wanted = candidates.join(index.select("item_id", "h", "n"), "item_id")
    common = wanted.join(few, ["row", "h"]).groupBy("row", "item_id").agg(F.first("n").alias("n_item_shingles"), F.count("*").alias("n_common"))
    num, den = CONTAINMENT
    good = common.where(F.col("n_common") * den >= F.col("n_item_shingles") * num)
    return good.join(keyed.select("row", "doc_id"), "row").select("doc_id", "item_id", "n_item_shingles", "n_common")


def search(docs: DataFrame, items: DataFrame, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Rows (doc_id, item_id, n_item_shingles, n_common): every document that holds an item."""
    index = settle(sketches(items))
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").where("doc_id is not null")  # as text, ids stay exact
    if index.count() <= broadcast_limit:
        shared = docs.sparkSession.sparkContext.broadcast(Index(index.select("item_id", "h", "in_sketch").toPandas()))
        found = docs.mapInPandas(_found_in_task(shared), RESULT)
    else:
        found = _by_shuffle(docs, index)
    return found.withColumn("doc_id", F.col("doc_id").cast("long")).distinct()


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return search(docs, items)


OP1_SQL = r"""
WITH tokens AS (
  SELECT id, kind, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM (SELECT doc_id AS id, 'd' AS kind, text FROM documents UNION ALL SELECT item_id, 'i', text FROM benchmark)
), shingles AS (
  SELECT DISTINCT id, kind, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT id, kind, w, unnest(range(1, len(w) - 3)) AS i FROM tokens WHERE len(w) >= 5)
), sizes AS (SELECT id, count(*) AS n FROM shingles WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, any_value(sizes.n) AS n_item_shingles, count(*) AS n_common
FROM shingles d JOIN shingles i ON d.s = i.s AND d.kind = 'd' AND i.kind = 'i' JOIN sizes ON sizes.id = i.id
GROUP BY d.id, i.id HAVING count(*) * 5 >= any_value(sizes.n) * 4
"""
