"""Token-ID output: Parquet list columns with dictionary and delta encoding, bounded row groups and page indexes.

Documents are range-partitioned by ``doc_id`` and sorted, encoded inside tasks and written by Spark's Parquet writer:
``ids`` (array of int, dictionary-encoded), ``doc_id``, ``n_tokens``, ``part`` and the ``row`` in it (delta-encoded, format v2). Row groups
and pages are small enough that a reader who wants a few documents, or the metadata columns alone, skips the rest by the
page index. File names ascend with ``doc_id``.

Encoding splits a text at ASCII white space, which the tokenizer drops. Of the distinct words of a slice, those of plain
letters with punctuation behind them are put together from two parts, the letters in lower case (the tokenizer treats
both alike) and the punctuation; other words are a part of their own. A worker remembers the parts it has met, and gives
new ones of letters to the tokenizer many at a time: each ends in the only piece that ends a word. ``exact`` switches to
one call a text, for tokenizers that keep white space or case.

``read`` gives chosen documents or columns back: ids and bounds go to the scan, so that row groups and pages whose
statistics exclude them are not decoded, and columns that are not asked for are not read.

Edge cases: a null or empty text has only the end id; rows with equal ids are written next to each other, ordered by
length and content; a null id sorts first; extra columns are ignored; an empty table gives an empty file set.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitsports.llm.common import scratch

END_ID = 1
#: Distinct parts of words that a worker remembers before it forgets the rarer half (bounds its memory).
MEMORY = 700_000
#: Bytes of text that a task works on at a time, and parts that the tokenizer gets in one string.
PIECE_BYTES, TOGETHER = 4 << 20, 500
FILE_SCHEMA = "doc_id long, part int, row long, n_tokens long, ids array<int>"
WRITER = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.enable.dictionary#row": "false",
    "parquet.column.index.enabled": "true",
}


#: Latin letters whose lower case is one letter, then perhaps ASCII punctuation.
_PLAIN = "^(?P<letters>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)(?P<rest>[!-/:-@\\[-`{-~]*)$"


class WordEncoder:
    """Encode texts by the parts of their words through a bounded memory of parts already encoded."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.at: dict[str, int] = {}
        self.ids = np.empty(1 << 20, np.int32)
        self.starts = np.zeros(1 << 18, np.int64)
        self.met = np.zeros(1 << 18, np.int64)
        self.n = self.used = 0

    def forget(self) -> None:
        """Keep the parts met most often, at most half of the memory, and none met only once."""
        met = self.met[: self.n]
        keep = np.flatnonzero(met > max(1, np.partition(met, -(MEMORY // 2))[-(MEMORY // 2)]))
        number = np.full(self.n, -1, np.int64)
        number[keep] = np.arange(len(keep))
        self.at = {w: int(number[i]) for w, i in self.at.items() if number[i] >= 0}
        lengths = (self.starts[1 : self.n + 1] - self.starts[: self.n])[keep]
        stop = np.concatenate(([0], np.cumsum(lengths)))
        self.ids[: stop[-1]] = self.ids[np.repeat(self.starts[keep] - stop[:-1], lengths) + np.arange(stop[-1])]
        self.starts[: len(stop)] = stop
        self.met[: len(keep)] = met[keep]
        self.met[len(keep) :] = 0
        self.n, self.used = len(keep), int(stop[-1])

    def _one_by_one(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        return np.array([i for x in lists for i in x], np.int32), np.array([len(x) for x in lists], np.int64)

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, encoded in one string each ``TOGETHER``, and their number for each word."""
        texts = [" ".join(words[a : a + TOGETHER]) for a in range(0, len(words), TOGETHER)]
        ids = np.concatenate([np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        stops = np.flatnonzero(self.ends_word[ids]) + 1
        if len(stops) != len(words) or stops[-1] != len(ids):  # a tokenizer that does not end words so
            return self._one_by_one(words)
        return ids, np.diff(stops, prepend=0)

    def learn(self, parts: list[str], of_letters: bool) -> None:
        """Remember new ``parts``."""
        for a in range(0, len(parts), 50_000):
            some = parts[a : a + 50_000]
            ids, sizes = (self._together if of_letters else self._one_by_one)(some)
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
            while self.n + len(some) + 1 > len(self.starts):
                self.starts = np.concatenate((self.starts, np.zeros_like(self.starts)))
                self.met = np.concatenate((self.met, np.zeros_like(self.met)))
            self.at.update(zip(some, range(self.n, self.n + len(some)), strict=True))
            self.ids[self.used : self.used + len(ids)] = ids
            self.starts[self.n + 1 : self.n + 1 + len(some)] = self.used + np.cumsum(sizes)
            self.n += len(some)
            self.used += len(ids)

    def numbers(self, parts: pa.Array, of_letters: bool) -> np.ndarray:
        """The number of each of the distinct ``parts``, new ones included."""
        values = parts.to_pylist()
        got = list(map(self.at.get, values))
        new = [v for v, g in zip(values, got, strict=True) if g is None]
        if new:
            self.learn(new, of_letters)
            got = map(self.at.__getitem__, values)
        return np.fromiter(got, np.int64, len(values))

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each of the distinct ``words`` the numbers of its two parts."""
        split = pc.extract_regex(words, pattern=_PLAIN)
        plain = split.is_valid()
        of_plain = split.filter(plain)
        letters = pc.utf8_lower(of_plain.field("letters")).dictionary_encode()
        rest = of_plain.field("rest").dictionary_encode()
        first, second = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        at = plain.to_numpy(zero_copy_only=False)
        second[~at] = self.numbers(pa.array([""], pa.string()), False)[0]
        second[at] = self.numbers(rest.dictionary, False)[rest.indices.to_numpy()]
        first[at] = self.numbers(letters.dictionary, True)[letters.indices.to_numpy()]
        first[~at] = self.numbers(words.filter(pc.invert(plain)), False)
        return first, second

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids with the end id after each text (null: empty), and the number of ids of each text."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if self.n > MEMORY:
            self.forget()
        split = pc.ascii_split_whitespace(texts)
        found = split.flatten().dictionary_encode()
        word = found.indices.to_numpy()
        first, second = self.words(found.dictionary)
        part = np.stack((first, second), 1).ravel()
        self.met[: self.n] += np.bincount(part, minlength=self.n)
        ids, sizes = _gathered(self.ids, self.starts[part], self.starts[part + 1] - self.starts[part])
        size = sizes.reshape(-1, 2).sum(1)
        ids, sizes = _gathered(ids, (np.cumsum(size) - size)[word], size[word])
        stop = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(pc.list_value_length(split).to_numpy())] if len(texts) else np.zeros(0, np.int64)
        return np.insert(ids, stop, END_ID), np.diff(stop, prepend=0) + 1


def _gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``values`` that have these starts and sizes, one after another, and the sizes."""
    before = np.cumsum(sizes) - sizes
    return values[np.repeat(starts - before, sizes) + np.arange(sizes.sum())], sizes


_encoders: dict[str, WordEncoder] = {}


def _encode(path: str, exact: bool):
    def run(frames):
        if path not in _encoders:
            _encoders[path] = WordEncoder(path)
        encoder, row = _encoders[path], 0
        for batch in frames:
            rows = max(1, PIECE_BYTES * batch.num_rows // max(1, batch.nbytes))
            for a in range(0, batch.num_rows, rows):
                piece = batch.slice(a, rows)
                if exact:
                    lists = [[] if t is None else encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in piece.column("text").to_pylist()]
                    sizes = np.array([len(x) + 1 for x in lists], np.int64)
                    flat = np.concatenate([np.array([*x, END_ID], np.int32) for x in lists])
                else:
                    flat, sizes = encoder.encode(piece.column("text"))
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("part"), pa.array(np.arange(row, row + piece.num_rows)), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))],
                    ["doc_id", "part", "row", "n_tokens", "ids"],
                )
                row += piece.num_rows

    return run


def write(docs: DataFrame, path: str, tokenizer: str, exact: bool = False) -> None:
    """Write the token file set of ``docs`` (``doc_id``, ``text``) below ``path`` in ascending ``doc_id`` order."""
    order = [F.col("doc_id").asc_nulls_first(), F.length("text"), F.xxhash64("text")]  # rows of one id may lie in several parts
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order, "text")
        .withColumn("part", F.spark_partition_id())
    )
    encoded = ordered.mapInArrow(_encode(tokenizer, exact), FILE_SCHEMA)
    encoded.write.options(**WRITER).parquet(path)


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None, between: tuple[int, int] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rows of a token file set: of all documents, of the chosen ``doc_ids``, or of those from the first to the last id of
    ``between``; and all of ``FILE_SCHEMA``'s columns or the chosen ones. Ids that are not there give no rows."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    if doc_ids is not None:
        files = files.where(F.col("doc_id").isin(list(doc_ids)))
    if between is not None:
        files = files.where(F.col("doc_id").between(*between))
    return files.select(*columns) if columns else files


def digest(spark: SparkSession, path: str) -> DataFrame:
    """Read a token file set back: doc_id, start, n_tokens, ids_crc32 of each document.

    ``start`` is a sum in two levels: the totals of the parts (a row for each file) and a running sum inside each part.
    """

    def run(frames):
        for batch in frames:
            ids = batch.column("ids")
            values, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), batch.column("row"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
                ["doc_id", "part", "row", "n_tokens", "ids_crc32"],
            )

    files = read(spark, path)
    rows = files.select("doc_id", "part", "row", "ids").mapInArrow(run, "doc_id long, part int, row long, n_tokens long, ids_crc32 long")
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("_total"))
    before = totals.select("part", (F.sum("_total").over(Window.orderBy("part")) - F.col("_total")).alias("_before"))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    return rows.join(before, "part").select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")


def op10_token_output(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    path = scratch(spark)
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer)
    return digest(spark, path)
