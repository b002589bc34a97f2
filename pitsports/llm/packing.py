"""Sequence packing by minimum bin slack.

A task encodes its documents as they come. Of a document's ids, whole windows of ``WINDOW`` ids are sequences of their own;
the rest waits. When the waiting ids fill many windows, their lengths are a multiset, and windows are filled one pattern at
a time: the longest length is fixed, a subset-sum dynamic programme over bit sets (bit s: some choice of lengths sums to s;
a length's copies enter as powers of two) finds the sum closest to the window, and walking back over the steps gives how
many of each length the pattern takes. A pattern is used as often as the lengths allow. Where no choice fills the window, one
more length is cut and its rest waits again. At a task's end the ids that do not fill a window become sequences whose lengths
are powers of two, filled alike. So no sequence has any padding, documents move nowhere, and a task holds the ids of one
block; nothing depends on how keys, sources or lengths are distributed.

Byte-level BPE pieces do not depend on what stands before white space that follows other characters, on what follows a
lone line feed, or on what is across the border of ASCII letters or digits and punctuation (but for the apostrophe and what
special tokens are written with). Texts are cut there, and a worker remembers the ids of the pieces met (a bounded number
of short ones).

Edge cases: a null or empty text has only the end id; repeated rows and null ids are packed like others; texts of any
length are encoded in slices; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitsports.llm.tokens import END_ID, MEMORY, TOGETHER, WordEncoder, _gathered

WINDOW = 2048
#: Waiting ids at which windows are filled, the share of them that then goes on waiting, bytes encoded at a time, and bytes
#: of the longest piece that is remembered.
BLOCK, KEEP, SLICE, SHORT = 1 << 20, 0.2, 8 << 20, 48
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: ASCII characters that are not white space, and first bytes of two-byte characters without white space (U+00C0 to U+07FF).
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_LEAD = np.zeros(256, bool)
_LEAD[0xC3:0xE0] = True
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


# encoding


class PieceEncoder(WordEncoder):
    """Encodes texts by the pieces between safe cuts through a bounded memory of pieces already encoded."""

    def __init__(self, path: str):
        super().__init__(path)
        vocabulary = self.tokenizer.get_vocab()
        self.begins_word = np.zeros(len(self.ends_word), bool)
        self.begins_word[[i for piece, i in vocabulary.items() if piece.startswith("\u0120")]] = True  # how a space is written
        added = "".join(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        if any(c.isspace() for c in added):
            raise ValueError("a special token with white space cannot be kept in one piece")
        self.kind = np.zeros(256, np.uint8)  # 1: letters and digits, 2: punctuation that is in no special token; ASCII only
        self.kind[[c for c in range(128) if chr(c).isalnum()]] = 1
        self.kind[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in added + "'"]] = 2

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Whether UTF-8 ``data`` can be cut before each byte without changing its ids."""
        cut = np.zeros(len(data), bool)
        if len(data) < 2:
            return cut
        solid = _SOLID[data]
        solid[1:] |= _LEAD[data[:-1]]
        cut[1:] = _WHITE[data[1:]] & solid[:-1]
        feed = np.flatnonzero(cut[:-1] & (data[:-1] == 0x0A))
        cut[feed[_SOLID[data[feed + 1]] | _LEAD[data[feed + 1]]] + 1] = True
        kind = self.kind[data]
        cut[1:] |= kind[1:] ^ kind[:-1] == 3
        return cut

    def learn(self, parts: list[str], of_letters: bool) -> None:
        """Remember new ``parts``; those that are a space and letters are encoded many at a time."""
        plain = [p for p in parts if p[0] == " " and p[1:].isalpha()]
        super().learn(plain, True)
        if len(plain) < len(parts):
            super().learn([p for p in parts if not (p[0] == " " and p[1:].isalpha())], False)

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        texts = ["".join(words[a : a + TOGETHER]) for a in range(0, len(words), TOGETHER)]
        ids = np.concatenate([np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        starts = np.flatnonzero(self.begins_word[ids])
        if len(starts) != len(words) or starts[0]:  # a tokenizer that does not write spaces so
            return self._one_by_one(words)
        return ids, np.diff(starts, append=len(ids))

    def _slices(self, text: bytes):
        """``text`` in slices of about ``SLICE`` bytes."""
        at = 0
        while len(text) - at > 2 * SLICE:
            stop, found = at + SLICE, np.zeros(0, np.int64)
            while not len(found) and stop < len(text):
                found = np.flatnonzero(self.cuts(np.frombuffer(text, np.uint8, min(SLICE, len(text) - stop), stop)))
                stop += int(found[0]) if len(found) else SLICE
            stop = min(stop, len(text))
            yield text[at:stop]
            at = stop
        yield text[at:]

    def _some(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``texts``, and the number of ids of each."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        cut = np.append(self.cuts(data), True)
        cut[ends], cut[0] = True, True
        edge = np.flatnonzero(cut)
        pieces = pa.Array.from_buffers(pa.string(), len(edge) - 1, [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(data)])
        short = np.diff(edge) <= SHORT
        found = pieces.filter(pa.array(short)).dictionary_encode()
        number = self.numbers(found.dictionary, False)[found.indices.to_numpy()]
        self.met[: self.n] += np.bincount(number, minlength=self.n)
        long_ids, long_sizes = self._one_by_one(pieces.filter(pa.array(~short)).to_pylist())
        starts, sizes = np.empty(len(short), np.int64), np.empty(len(short), np.int64)
        starts[short], sizes[short] = self.starts[number], self.starts[number + 1] - self.starts[number]
        starts[~short], sizes[~short] = self.used + np.cumsum(long_sizes) - long_sizes, long_sizes
        ids, sizes = _gathered(np.concatenate((self.ids[: self.used], long_ids)), starts, sizes)
        before = np.concatenate(([0], np.cumsum(sizes)))
        return ids, np.diff(before[np.searchsorted(edge, ends)], prepend=0)

    def encoded(self, texts):
        """The ids of each text (null: empty) with the end id."""
        waiting, size = [], 0
        for text in texts:
            text = b"" if text is None else text
            if self.n > MEMORY:
                self.forget()
            if size + len(text) > SLICE:
                yield from self._ended(waiting)
                waiting, size = [], 0
            if len(text) > SLICE:
                yield np.concatenate([*(self._some([part])[0] for part in self._slices(text)), [END_ID]]).astype(np.int32)
            else:
                waiting.append(text)
                size += len(text)
        yield from self._ended(waiting)

    def _ended(self, texts: list[bytes]):
        at = 0
        ids, sizes = self._some(texts) if texts else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        for n in sizes.tolist():
            yield np.append(ids[at : at + n], np.int32(END_ID))
            at += n


# packing


def pattern(counts: dict[int, int], window: int) -> dict[int, int]:
    """How many of each length fill ``window`` closest without the longest one that fits being left out: {length: number}."""
    longest = max(counts, default=0)
    if longest > window:
        longest = max((x for x in counts if x <= window), default=0)
    if not longest:
        return {}
    room = window - longest
    bits, steps, all_, full = 1, [], (1 << room + 1) - 1, 1 << room
    for x in sorted((x for x in counts if x <= room), reverse=True):
        left, copies = min(counts[x] - (x == longest), room // x), 1
        while left and not bits & full:
            take = min(copies, left)
            steps.append((x, take, bits))
            bits |= bits << x * take & all_
            left -= take
            copies *= 2
        if bits & full:
            break
    total, used = bits.bit_length() - 1, {longest: 1}
    for x, take, before in reversed(steps):
        if not before >> total & 1:
            used[x] = used.get(x, 0) + take
            total -= x * take
    return used


class Packer:
    """The waiting pieces of a task, by length; ``put`` and ``rest`` yield filled sequences as lists of pieces.

    A piece is (doc_id, start, doc_tokens, ids)."""

    def __init__(self, window: int = WINDOW, block: int = BLOCK):
        self.window, self.block = window, block
        self.pieces: dict[int, list] = {}
        self.counts: dict[int, int] = {}
        self.total = 0

    def put(self, doc_id, ids: np.ndarray):
        n, w = len(ids), self.window
        for a in range(0, n - w + 1, w):
            yield [(doc_id, a, n, ids[a : a + w])]
        if n % w:
            self._wait((doc_id, n - n % w, n, ids[n - n % w :].copy()))
            if self.total >= self.block:
                yield from self._filled(self.window, int(self.block * KEEP))

    def rest(self):
        """Everything that waits: full windows, then sequences of a power of two."""
        yield from self._filled(self.window)
        for k in reversed(range(self.window.bit_length())):
            yield from self._filled(1 << k)

    def _wait(self, piece) -> None:
        length = len(piece[3])
        self.pieces.setdefault(length, []).append(piece)
        self.counts[length] = len(self.pieces[length])
        self.total += length

    def _take(self, length: int):
        piece = self.pieces[length].pop()
        self.counts[length] -= 1
        if not self.counts[length]:
            del self.pieces[length], self.counts[length]
        self.total -= length
        return piece

    def _filled(self, window: int, keep: int = 0):
        """Sequences of ``window`` ids while that many wait, and at least ``keep``."""
        while self.total >= max(keep, window):
            used = pattern(self.counts, window)
            gap = window - sum(x * n for x, n in used.items())
            times = 1 if gap else min(self.counts[x] // n for x, n in used.items())
            for _ in range(times):
                if self.total < max(keep, window):
                    return
                out = [self._take(x) for x, n in used.items() for _ in range(n)]
                if gap:  # cut the shortest piece that is long enough
                    doc_id, start, tokens, ids = self._take(min(x for x in self.pieces if x > gap))
                    out.append((doc_id, start, tokens, ids[:gap]))
                    self._wait((doc_id, start + gap, tokens, ids[gap:]))
                yield out


_encoders: dict[str, PieceEncoder] = {}


def _packed(path: str, window: int, block: int):
    def run(batches):
        if path not in _encoders:
            _encoders[path] = PieceEncoder(path)
        packer, number, rows, held = Packer(window, block), TaskContext.get().partitionId() << 32, [], 0

        def out():
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 6 + [pa.binary()]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        def sequences():
            for batch in batches:
                texts = _encoders[path].encoded(batch.column("text").cast(pa.binary()).to_pylist())
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                    yield from packer.put(doc_id, ids)
            yield from packer.rest()

        for sequence in sequences():
            offset = 0
            for doc_id, start, tokens, ids in sequence:
                rows.append((doc_id, start, len(ids), tokens, number, offset, ids.astype("<u4").tobytes()))
                offset += len(ids)
            held += offset
            number += 1
            if held >= BLOCK:
                yield out()
                held = 0
        yield out()

    return run


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Packed pieces of all documents (``doc_id``, ``text``): doc_id, start, length, doc_tokens, sequence_id, offset, and
    ``ids`` as little-endian unsigned 32-bit integers."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_packed(tokenizer, window, block), SCHEMA)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length and ids (binary, as in ``pieces``) of each sequence of at most a window."""
    parts = F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("hex"))))
    joined = F.unhex(F.array_join(F.transform(parts, lambda p: p["hex"]), ""))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))


def op13_sequence_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    packed = pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
