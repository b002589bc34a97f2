"""SentencePiece encoding and decoding with sampled segmentations: Gumbel top-k without replacement.

*Lattice.* A text gets a leading blank and its spaces become the blank mark of the model. Pieces never cross the start of
a run of marks, so the text is a sequence of chunks with a lattice each: nodes are byte places, edges are pieces of the
vocabulary, and the single bytes of characters that have no piece of their own, so every text can be
encoded and decoded back byte for byte. An edge weighs ``-alpha * ln(rank + RANK_SHIFT)`` by the piece's rank in the
vocabulary (frozen; bytes take the last rank). Lattices are built once per distinct chunk of a batch. A chunk longer than
``LONG`` bytes is split into units at the places that no edge crosses: every segmentation passes there, so the units'
lattices are independent, and text without spaces costs what words cost.

*Sampling.* Segmentations have probability proportional to the product of their edges' weights. Backward sums turn edge
weights into exact transition probabilities. Each segmentation's log-probability plus Gumbel noise is its key; the k
largest keys are a sample without replacement. They are found by A-star search: the whole set of segmentations gets the
largest key, a Gumbel variate; its winner is drawn down the lattice; then, at each node on the winner's path, the set of
segmentations that leave the path there gets its own largest key, a Gumbel variate of that set's exact mass truncated at
its parent's key, and goes into the queue. The set with the largest key is popped next, its winner is drawn, and it is
split in the same way. Keys are exact bounds, so the popped winners are the exact top k, all distinct.

*Inclusion.* With the (k+1)-th key as threshold t, a segmentation of log-probability l was included with probability
``1 - exp(-exp(l - t))`` (1 if there are no more than k).

All noise is a hash of (seed, row key, sample, place), so results do not depend on batches or on partitions.

Edge cases: a null or empty text has one segmentation, without pieces, with inclusion 1; texts with fewer than k
segmentations give them all; rows with equal keys get equal noise; a null key counts as -1; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitsports.llm.common import BASE, MIX_1, MIX_2, U, mix, powers

BLANK = b"\xfe"
SAMPLES = 2
SEED = 20
ALPHA = 1.0
RANK_SHIFT = 10.0
#: Bytes of text that a task works on at a time.
PIECE_BYTES = 1 << 19
#: Bytes of a chunk from which it is split into units. In units no longer than this, products of weights stay within doubles;
#: in longer ones the sums are made edge by edge from logarithms.
LONG = 56
#: Frequent chunks whose lattices a task keeps.
KEPT = 60_000
MASK = 0xFFFFFFFFFFFFFFFF


class Vocabulary:
    """A model's pieces as one hash table for each length: all prefixes of pieces, with the id where a prefix is a piece.

    Inside, the blank mark is the byte 254, which no UTF-8 text holds; so a literal mark in a text has no piece.
    """

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces: list[bytes] = [b""] * n
        self.byte_id = np.full(256, sp.unk_id(), np.int64)
        prefixes: dict[int, dict[bytes, int]] = {}
        for i in range(n):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                continue
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.pieces[i] = bytes([int(piece[3:5], 16)])
                self.byte_id[self.pieces[i][0]] = i
                continue
            raw = self.pieces[i] = piece.encode().replace("▁".encode(), BLANK)
            for length in range(1, len(raw)):
                prefixes.setdefault(length, {}).setdefault(raw[:length], -1)
            prefixes.setdefault(len(raw), {})[raw] = i
        self.weight = -alpha * np.log(np.arange(n) + RANK_SHIFT)
        self.weight[self.byte_id] = -alpha * np.log(n + RANK_SHIFT)
        self.factor = np.exp(self.weight)
        self.in_range = float(-self.weight.min() * LONG) < 690  # whether products over LONG bytes stay within doubles
        #: pieces of one and two bytes by their bytes; -2 where not even a prefix
        self.short = [np.full(256, -2, np.int64), np.full(1 << 16, -2, np.int64)]
        for length, table in enumerate(self.short, 1):
            for raw, i in prefixes.get(length, {}).items():
                table[int.from_bytes(raw, "big")] = i
        self.tables: list[tuple[int, np.ndarray, np.ndarray]] = []
        for length in sorted(set(prefixes) - {1, 2}):
            ids = np.array(list(prefixes[length].values()), np.int64)
            h = _hash_of(np.frombuffer(b"".join(prefixes[length]), np.uint8), np.arange(len(ids)) * length, length)
            order = np.argsort(h)
            self.tables.append((length, h[order], ids[order]))

    def marked(self, ids: np.ndarray) -> bytes:
        """The marked text whose encoding ``ids`` are."""
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        """The text whose encoding ``ids`` are."""
        text = self.marked(ids).replace(BLANK, b" ").decode("utf-8", "surrogatepass")
        return text[1:] if text.startswith(" ") else text


def _hash_of(buf: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hash of ``length`` bytes from each start."""
    up, down = powers(len(buf))
    prefix = np.zeros(len(buf) + 1, U)
    np.cumsum(mix(buf.astype(U) + U(BASE)) * up[: len(buf)], out=prefix[1:])
    return mix((prefix[starts + length] - prefix[starts]) * down[starts])


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform doubles in (0, 1) from hashes."""
    return ((mix(x) >> U(11)).astype(np.float64) + 0.5) / (1 << 53)


def _noise(key: np.ndarray, kind: int, sample: int, place) -> np.ndarray:
    """A hash for each (row key, kind, sample, place)."""
    return mix(key ^ U((kind * MIX_1 + sample * MIX_2) & MASK)) + np.asarray(place).astype(U) * U(BASE)


class Lattices:
    """The lattices of distinct chunks as one flat graph with exact transition probabilities.

    Nodes are the byte places of all chunks, one after another with an end node each; edges are sorted by node.
    """

    def __init__(self, vocabulary: Vocabulary, chunks: list[bytes]):
        buf = np.frombuffer(b"\xff".join(chunks) + b"\xff", np.uint8)  # no piece holds the byte 255
        sizes = np.array([len(c) for c in chunks], np.int64)
        self.root = np.cumsum(sizes + 1) - (sizes + 1)
        self.end = self.root + sizes
        n = len(buf)
        self.n = n
        up, down = powers(n)
        prefix = np.zeros(n + 1, U)
        np.cumsum(mix(buf.astype(U) + U(BASE)) * up[:n], out=prefix[1:])
        src, dst, ids = [], [], []
        start_of_char = np.flatnonzero(((buf & 0xC0) != 0x80) & (buf != 255))
        width = np.ones(n, np.int64)
        width[buf >= 0xC0] = 2
        width[buf >= 0xE0] = 3
        width[buf >= 0xF0] = 4
        width[buf == BLANK[0]] = 1
        covered = np.zeros(n, bool)
        s = start_of_char  # those from which the bytes so far are the start of some piece
        wide = buf.astype(np.int64)
        tables = [(1, wide, vocabulary.short[0]), (2, (wide[:-1] << 8) + wide[1:], vocabulary.short[1]), *vocabulary.tables]
        for length, hashes, numbers in tables:
            s = s[s + length < n]
            if length <= 2:
                number = numbers[hashes[s]]
                hit = number > -2
                s, number = s[hit], number[hit]
            else:
                h = mix((prefix[s + length] - prefix[s]) * down[s])
                at = np.searchsorted(hashes, h)
                at[at == len(hashes)] = 0
                hit = hashes[at] == h
                s, number = s[hit], numbers[at[hit]]
            if not len(s):
                break
            whole = number >= 0
            src.append(s[whole])
            dst.append(s[whole] + length)
            ids.append(number[whole])
            covered[s[whole & (width[s] == length)]] = True
        literal = np.zeros(n, bool)
        bare = start_of_char[~covered[start_of_char]]
        for k in range(4):
            inside = bare[width[bare] > k] + k
            literal[inside[inside < n]] = True
        literal &= buf != 255
        place = np.flatnonzero(literal)
        src.append(place)
        dst.append(place + 1)
        ids.append(vocabulary.byte_id[buf[place]])
        # edges of one length leave different places, so each length fills one more slot of its places
        degree = np.bincount(np.concatenate(src), minlength=n)
        self.first = np.concatenate(([0], np.cumsum(degree)))
        total, slot = int(self.first[-1]), self.first[:-1].copy()
        self.src, self.dst, self.ids = np.repeat(np.arange(n, dtype=np.int32), degree), np.empty(total, np.int32), np.empty(total, np.int32)
        for a, b, i in zip(src, dst, ids, strict=True):
            at = slot[a]
            self.dst[at], self.ids[at] = b, i
            slot[a] = at + 1
        self._split(sizes)
        # backward sums inside each unit, by distance to its end: all places at one distance at a time
        stops = np.flatnonzero(self.stop)
        stop_of = stops[np.searchsorted(stops, np.arange(n), "right").clip(max=len(stops) - 1)][self.src]
        to_end = stop_of - self.src
        inside = to_end <= LONG if vocabulary.in_range else np.zeros(total, bool)
        factor = vocabulary.factor[self.ids]
        mass = np.zeros(n)
        mass[self.end] = 1.0
        last = self.dst == stop_of
        rank = np.argsort(np.where(inside, to_end, LONG + 1).astype(np.int16), kind="stable")
        cuts = np.searchsorted(to_end[rank[: np.count_nonzero(inside)]], np.arange(1, LONG + 2))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            e = rank[a:b]
            value = factor[e] * np.where(last[e], 1.0, mass[self.dst[e]])
            node = self.src[e]
            new = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            mass[node[new]] = np.add.reduceat(value, new)
        with np.errstate(invalid="ignore", divide="ignore"):
            self.p = factor * np.where(last, 1.0, mass[self.dst]) / mass[self.src]
        self._in_logarithms(np.flatnonzero(~inside), vocabulary.weight[self.ids], last)
        self.p[np.isnan(self.p)] = 0.0
        #: cumulative probability inside a node; summed as whole numbers, whose differences are exact whatever else is in the batch
        running = np.cumsum(np.rint(self.p * 2.0**60).astype(np.int64))
        base = np.concatenate((np.zeros(1, np.int64), running))[self.first[self.src]]
        self.cumulative = np.minimum((running - base) * 2.0**-60, 1.0)

    def __add__(self, other: Lattices) -> Lattices:
        """Both lattices' chunks, ``other``'s after one's own."""
        both = object.__new__(Lattices)
        both.n = self.n + other.n
        for name in ("root", "end", "unit", "src", "dst"):
            setattr(both, name, np.concatenate((getattr(self, name), getattr(other, name) + self.n)))
        for name in ("units", "stop", "ids", "p", "cumulative"):
            setattr(both, name, np.concatenate((getattr(self, name), getattr(other, name))))
        both.first_unit = np.concatenate((self.first_unit, other.first_unit + len(self.unit)))
        both.first = np.concatenate((self.first[:-1], other.first + self.first[-1]))
        return both

    def _split(self, sizes: np.ndarray) -> None:
        """``stop``: the places where units end; ``unit``: their first places; ``first_unit`` and ``units`` of each chunk."""
        self.stop = np.zeros(self.n, bool)
        self.stop[self.end] = True
        long = np.flatnonzero(sizes > LONG)
        if len(long):
            change = np.bincount(self.src + 1, minlength=self.n + 1) - np.bincount(self.dst, minlength=self.n + 1)
            free = np.cumsum(change)[: self.n] == 0  # places that no edge crosses
            for c in long:
                self.stop[self.root[c] + 1 : self.end[c]] = free[self.root[c] + 1 : self.end[c]]
        begins = self.stop.copy()
        begins[self.end] = False
        begins[self.root] = True
        self.unit = np.flatnonzero(begins)
        self.first_unit = np.searchsorted(self.unit, self.root)
        self.units = np.diff(np.append(self.first_unit, len(self.unit)))

    def _in_logarithms(self, edges: np.ndarray, weight: np.ndarray, last: np.ndarray) -> None:
        """Transition probabilities of ``edges``, all those of some units from some place to the places before it."""
        if not len(edges):
            return
        total: dict[int, float] = {}
        near: dict[int, float] = {}
        whole = set(self.src[edges].tolist())

        def beta(node: int) -> float:
            if node in total or node in whole:
                return total.get(node, -math.inf)
            if node not in near:  # a place whose sum is a product of weights: take it from its own edges
                x = [weight[e] + (0.0 if last[e] else beta(int(self.dst[e]))) for e in range(self.first[node], self.first[node + 1])]
                near[node] = float(np.logaddexp.reduce(x)) if x else -math.inf
            return near[node]

        for e in edges[::-1].tolist():
            node = int(self.src[e])
            x, y = weight[e] + (0.0 if last[e] else beta(int(self.dst[e]))), total.get(node, -math.inf)
            top = max(x, y)
            total[node] = top if top == -math.inf else top + math.log(math.exp(x - top) + math.exp(y - top))
        for e in edges.tolist():
            x = weight[e] + (0.0 if last[e] else beta(int(self.dst[e])))
            self.p[e] = 0.0 if x == -math.inf else math.exp(x - total[int(self.src[e])])
        beta = None  # else the function refers to itself, and the arrays stay until cycles are collected

    def step(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge drawn at each node by a uniform number."""
        u = np.minimum(u, 1 - 1e-9)
        e, top = self.first[node], self.first[node + 1] - 1
        on = np.flatnonzero((self.cumulative[e] <= u) & (e < top))
        while len(on):  # a node has two edges in the mean
            e[on] += 1
            on = on[(self.cumulative[e[on]] <= u[on]) & (e[on] < top[on])]
        bad = self.p[e] == 0.0
        while bad.any():  # rounding led to an edge without mass
            e[bad] -= 1
            wrap = bad & (e < self.first[node])
            e[wrap] = self.first[node[wrap] + 1] - 1
            bad = self.p[e] == 0.0
        return e


def _chunks(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Marked texts, cut where a run of marks starts: the distinct chunks, the number of each chunk, and the chunks of each text."""
    raw = b"".join(texts)
    buf = np.frombuffer(raw, np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    mark = buf == BLANK[0]
    cut = mark.copy()
    cut[1:] &= ~mark[:-1]
    cut[begins[sizes > 0]] = True
    starts = np.flatnonzero(cut)
    offsets = np.append(starts, len(buf)).astype(np.int64)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
    counts = np.searchsorted(starts, begins + sizes) - np.searchsorted(starts, begins)
    return found.dictionary.to_pylist(), found.indices.to_numpy().astype(np.int64), counts


def _marked(text: str) -> bytes:
    """Text with a leading mark and marks for spaces."""
    return BLANK + text.encode("utf-8", "surrogatepass").replace(b" ", BLANK)


def _paths(lat: Lattices, chunk_node: np.ndarray, key: np.ndarray, sample: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Draw every unit from its node to its end: edges, and the unit that each belongs to, in order."""
    edges, owners = [], []
    live = np.arange(len(chunk_node))
    node = chunk_node.copy()
    step = 0
    while len(live):
        u = _unit(_noise(key[live], 1, sample, (place[live] << 32) + step))
        e = lat.step(node[live], u)
        edges.append(e)
        owners.append(live)
        node[live] = lat.dst[e]
        live = live[~lat.stop[node[live]]]
        step += 1
    if not edges:
        z = np.zeros(0, np.int64)
        return z, z
    edge, owner = np.concatenate(edges), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return edge[order], owner[order]


def _truncated(mass: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variates of log-mass ``mass``, given that they do not exceed ``top``."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        return np.where(np.isneginf(mass), -np.inf, mass - np.logaddexp(mass - top, np.log(-np.log(u))))


class Sampler:
    """Top-k segmentations of a batch of texts."""

    def __init__(self, vocabulary: Vocabulary, samples: int = SAMPLES, seed: int = SEED):
        self.vocabulary, self.k, self.seed = vocabulary, samples, seed
        self.known: dict[bytes, int] = {}
        self.base: Lattices | None = None

    def lattices(self, chunks: list[bytes], counts: np.ndarray) -> tuple[Lattices, np.ndarray]:
        """The lattices of distinct ``chunks``, and the number of each chunk in them.

        Chunks that are frequent in the first texts are kept, up to ``KEPT``, and need not be built again.
        """
        number = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))
        new = np.flatnonzero(number < 0)
        if len(self.known) < KEPT:
            often = new[counts[new] > 1][: KEPT - len(self.known)]
            if len(often):
                self.known.update(zip([chunks[i] for i in often], range(len(self.known), len(self.known) + len(often)), strict=True))
                more = Lattices(self.vocabulary, [chunks[i] for i in often])
                self.base = more if self.base is None else self.base + more
                number[often] = np.arange(len(self.known) - len(often), len(self.known))
                new = np.flatnonzero(number < 0)
        number[new] = len(self.known) + np.arange(len(new))
        if self.base is None:
            return Lattices(self.vocabulary, chunks), number
        return (self.base + Lattices(self.vocabulary, [chunks[i] for i in new]) if len(new) else self.base), number

    def sample(self, texts: list[bytes], keys: np.ndarray) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """For each marked text: up to k of (ids, log-probability, key, inclusion), largest key first."""
        chunks, flat, chunk_counts = _chunks(texts)
        lat, number = self.lattices(chunks, np.bincount(flat, minlength=len(chunks)))
        flat = number[flat]
        chunk_stops = np.concatenate(([0], np.cumsum(chunk_counts)))
        units = lat.units[flat]
        unit_stops = np.concatenate(([0], np.cumsum(units)))
        flat = np.repeat(lat.first_unit[flat] - unit_stops[:-1], units) + np.arange(unit_stops[-1])
        counts = np.diff(unit_stops[chunk_stops])
        ends = np.cumsum(counts)
        begins = ends - counts
        text_of = np.repeat(np.arange(len(texts)), counts)
        place = np.arange(len(flat)) - begins[text_of]
        key = mix(keys.astype(np.int64).view(U) ^ U(mix(np.array([self.seed], U))[0]))
        nodes = lat.unit[flat]
        n_texts = len(texts)
        top = -np.log(-np.log(_unit(_noise(key, 2, 0, np.zeros(n_texts, np.int64)))))
        # a queue for each text: (key, sample it left, step on that path, edges excluded there, log-mass)
        queues: list[list[tuple]] = [[] for _ in texts]
        found: list[list[tuple]] = [[] for _ in texts]
        paths: list[list[np.ndarray]] = [[] for _ in texts]
        prefix_kept: list[np.ndarray] = [np.zeros(0, np.int64) for _ in texts]
        excluded: list[tuple] = [() for _ in texts]
        start_place = np.zeros(n_texts, np.int64)
        start_node = np.full(n_texts, -1, np.int64)
        alive = np.arange(n_texts)
        threshold = np.full(n_texts, -np.inf)
        sizes = np.diff(np.append(lat.first, len(lat.src)))
        for sample in range(self.k):
            # draw the rest of each live text's path: from a node inside one unit, then all later units
            take = np.concatenate([np.arange(begins[t] + start_place[t], ends[t]) for t in alive]) if len(alive) else np.zeros(0, np.int64)
            where = nodes[take].copy()
            for_text = text_of[take]
            first_of = np.searchsorted(for_text, alive) if len(take) else np.zeros(0, np.int64)
            for i, t in enumerate(alive):
                if start_node[t] >= 0:
                    where[first_of[i]] = start_node[t]
            edge, owner = _paths(lat, where, key[for_text], sample, place[take]) if len(take) else (np.zeros(0, np.int64),) * 2
            edge_text = for_text[owner]
            cuts = np.searchsorted(edge_text, alive), np.searchsorted(edge_text, alive, "right")
            whole = []
            for i, t in enumerate(alive):
                path = edge[cuts[0][i] : cuts[1][i]]
                if len(prefix_kept[t]):
                    path = np.concatenate((prefix_kept[t], path))
                whole.append(path)
                paths[t].append(path)
            # all paths in a row: log-probability before each step, and the sets that leave the path there
            kept = np.array([len(prefix_kept[t]) for t in alive], np.int64)
            lengths = np.array([len(x) for x in whole], np.int64)
            flat_path = np.concatenate(whole) if whole else np.zeros(0, np.int64)
            starts = np.cumsum(lengths) - lengths
            nth_text = np.repeat(np.arange(len(alive)), lengths)
            at = np.arange(len(flat_path)) - starts[nth_text]
            p = lat.p[flat_path]
            lp = np.log(p)
            sums = [np.concatenate(([0.0], np.cumsum(lp[a : a + n]))) for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
            before = np.concatenate([x[:-1] for x in sums]) if sums else np.zeros(0)
            with np.errstate(divide="ignore"):
                rest = before + np.log1p(-np.minimum(p, 1.0))
            rest[(sizes[lat.src[flat_path]] < 2) | (at < kept[nth_text] - 1)] = -np.inf
            gone: dict[int, tuple] = {}
            for i in np.flatnonzero(kept):
                t, e = alive[i], starts[i] + kept[i] - 1
                gone[i] = (*excluded[t], int(flat_path[e]))
                rest[e] = before[e] + self._rest(lat, int(lat.src[flat_path[e]]), gone[i])
            g = _truncated(rest, top[alive][nth_text], _unit(_noise(key[alive][nth_text], 3, sample, at)))
            for i, t in enumerate(alive):
                found[t].append((whole[i], float(sums[i][-1]), float(top[t])))
            some = np.flatnonzero(lengths)
            for _ in range(self.k - sample + 1):  # more of a path's sets can neither win nor be the threshold
                if not len(some):
                    break
                best = np.maximum.reduceat(g, starts[some])
                level = np.full(len(alive), np.nan)
                level[some] = best
                hit = np.flatnonzero(g == level[nth_text])
                who, first = np.unique(nth_text[hit], return_index=True)
                for i, e in zip(who.tolist(), hit[first].tolist(), strict=True):
                    if g[e] == -np.inf:
                        continue
                    step = e - int(starts[i])
                    out = gone[i] if i in gone and step == kept[i] - 1 else (int(flat_path[e]),)
                    queues[alive[i]].append((float(g[e]), sample, step, out))
                g[hit[first]] = -np.inf
            done = []
            for t in alive:
                queue = queues[t]
                queue.sort(key=lambda x: -x[0])
                threshold[t] = queue[0][0] if queue else -np.inf
                if not queue or sample + 1 == self.k:
                    continue
                score, from_sample, step, out = queue.pop(0)
                base = paths[t][from_sample]
                node = int(lat.src[base[step]])
                u = float(_unit(_noise(key[t : t + 1], 4, sample, np.zeros(1, np.int64)))[0])
                e = self._other(lat, node, out, u)
                top[t], excluded[t] = score, out
                prefix_kept[t] = np.append(base[:step], e)
                nth = int(np.count_nonzero(lat.stop[lat.dst[base[:step]]]))
                if lat.stop[lat.dst[e]]:
                    start_place[t], start_node[t] = nth + 1, -1
                else:
                    start_place[t], start_node[t] = nth, lat.dst[e]
                done.append(t)
            alive = np.array(done, np.int64)
        out = []
        for t in range(n_texts):
            rows = []
            for path, log_p, score in found[t]:
                include = 1.0 if np.isneginf(threshold[t]) else -np.expm1(-np.exp(min(log_p - threshold[t], 50.0)))
                rows.append((lat.ids[path], log_p, score, float(include)))
            out.append(rows)
        return out

    @staticmethod
    def _rest(lat: Lattices, node: int, gone: tuple) -> float:
        """Log-mass of a node's edges without those in ``gone``."""
        rest = sum(float(lat.p[e]) for e in range(lat.first[node], lat.first[node + 1]) if e not in gone)
        return math.log(rest) if rest > 0 else -math.inf

    @staticmethod
    def _other(lat: Lattices, node: int, gone: tuple, u: float) -> int:
        """An edge of ``node`` outside ``gone``, by its share of the remaining mass."""
        left = [e for e in range(lat.first[node], lat.first[node + 1]) if e not in gone and lat.p[e] > 0]
        p = lat.p[left]
        return left[min(int(np.searchsorted(np.cumsum(p) / p.sum(), u, "right")), len(left) - 1)]


_vocabularies: dict[tuple[str, float], Vocabulary] = {}


def encode(docs: DataFrame, model: str, samples: int = SAMPLES, seed: int = SEED, alpha: float = ALPHA) -> DataFrame:
    """Rows (doc_id, sample, ids, ids_crc32, log_prob, score, inclusion, round_trip) for each row of ``docs`` (``doc_id``, ``text``).

    ``ids_crc32`` is of the ids' little-endian 32-bit form; ``round_trip`` tells whether decoding the ids gave the text back.
    """

    def run(frames):
        if (model, alpha) not in _vocabularies:
            _vocabularies[model, alpha] = Vocabulary(model, alpha)
        vocabulary = _vocabularies[model, alpha]
        sampler = Sampler(vocabulary, samples, seed)
        for batch in frames:
            rows = max(1, PIECE_BYTES * batch.num_rows // max(1, batch.nbytes))
            for a in range(0, batch.num_rows, rows):
                piece = batch.slice(a, rows)
                doc_ids = piece.column("doc_id").to_pylist()
                texts = ["" if t is None else t for t in piece.column("text").to_pylist()]
                keys = np.array([-1 if k is None else k for k in doc_ids], np.int64)
                marked = [_marked(t) if t else b"" for t in texts]
                found = sampler.sample(marked, keys)
                out = [
                    (doc, i, ids.astype("<i4"), zlib.crc32(ids.astype("<i4").tobytes()), log_p, score, include, vocabulary.marked(ids) == text)
                    for doc, text, some in zip(doc_ids, marked, found, strict=True)
                    for i, (ids, log_p, score, include) in enumerate(some, 1)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], names)

    names = ["doc_id", "sample", "ids", "ids_crc32", "log_prob", "score", "inclusion", "round_trip"]
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
    schema = "doc_id long, sample int, ids array<int>, ids_crc32 long, log_prob double, score double, inclusion double, round_trip boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def with_digest(found: DataFrame) -> DataFrame:
    """``found`` with n_tokens beside ``ids`` and ``ids_crc32``."""
    return found.select("doc_id", "sample", "ids", F.size("ids").cast("long").alias("n_tokens"), "ids_crc32", "log_prob", "score", "inclusion", "round_trip")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` (any columns and ``ids``) with ``text``: the pieces put together again."""

    def run(columns):
        if (model, ALPHA) not in _vocabularies:
            _vocabularies[model, ALPHA] = Vocabulary(model)
        vocabulary = _vocabularies[model, ALPHA]
        return columns.map(lambda ids: None if ids is None else vocabulary.decode(np.asarray(ids)))

    @F.pandas_udf("string")
    def text_of(ids: pd.Series) -> pd.Series:
        return run(ids)

    return encoded.withColumn("text", text_of("ids"))


def model_path(model: str | None = None) -> str:
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    return model


def op2_sentencepiece_sampling(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_digest(encode(docs, model_path(model)))
