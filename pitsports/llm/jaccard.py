"""N-gram Jaccard self-join by PartEnum signatures, and its connected components.

A document's set holds its distinct shingles of ``width`` words, four by default (A-Z lower-cased); a text with fewer words
has its whole sequence as one shingle; a text without words has the empty set and no links. Two documents link if
``den * |A & B| >= num * |A | B|``, by default from a similarity of 85 / 100.

*Exact copies.* Documents with the same set form one class; only classes are joined.

*Signatures.* Sizes are cut into bands. Two sets that link and whose larger one lies in a band differ in at most ``k``
shingles, ``k`` fixed by the band. A set takes part in its own band, and in the next one if its size can link there.
For each band the domain of shingles is split by hash into ``n1`` partitions and each of those into ``n2``; with
``k2 = ceil((k + 1) / n1) - 1``, some first-level partition holds at most ``k2`` of the differences, so the two sets agree
on all of at least ``n2 - k2`` of its parts. The signatures are the hashes of a set's content on every such choice of
parts: linked sets share one. Small bands enumerate subsets (``k2 > 0``), large ones use many partitions (``k2 = 0``).

*Rarest signatures.* A large band has ``spare`` partitions more than needed, a quarter as many again. Linked sets then
share at least ``spare + 1`` signatures, so each set may leave out its ``spare`` most frequent ones, in one order for
all sets: the rarest of the shared ones is never left out. So a passage that many dissimilar texts share gives no
signature, and a set that shares no more than ``spare`` signatures with any other set gives none at all. The order is:
empty partitions, then *hot* signatures (those frequent in a bounded sample of the sets, known to every task), then the
others by the number of sets that have them, counted under one shuffle; signatures of one set only fall away there.
Hot ones need no count, so no task gets the rows of a frequent signature.

*Candidates without all pairs.* Under each signature the sets form a star around the smallest one (hot signatures first
inside each map task): as many candidate pairs as members less one. Each set's likeliest pair is verified first;
components are formed; the other star pairs that cross components follow; components again. Signatures all of whose
members are then in one component are finished. The few others are *open*: their members are compared across components
by bit sketches whose distance never exceeds the sets' own difference (size-sorted, in blocks, inside tasks), and only
what passes is verified: first the closest pairs of each two components, then, where these did not join them, all. So no
link between components is missed, and none is assumed.

*Verification* counts common shingles of the two sets exactly (64-bit hashes).

Edge cases: null texts are empty; rows are joined by a row key, each by its own text, so equal and null ids are rows like
others; the component of rows that all have null ids is null; ties go to the smallest id; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitsports.llm.common import BASE, MIX_1, MIX_2, U, batches, distinct_per_owner, mix, settle, shingle_hashes, unpacked, with_row_key, word_hashes



@dataclass(frozen=True)
class Rule:
    """Words of a shingle, and the similarity ``num / den`` from which two sets link."""

    width: int = 4
    num: int = 85
    den: int = 100

    def allowed(self, total: int) -> int:
        """Largest number of differing shingles of two linked sets whose sizes sum to ``total``."""
        return total * (self.den - self.num) // (self.den + self.num)


#: Ratio of a band's sizes, spare partitions for each needed one, largest number of signatures of a small band, bits of a sketch.
RATIO, SPARE, SMALL, BITS = 1.5, 0.25, 24, 512
#: Distinct sets (about) whose signatures are counted to find hot ones, the count that makes one hot, and how many are kept.
SAMPLE, HOT, MOST_HOT = 8_000, 8, 200_000
#: Kinds of rows between the shuffles of signatures.
MEMBER, PAIR, BUDGET, HUB = 0, 1, 2, 3
#: Members of an open signature that one task compares at a time.
BLOCK = 1024
#: Pairs of two components that are verified first: if they link, the components' other pairs need no look.
CLOSEST = 2


def bands(largest: int) -> list[int]:
    """Lower ends of the size bands up to ``largest``, and one more."""
    ends = [1]
    while ends[-1] <= largest:
        ends.append(max(ends[-1] + 1, int(ends[-1] * RATIO)))
    return ends


def plan(rule: Rule, low: int, high: int) -> tuple[int, int, int, int]:
    """(n1, n2, k2, spare) for the band of sizes ``low`` to ``high``: the most shingles in a signature for a bounded number of them."""
    k = rule.allowed(2 * high)
    if k == 0:
        return 1, 1, 0, 0
    spare = max(2, int(np.ceil(SPARE * (k + 1))))
    best = (k + 1 + spare, 1, 0, spare)
    most = low / (k + 1)
    for n1 in range(1, k + 2):
        k2 = -(-(k + 1) // n1) - 1
        for n2 in range(k2 + 1, k2 + 4):
            if k2 and n1 * comb(n2, k2) <= SMALL and low * (n2 - k2) / (n1 * n2) > most:
                best, most = (n1, n2, k2, 0), low * (n2 - k2) / (n1 * n2)
    return best


def _sums(h: np.ndarray, slot: np.ndarray, slots: int) -> np.ndarray:
    """Sum of 64-bit hashes in each slot, modulo 2**64 (exact: each half is summed in doubles below 2**53)."""
    low = np.bincount(slot, (h & U(0xFFFFFFFF)).astype(np.float64), slots).astype(np.uint64)
    high = np.bincount(slot, (h >> U(32)).astype(np.float64), slots).astype(np.uint64)
    return low + (high << U(32))


def _sets(rule: Rule, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes ordered by text, their texts, and the size of every text's set."""
    h, owner = distinct_per_owner(*shingle_hashes(*word_hashes(texts), rule.width, True))
    return h, owner, np.bincount(owner, minlength=len(texts))


def _node(h: np.ndarray, owner: np.ndarray, n: int, salt: int) -> np.ndarray:
    return mix(_sums(mix(h ^ U(salt)), owner, n))


def bits_for(size: np.ndarray) -> np.ndarray:
    """Bits of a set's sketch: the power of two from its size on, at least ``BITS``."""
    return np.maximum(BITS, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))


def _sketches(h: np.ndarray, owner: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Parity of the number of shingles at each of a set's bits. Two halves xor-ed give the sketch of half the bits."""
    bits = bits_for(size)
    base = np.cumsum(bits) - bits
    place = base[owner] + (mix(h ^ U(MIX_2)) & (bits - 1).astype(U)[owner]).astype(np.int64)
    packed = np.packbits((np.bincount(place, minlength=int(bits.sum())) & 1).astype(bool))
    return [packed[a : a + n].tobytes() for a, n in zip(base // 8, bits // 8, strict=True)]


def _folded(words: np.ndarray, width: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) brought to ``width`` words."""
    while words.shape[-1] > width:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def _describe(rule: Rule, frames):
    """A row for each document: size, two hashes of the set, and its parity sketch."""
    for pdf in batches(frames):
        h, owner, size = _sets(rule, pdf["text"].tolist())
        yield pd.DataFrame(
            {
                "doc": pdf["doc"],
                "id": pdf["id"],
                "size": size,
                "node": _node(h, owner, len(pdf), MIX_1).view(np.int64),
                "check": _node(h, owner, len(pdf), BASE).view(np.int64),
                "sketch": _sketches(h, owner, size),
            }
        )


def _signatures(rule: Rule, h: np.ndarray, owner: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All signatures of the sets (``owner`` numbers them, ``size`` counts them), the set that each belongs to, and how many
    more each set may leave out in its bands of even and of odd number (a signature's lowest bit tells which)."""
    ends = bands(int(size.max(initial=0)))
    starts = np.cumsum(size) - size
    own_band = np.searchsorted(ends, size, "right") - 1
    sigs, sets = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    left = np.zeros((len(size), 2), np.int64)
    for j in range(len(ends)):
        low = ends[j]
        high = (ends[j + 1] if j + 1 < len(ends) else max(low + 1, int(low * RATIO))) - 1
        smallest = -(-low * rule.num // rule.den)
        take = np.flatnonzero((size > 0) & ((own_band == j) | ((own_band < j) & (size >= smallest))))
        if not len(take):
            continue
        n1, n2, k2, spare = plan(rule, smallest, high)
        k = size[take]
        at = np.repeat(starts[take] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        number = np.repeat(np.arange(len(take)), k)
        p = mix(h[at] ^ U(BASE))
        first = ((p >> U(32)) * U(n1) >> U(32)).astype(np.int64)
        second = ((p & U(0xFFFFFFFF)) * U(n2) >> U(32)).astype(np.int64)
        slot = (number * n1 + first) * n2 + second
        slots = len(take) * n1 * n2
        total = _sums(mix(h[at] ^ U(MIX_2)), slot, slots).reshape(len(take), n1, n2)
        for c, chosen in enumerate(combinations(range(n2), n2 - k2)):
            content = mix(total[:, :, chosen].sum(2, dtype=U))
            label = mix(np.arange(n1, dtype=U) * U(MIX_2) + U(((j + 1) * MIX_1 + c * BASE) & 0xFFFFFFFFFFFFFFFF))
            sig = mix(content ^ label) & ~U(1) | U(j & 1)
            keep = np.ones_like(sig, bool)
            if spare:  # empty partitions are the most frequent signatures: the first to be left out
                empty = np.bincount(slot, minlength=slots).reshape(len(take), n1) == 0
                keep = ~empty | (empty.cumsum(1) > spare)
                left[take, j & 1] = spare - np.minimum(empty.sum(1), spare)
            sigs.append(sig[keep])
            sets.append(np.broadcast_to(take[:, None], sig.shape)[keep])
    sig, own = np.concatenate(sigs), np.concatenate(sets)
    order = np.argsort(own, kind="stable")
    return sig[order], own[order], left


def signatures(rule: Rule, h: np.ndarray, owner: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of the sets, and the set that each belongs to."""
    return _signatures(rule, h, owner, size)[:2]


def _of_batch(rule: Rule, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of a batch's distinct sets, the node of each set, and what each may leave out."""
    h, owner, count = _sets(rule, pdf["text"].tolist())
    node = _node(h, owner, len(pdf), MIX_1).view(np.int64)
    _, once = np.unique(node, return_index=True)
    keep = np.zeros(len(pdf), bool)
    keep[once] = True
    sig, own, left = _signatures(rule, h[keep[owner]], owner[keep[owner]], np.where(keep, count, 0))
    return sig, own, left, node


def _position(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by ``keys`` (the first one last), and each ordered row's place among rows equal in all keys but the last two."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys[:-2]]) if len(order) else True
    at = np.arange(len(order))
    return order, at - np.maximum.accumulate(np.where(new, at, 0)) if len(order) else at


def _stars(sig: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows are their signature's smallest node; and for the others that node (rows with a known node are left out)."""
    order = np.lexsort((a, sig))
    s, n = sig[order], a[order]
    new = np.ones(len(order), bool)
    new[1:] = s[1:] != s[:-1]
    hub = n[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(n) else n
    other = ~new & (n != hub)
    other[1:] &= (n[1:] != n[:-1]) | (s[1:] != s[:-1])
    is_hub = np.zeros(len(order), bool)
    is_hub[order[new]] = True
    return is_hub, order[other], hub[other]


def _rows_of(kind: int, sig, a, b) -> pd.DataFrame:
    return pd.DataFrame({"kind": np.full(len(a), kind, np.int32), "sig": np.asarray(sig).view(np.int64), "a": a, "b": b})


def _sampled(rule: Rule, frames):
    for pdf in batches(frames):
        yield pd.DataFrame({"sig": _of_batch(rule, pdf)[0].view(np.int64)})


def _map_side(rule: Rule, hot, frames):
    """Rows (kind, sig, a, b): members of signatures that are not hot, what each set may still leave out (``b``), and of the
    hot signatures that a set keeps the stars inside the task: hubs (b = a) and pairs."""
    known, rank = hot.value
    held, size = [], 0

    def settle_held():
        sig, a = (np.concatenate(x) for x in zip(*held, strict=True))
        is_hub, other, hub = _stars(sig, a)
        yield _rows_of(HUB, sig[is_hub], a[is_hub], a[is_hub])
        yield _rows_of(PAIR, sig[other], hub, a[other])

    for pdf in batches(frames):
        sig, own, left, node = _of_batch(rule, pdf)
        at = np.searchsorted(known, sig)
        at[at == len(known)] = 0
        is_hot = known[at] == sig if len(known) else np.zeros(len(sig), bool)
        warm = np.flatnonzero(is_hot)
        odd = (sig[warm] & U(1)).astype(np.int64)
        order, place = _position(own[warm], odd, rank[at[warm]], sig[warm])
        warm, odd = warm[order], odd[order]
        out = place < left[own[warm], odd]
        np.subtract.at(left, (own[warm[out]], odd[out]), 1)
        kept = warm[~out]
        if len(kept):
            held.append((sig[kept], node[own[kept]]))
            size += len(kept)
        yield _rows_of(MEMBER, sig[~is_hot], node[own[~is_hot]], np.zeros(np.count_nonzero(~is_hot), np.int64))
        for odd in (0, 1):
            some = np.flatnonzero(left[:, odd])
            yield _rows_of(BUDGET, np.full(len(some), odd, np.int64), node[some], left[some, odd])
        if size > 1_000_000:
            yield from settle_held()
            held, size = [], 0
    if held:
        yield from settle_held()


def _whole(frames, column: str):
    """Cut a stream that is sorted by ``column`` into pieces that hold whole groups."""
    rest = None
    for pdf in frames:
        if rest is not None:
            pdf = pd.concat((rest, pdf), ignore_index=True)
        x = pdf[column].to_numpy()
        edge = np.searchsorted(x, x[-1]) if len(x) else 0
        rest = pdf.iloc[edge:]
        if edge:
            yield pdf.iloc[:edge]
    if rest is not None and len(rest):
        yield rest


def _by_frequency(frames):
    """Members with the number of sets under their signature (``b``), where there are two at least; other kinds pass."""
    for pdf in _whole(frames, "sig"):
        kind = pdf["kind"].to_numpy()
        if (kind != MEMBER).any():
            yield pdf[kind != MEMBER]
        sig, a = (pdf[c].to_numpy()[kind == MEMBER] for c in ("sig", "a"))
        order = np.lexsort((a, sig))
        sig, a = sig[order], a[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (a[1:] != a[:-1])
        sig, a = sig[new], a[new]
        _, group, n = np.unique(sig, return_inverse=True, return_counts=True)
        shared = n[group] > 1
        yield _rows_of(MEMBER, sig[shared], a[shared], n[group][shared])


def _by_node(frames):
    """Each set leaves out its most frequent signatures; what it keeps are members (b = a). Hubs become members, pairs pass."""
    for pdf in _whole(frames, "a"):
        kind, sig, a, b = (pdf[c].to_numpy() for c in ("kind", "sig", "a", "b"))
        yield _rows_of(PAIR, sig[kind == PAIR], a[kind == PAIR], b[kind == PAIR])
        yield _rows_of(MEMBER, sig[kind == HUB], a[kind == HUB], a[kind == HUB])
        nodes, number = np.unique(a, return_inverse=True)
        left = np.zeros((len(nodes), 2), np.int64)
        budget = kind == BUDGET
        left[number[budget], sig[budget]] = b[budget]
        member = kind == MEMBER
        sig, number, n = sig[member], number[member], b[member]
        odd = sig & 1
        order, place = _position(number, odd, -n, sig)
        keep = order[place >= left[number[order], odd[order]]]
        yield _rows_of(MEMBER, sig[keep], nodes[number[keep]], nodes[number[keep]])


def _by_signature(frames):
    """Star pairs (sig, a, b) under each signature; pairs from map tasks pass through."""
    for pdf in _whole(frames, "sig"):
        kind = pdf["kind"].to_numpy()
        if (kind == PAIR).any():
            yield pdf.loc[kind == PAIR, ["sig", "a", "b"]]
        sig, a = (pdf[c].to_numpy()[kind == MEMBER] for c in ("sig", "a"))
        _, other, hub = _stars(sig, a)
        yield pd.DataFrame({"sig": sig[other], "a": hub, "b": a[other]})


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node of ``links`` (a, b): the smallest node that it reaches.

    Rounds of two steps, each a join and an aggregation: every node takes the smallest label around it, then the label
    of its label. Every round is written to the shared folder. Long chains shrink by the second step, so the rounds grow
    with the logarithm of a component's diameter.
    """
    edges = settle(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settle(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("comp")).select(F.col("a").alias("node"), "comp"))
    while True:
        around = edges.join(labels, edges["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        nearer = labels.join(around, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
        after = settle(nearer.join(up, "comp").select("node", "was", F.least("comp", "above").alias("comp")))
        labels = after.select("node", "comp")
        if not after.where("was <> comp").limit(1).count():
            return labels


def _compare(rule: Rule, closest: int, frames):
    """Pairs across components that sketches allow, in each run of rows with equal (sig, i, j), ordered by size.

    With ``closest`` above 0, only so many pairs of each two components, those of smallest sketch distance.
    """

    def pairs(size, comp, own, node, sketch, twice):
        width = np.array([len(x) // 8 for x in sketch])
        for w in np.unique(width):  # sets of one width among themselves and with the next larger ones
            first, last = np.searchsorted(width, w), np.searchsorted(width, w, "right")
            reach = np.searchsorted(size, size[last - 1] * rule.den // rule.num, "right")
            words = np.stack([_folded(np.frombuffer(x, U), w) for x in sketch[first:reach]])
            stops = np.searchsorted(size, size[first:last] * rule.den // rule.num, "right")
            for i, stop in zip(range(first, last), stops, strict=True):
                near = comp[i + 1 : stop] != comp[i]
                if twice:
                    near &= own[i + 1 : stop] != own[i]
                at = np.flatnonzero(near) + i + 1
                if len(at):
                    apart = np.bitwise_count(words[at - first] ^ words[i - first]).sum(1)
                    keep = apart <= rule.allowed(size[at] + size[i])
                    hit, other, apart = node[at[keep]], comp[at[keep]], apart[keep].astype(np.int64)
                    ends = np.minimum(hit, node[i]), np.maximum(hit, node[i]), np.minimum(other, comp[i]), np.maximum(other, comp[i])
                    yield np.column_stack((*ends, apart))

    def work(pdf):
        key = pdf[["sig", "i", "j"]].to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(pdf)]))
        size, comp, own, node, sketch = (pdf[c].to_numpy() for c in ("size", "comp", "own", "node", "sketch"))
        out = [np.zeros((0, 5), np.int64)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            found = list(pairs(size[a:b], comp[a:b], own[a:b], node[a:b], sketch[a:b], key[a, 1] != key[a, 2]))
            if found and closest:
                x = np.concatenate(found)
                x = x[np.lexsort((x[:, 1], x[:, 0], x[:, 4], x[:, 3], x[:, 2]))]
                new = np.ones(len(x), bool)
                new[1:] = (x[1:, 2] != x[:-1, 2]) | (x[1:, 3] != x[:-1, 3])
                first = np.flatnonzero(new)
                found = [x[np.arange(len(x)) - first[np.cumsum(new) - 1] < closest]]
            out.extend(found)
        return pd.DataFrame(np.concatenate(out)[:, :2], columns=["a", "b"])

    rest = None
    for pdf in frames:
        pdf = pdf if rest is None else pd.concat((rest, pdf), ignore_index=True)
        last = (pdf[["sig", "i", "j"]] == pdf[["sig", "i", "j"]].iloc[-1]).all(axis=1).to_numpy() if len(pdf) else np.zeros(0, bool)
        rest = pdf[last].reset_index(drop=True)
        if not last.all():
            yield work(pdf[~last])
    if rest is not None and len(rest):
        yield work(rest)


class Join:
    """One self-join of ``docs`` (``doc``, a row key; ``id``, a long or null; ``text``): nodes, star pairs, verification and components."""

    def __init__(self, docs: DataFrame, rule: Rule = Rule()):  # noqa: B008
        self.docs, self.rule = docs, rule
        rows = docs.withColumn("id", F.col("id").cast("string"))  # pandas would make floats of longs with nulls
        nodes = rows.mapInPandas(partial(_describe, rule), "doc long, id string, size long, node long, check long, sketch binary")
        self.nodes = settle(nodes.withColumn("id", F.col("id").cast("long")).withColumn("own", F.struct(F.col("id").isNull().alias("none"), "id", "doc")).drop("id", "doc"))
        classes = self.nodes.where("size > 0").groupBy("node", "check", "size")
        self.classes = settle(classes.agg(F.min("own").alias("own"), F.first("sketch").alias("sketch")))

    def hot(self):
        """A broadcast of the signatures that are frequent in a sample of the sets (at most ``MOST_HOT``), sorted, and their ranks."""
        spark = self.docs.sparkSession
        steps = 1 << 20
        share = min(1.0, SAMPLE / max(1, self.classes.count()))
        few = self.classes.where(F.pmod(F.xxhash64("node"), F.lit(steps)) < int(share * steps)).select("own.doc")
        sampled = self.docs.join(F.broadcast(few), "doc", "left_semi").mapInPandas(partial(_sampled, self.rule), "sig long")
        found = sampled.groupBy("sig").agg(F.count("*").alias("n")).where(F.col("n") >= HOT).orderBy(F.desc("n"), "sig").limit(MOST_HOT).toPandas()
        known = found["sig"].to_numpy(np.int64).view(U)
        order = np.argsort(known)
        return spark.sparkContext.broadcast((known[order], order))

    def stars(self) -> DataFrame:
        schema = "kind int, sig long, a long, b long"
        rows = self.docs.where("text is not null").mapInPandas(partial(_map_side, self.rule, self.hot()), schema)
        by_sig = rows.repartition(F.when(F.col("kind") == MEMBER, F.col("sig")).otherwise(F.xxhash64("a", "b"))).sortWithinPartitions("sig")
        counted = by_sig.mapInPandas(_by_frequency, schema)
        by_node = counted.repartition(F.when(F.col("kind").isin(MEMBER, BUDGET), F.col("a")).otherwise(F.xxhash64("b", "sig"))).sortWithinPartitions("a")
        kept = by_node.mapInPandas(_by_node, schema)
        dealt = kept.repartition(F.when(F.col("kind") == MEMBER, F.col("sig")).otherwise(F.xxhash64("b"))).sortWithinPartitions("sig")
        return settle(dealt.mapInPandas(_by_signature, "sig long, a long, b long"))

    def possible(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) whose sizes and sketches allow a link."""
        rule = self.rule
        c = self.classes.select("node", "size", "sketch")
        both = pairs.join(c.toDF("a", "na", "sa"), "a").join(c.toDF("b", "nb", "sb"), "b")
        both = both.where(F.least("na", "nb") * rule.den >= F.greatest("na", "nb") * rule.num)

        def run(frames):
            for pdf in frames:
                keep = np.zeros(len(pdf), bool)
                for i, (x, y, n) in enumerate(zip(pdf["sa"], pdf["sb"], pdf["na"] + pdf["nb"], strict=True)):
                    x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                    w = min(len(x), len(y))
                    keep[i] = np.bitwise_count(_folded(x, w) ^ _folded(y, w)).sum() <= rule.allowed(int(n))
                yield pdf.loc[keep, ["a", "b"]]

        return both.select("a", "b", "na", "nb", "sa", "sb").mapInPandas(run, "a long, b long")

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, size, shingles) of the given nodes, read from one document of each class."""

        rule = self.rule

        def run(frames):
            for pdf in batches(frames):
                h, owner, size = _sets(rule, pdf["text"].tolist())
                own = _node(h, owner, len(pdf), MIX_1).view(np.int64) == pdf["node"].to_numpy()  # else a text of an equal id
                cut = np.split(h, np.cumsum(size)[:-1])
                yield pd.DataFrame({"node": pdf["node"], "set": [x.tobytes() for x in cut]})[own]

        wanted = self.classes.join(nodes, "node", "left_semi").select("own.doc", "node").hint("merge")  # grows with the corpus
        return self.docs.join(wanted, "doc").select("node", "text").mapInPandas(run, "node long, set binary")

    def sets_of_pairs(self, pairs: DataFrame) -> DataFrame:
        return settle(self.sets(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()))

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) that link, by the common shingles of their ``sets``."""
        rule = self.rule

        def run(frames):
            for pdf in frames:
                keep = np.zeros(len(pdf), bool)
                for i, (x, y) in enumerate(zip(pdf["x"], pdf["y"], strict=True)):
                    x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = rule.den * common >= rule.num * (len(x) + len(y) - common)
                yield pdf.loc[keep, ["a", "b"]]

        both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
        return settle(both.mapInPandas(run, "a long, b long"))

    def across(self, pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """Those of ``pairs`` whose ends are not yet in one component."""
        left = labels.toDF("a", "ca")
        right = labels.toDF("b", "cb")
        both = pairs.join(left, "a", "left").join(right, "b", "left")
        return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(*pairs.columns)

    def open_pairs(self, stars: DataFrame, labels: DataFrame, closest: int = 0) -> DataFrame:
        """Possible pairs across components under signatures whose members are in several components (see ``_compare``)."""
        members = stars.select("sig", F.col("a").alias("node")).unionByName(stars.select("sig", F.col("b").alias("node"))).distinct()
        members = members.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        opened = members.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who")).where("lo <> hi and m > 2")
        opened = settle(opened.groupBy("who", "m").agg(F.min("sig").alias("sig")))  # signatures with the same members count once
        rows = members.join(opened.select("sig", "m"), "sig").join(self.classes.select("node", "size", "sketch"), "node")
        blocks = F.ceil(F.col("m") / BLOCK).cast("int")
        own = F.pmod(F.xxhash64("node"), blocks).cast("int")
        rows = rows.withColumn("blocks", blocks).withColumn("own", own)
        dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            "sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "comp", "size", "sketch"
        )

        rows = dealt.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "size", "node")
        return rows.mapInPandas(partial(_compare, self.rule, closest), "a long, b long").distinct()

    def labels(self) -> DataFrame:
        """(node, comp) of every class that has a link."""
        stars = self.stars()
        counted = stars.groupBy("a", "b").agg(F.count("*").alias("n"))
        pairs = settle(self.possible(counted).join(counted, ["a", "b"]))
        likeliest = pairs.groupBy("b").agg(F.min_by("a", F.struct(-F.col("n"), F.col("a"))).alias("a")).select("a", "b")
        sets = self.sets_of_pairs(pairs)
        links = self.verified(likeliest, sets)
        labels = components(links)
        rest = settle(self.across(pairs.select("a", "b").join(likeliest, ["a", "b"], "left_anti"), labels))
        seen = pairs.select("a", "b")
        for closest in (None, CLOSEST, 0):
            if closest is not None:
                rest = settle(self.open_pairs(stars, labels, closest).join(seen, ["a", "b"], "left_anti"))
            if rest.limit(1).count():
                more = self.verified(rest, sets if closest is None else self.sets_of_pairs(rest))
                seen = seen.unionByName(rest)
                if more.limit(1).count():
                    links = links.unionByName(more)
                    labels = components(links)
        return labels

    def by_document(self) -> DataFrame:
        """(own, n_shingles, component): the smallest row that each one reaches, itself included, as structs (none, id, doc)."""
        labels = self.labels()
        placed = self.classes.select("node", "check", "size", "own").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        smallest = placed.groupBy("comp").agg(F.min("own").alias("component"))
        placed = placed.join(smallest, "comp").select("node", "check", "size", "component")
        out = self.nodes.select("own", "node", "check", "size").join(placed, ["node", "check", "size"], "left")
        return out.select("own", F.col("size").alias("n_shingles"), F.coalesce("component", "own").alias("component"))


def _rows(keyed: DataFrame) -> DataFrame:
    return keyed.select(F.col("_row").alias("doc"), F.col("_doc.doc_id").cast("long").alias("id"), F.col("_doc.text").alias("text"))


def connect(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """doc_id, n_shingles, component_id of every row of ``docs`` (``doc_id``, ``text``)."""
    found = Join(_rows(with_row_key(docs.select("doc_id", "text"))), rule).by_document()
    return found.select(F.col("own.id").alias("doc_id"), "n_shingles", F.col("component.id").alias("component_id"))


def first_of_groups(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """One row of ``docs`` (``doc_id``, ``text``, any others) for each component: the smallest id, null ids last, then the row key."""
    keyed = with_row_key(docs)
    found = Join(_rows(keyed), rule).by_document().where("own.doc = component.doc")
    first = settle(found.select(F.col("own.doc").alias("_row"))).hint("merge")  # nearly all rows
    return keyed.join(first, "_row", "left_semi").select(*unpacked(keyed))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connect(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
