"""Personal data: base patterns, plus spans that gradient-boosted trees select among overlapping candidates.

*Base.* Four patterns with their checks (address parts at most 255, Luhn, digit counts). Matches are leftmost and do not
overlap within a kind; a match that fails its check is dropped. Base spans are always reported.

*Candidates.* For each kind a looser generator proposes spans that may overlap base matches, other kinds and each other.
Format features (digits, separators, brackets, checksum, largest part, ...) and context features (the characters before
and after, a cue word nearby) describe each. Boosted trees score them.

*Labels.* The trees learn on all documents, each once as it is and once *rewritten*: addresses with
``[at]`` and ``[dot]``, numbers without their plus sign or with 00, cards with other separators. A candidate is positive if
it stands for a value that the document is known to hold, in whatever format: the same digits, or the same address once
the brackets are undone. All others are negative. So the trees see personal data in formats that the base patterns do
not match, in its real surroundings. The threshold of each kind is calibrated on the other half of them as the
lowest score from which at least ``PRECISION`` of the candidates are positive. Selected candidates that overlap no base
span are added, best score first, without overlaps. What overlaps a base span is left out before it is scored.

Everything is a DataFrame expression: matches come from ``regexp_extract_all`` and their places from the lengths of what
``split`` leaves between them; the fitted trees are compiled to CASE expressions. Only texts that hold a kind's telltale
characters are searched for it. Patterns are possessive, with look-behinds that keep the search linear, and match the same
strings as the plain greedy forms.

Edge cases: a null text is empty (no spans); offsets are code points, end exclusive; ties in score go to the earlier span;
repeated rows are searched alike; a text's spans are compared in order of start, so that time follows their number (only
added spans of one unbroken run of overlaps are compared with one another); without positive candidates nothing is added; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitsports.llm.common import settle

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind's base pattern to have a valid match.
TELLTALE = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
LOOSE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++(?:@|\x20?[\[(](?:at|AT)[\])]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+|00)?(?:[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[\x20.-]?[0-9]{3,4}){1,2}(?![0-9])",
}
LOOSE_TELLTALE = {"email": r"@[A-Za-z0-9]|[\[(](?:at|AT)[\])]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20.-]?[0-9]){12}", "phone": r"[0-9]{3}[\x20.-]?[0-9]{3}|\([0-9]{2,4}\)"}
CUES = r"(?i)mail|phone|tel|call|fax|mobile|card|visa|credit|contact|address|host|server|login"
#: The trees, and the share of a kind's candidates that must be positive from its threshold on.
TREES, DEPTH, PRECISION = 10, 4, 0.95
CONTEXT = 24
#: Numbers that are folded at a time, code points of a text that are looked into at a time, and beyond any place in a text.
BLOCK, CHUNK, LAST = 64, 1024, 2**31 - 1


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(acc, i):
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when((n - i) % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
        return acc + twice

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), step) % 10 == 0


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def running(values: Column, fold=lambda x, y: x + y, zero: int = 0) -> Column:
    """The first 1, 2, ... numbers of an array folded, by blocks of ``BLOCK``: an array that grows by one costs its square."""
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(zero).alias("at"), none.alias("out"))
    step = lambda acc, x: let(fold(acc["at"], x), lambda y: F.struct(y.alias("at"), F.concat(acc["out"], F.array(y)).alias("out")))
    folded = lambda x: F.aggregate(x, start, step, lambda acc: acc["out"])
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda j: folded(F.slice(values, j * BLOCK + 1, F.lit(BLOCK))))
    shifted = lambda x, by: F.zip_with(x, F.concat(F.array(F.lit(zero)), by), lambda part, more: F.transform(part, lambda y: fold(more, y)))
    totals = lambda x: folded(F.transform(F.slice(x, 1, F.size(x) - 1), lambda part: F.element_at(part, -1)))
    return F.when(F.size(values) == 0, none).otherwise(let(cut, lambda x: F.flatten(shifted(x, totals(x)))))


def located(text: Column, pattern: str, telltale: str, kind: int) -> Column:
    """All matches of ``pattern`` as structs k, s, e, v (kind, start, end in code points, value)."""
    empty = F.array().cast("array<struct<k:int,s:int,e:int,v:string>>")

    def place(found: Column) -> Column:
        values = found["values"]
        sizes = F.zip_with(F.slice(found["gaps"], 1, F.size(values)), values, lambda gap, v: F.length(gap) + F.length(v))
        return F.zip_with(
            values, let(sizes, lambda n: running(n)), lambda v, e: F.struct(F.lit(kind).alias("k"), (e - F.length(v)).alias("s"), e.alias("e"), v.alias("v"))
        )

    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"))
    return F.when(text.rlike(telltale), let(found, place)).otherwise(empty)


def is_valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    if kind == "card":
        return let(digits_of(value), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False)))
    return F.length(digits_of(value)).between(8, 15)


def _checker(kind: str):
    return lambda x: is_valid(kind, x["v"])


def _of_kind(k: int):
    return lambda x: x["k"] == k


def base_spans(text: Column) -> Column:
    """Valid base spans of all kinds, by kind, then start."""
    return F.concat(
        *[F.filter(located(text, BASE[kind], TELLTALE[kind], k), _checker(kind)) for k, kind in enumerate(KINDS)]
    )


def candidates(text: Column) -> Column:
    return F.concat(*[located(text, LOOSE[kind], LOOSE_TELLTALE[kind], k) for k, kind in enumerate(KINDS)])


def clear_of(found: Column, base: Column) -> Column:
    """The spans of ``found`` that overlap none of ``base``: one sort, the furthest end before each and the next start after."""
    marked = lambda own: lambda x: F.struct(x["s"].alias("s"), F.lit(own).alias("own"), *[x[n].alias(n) for n in ("k", "e", "v")])

    def sweep(both: Column) -> Column:
        ends = let(F.transform(both, lambda x: F.when(x["own"], 0).otherwise(x["e"])), lambda e: running(e, F.greatest))
        starts = F.reverse(F.transform(both, lambda x: F.when(x["own"], LAST).otherwise(x["s"])))
        starts = F.reverse(let(starts, lambda s: running(s, F.least, LAST)))
        near = F.zip_with(ends, starts, lambda e, s: F.struct(e.alias("end"), s.alias("start")))
        told = F.zip_with(both, near, lambda x, n: F.struct(x.alias("x"), (x["own"] & (n["end"] <= x["s"]) & (n["start"] >= x["e"])).alias("clear")))
        return F.transform(F.filter(told, lambda y: y["clear"]), lambda y: F.struct(*[y["x"][n].alias(n) for n in ("k", "s", "e", "v")]))

    both = F.sort_array(F.concat(F.transform(found, marked(True)), F.transform(base, marked(False))))
    return F.when((F.size(found) == 0) | (F.size(base) == 0), found).otherwise(let(both, sweep))


def best_apart(found: Column) -> Column:
    """Spans (s, e, k, worst) taken best first unless they overlap one taken before; each run of overlapping spans by itself."""
    none = F.array().cast("array<struct<k:int,s:int,e:int>>")
    clash = lambda taken, x: F.exists(taken, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))
    plain = lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))

    def taken(run: Column) -> Column:
        ranked = F.sort_array(F.transform(run, lambda x: F.struct(*[x[n].alias(n) for n in ("worst", "s", "k", "e")])))
        return F.aggregate(ranked, none, lambda acc, x: F.when(clash(acc, x), acc).otherwise(F.concat(acc, F.array(plain(x)))))

    def by_run(x: Column) -> Column:
        ends = let(F.transform(x, lambda y: y["e"]), lambda e: running(e, F.greatest))
        begins = let(ends, lambda e: F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.coalesce(F.get(e, i - 1), F.lit(0)) <= F.get(x, i)["s"]))
        cut = lambda at: F.transform(at, lambda b, j: taken(F.slice(x, b + 1, F.coalesce(F.get(at, j + 1), F.size(x)) - b)))
        return F.flatten(let(begins, cut))

    return F.when(F.size(found) == 0, none).otherwise(let(F.sort_array(found), by_run))


def part_of(chunks: Column, at: Column, n: Column) -> Column:
    """``n`` code points from ``at`` on of a text in chunks; a substring of the whole text is counted from its start."""
    j = F.floor(at / CHUNK).cast("int")
    two = F.concat(*[F.coalesce(F.get(chunks, i), F.lit("")) for i in (j, j + 1)])
    return F.substring(two, at - j * CHUNK + 1, n)


def features(chunks: Column, x: Column) -> dict[str, Column]:
    """Numbers that describe candidate ``x`` of a text in chunks; booleans as 0 and 1."""
    v = x["v"]
    before = part_of(chunks, F.greatest(x["s"] - CONTEXT, F.lit(0)), F.least(x["s"], F.lit(CONTEXT)))
    after = part_of(chunks, x["e"], F.lit(CONTEXT))
    flag = lambda c: F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))
    count = lambda chars: F.length(F.regexp_replace(v, f"[^{chars}]", "")).cast("double")
    digits = digits_of(v)
    return {
        "kind": x["k"].cast("double"),
        "length": F.length(v).cast("double"),
        "digits": F.length(digits).cast("double"),
        "blanks": count(r"\x20"),
        "dots": count(r"."),
        "dashes": count(r"-"),
        "brackets": count(r"()\[\]"),
        "letters": count(r"A-Za-z"),
        "plus": flag(v.startswith("+")),
        "at": flag(F.contains(v, F.lit("@"))),
        "octets": flag(v.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")),
        "luhn": flag(F.length(digits).between(12, 19) & let(digits, luhn)),
        "ending": F.length(F.regexp_extract(v, r"[.\])\x20]([A-Za-z]+)$", 1)).cast("double"),
        "plus_before": flag(before.rlike(r"\+[0-9\x20().-]{0,6}$")),
        "word_before": flag(before.rlike(r"[A-Za-z0-9]$")),
        "digit_near": flag(before.rlike(r"[0-9][.\x20-]?$") | after.rlike(r"^[.\x20-]?[0-9]")),
        "letter_after": flag(after.rlike(r"^[A-Za-z]")),
        "cue": flag(before.rlike(CUES)),
    }


def described(rows: DataFrame) -> DataFrame:
    """``rows`` with ``cand``, an array of candidates (k, s, e, v), given the features of each."""
    chunks = F.when(F.size("cand") == 0, F.array().cast("array<string>")).otherwise(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}+"), F.lit(0)))
    full = lambda c: lambda x: F.struct(*[x[n].alias(n) for n in ("k", "s", "e", "v")], *[f.alias(n) for n, f in features(c, x).items()])
    return rows.withColumn("cand", let(chunks, lambda c: F.transform("cand", full(c))))


def rewritten(text: Column, key: Column) -> Column:
    """``text`` with its addresses and numbers in formats that the base patterns do not match."""
    text = F.regexp_replace(text, rf"(?:\G|(?<![{LOCAL}]))([{LOCAL}]++)@([A-Za-z0-9-]++)\.([A-Za-z0-9-]++)", "$1 [at] $2 [dot] $3")
    text = F.regexp_replace(text, r"(?<=[0-9]{4})[\x20-](?=[0-9]{4})", ".")
    odd = F.pmod(F.xxhash64(F.lit(3), key), F.lit(2)) == 1
    return F.when(odd, F.regexp_replace(text, r"\+(?=[0-9])", "00")).otherwise(F.regexp_replace(text, r"\+(?=[0-9])", ""))


def known_as(k: Column, value: Column) -> Column:
    """A span's value without its format: kind and digits, or the address with brackets undone."""
    plain = F.regexp_replace(F.regexp_replace(value, r"\x20?[\[(](?:at|AT)[\])]\x20?", "@"), r"\x20?[\[(](?:dot|DOT)[\])]\x20?", ".")
    digits = F.regexp_replace(digits_of(value), "^00", "")
    return F.concat_ws(":", k.cast("string"), F.when(k == 0, F.lower(plain)).when(k == 1, value).otherwise(digits))


#: Names of the features, in the order of the trees' feature numbers.
NAMES = [
    "kind", "length", "digits", "blanks", "dots", "dashes", "brackets", "letters", "plus", "at", "octets", "luhn", "ending",
    "plus_before", "word_before", "digit_near", "letter_after", "cue",
]


def _compiled(node, x: Column) -> Column:
    """A fitted tree as a CASE expression over the fields of ``x``."""
    if "LeafNode" in node.getClass().getSimpleName():
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(x[NAMES[split.featureIndex()]] <= float(split.threshold()), _compiled(node.leftChild(), x)).otherwise(_compiled(node.rightChild(), x))


class Selector:
    """Fitted trees and the calibrated threshold of each kind; ``score`` gives a probability as a column."""

    def __init__(self, trees: list, weights: list[float], thresholds: list[float]):
        self.trees, self.weights, self.thresholds = trees, weights, thresholds

    def score(self, x: Column) -> Column:
        if not self.trees:
            return F.lit(0.0)
        margin = sum((F.lit(float(w)) * _compiled(t, x) for t, w in zip(self.trees, self.weights, strict=True)), F.lit(0.0))
        return 1 / (1 + F.exp(-2 * margin))

    def cut(self, x: Column) -> Column:
        return F.element_at(F.array(*[F.lit(float(t)) for t in self.thresholds]), x["k"] + 1)


def fit(docs: DataFrame) -> Selector:
    """Learn from the candidates of one half of the documents (by the hash of their ids), calibrate on those of the other."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    known = texts.select("row", F.explode(F.transform(base_spans(F.col("text")), lambda x: known_as(x["k"], x["v"]))).alias("value"))
    known = known.distinct().withColumn("label", F.lit(1.0))
    both = texts.select("doc_id", "row", F.explode(F.array("text", rewritten(F.col("text"), F.col("doc_id")))).alias("text"))
    both = described(both.withColumn("cand", candidates(F.col("text"))))
    rows = both.select("doc_id", "row", F.explode("cand").alias("x")).withColumn("value", known_as(F.col("x.k"), F.col("x.v")))
    rows = rows.join(known, ["row", "value"], "left").select(
        F.pmod(F.xxhash64(F.lit(7), F.col("doc_id")), F.lit(2)).alias("fold"),
        F.coalesce("label", F.lit(0.0)).alias("label"),
        F.col("x.k").alias("k"),
        *[F.col(f"x.{n}").alias(n) for n in NAMES],
    )
    rows = settle(rows)
    seen = {r["label"] for r in rows.where("fold = 0").select("label").distinct().collect()}
    if seen != {0.0, 1.0}:
        return Selector([], [], [2.0] * len(KINDS))
    train = VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows.where("fold = 0")).select("label", "features")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=7, stepSize=0.3).fit(train)
    selector = Selector([t._call_java("rootNode") for t in model.trees], list(model.treeWeights), [2.0] * len(KINDS))
    steps = 200
    graded = (
        rows.where("fold = 1")
        .select("k", "label", F.floor(selector.score(F.struct(*NAMES)) * steps).cast("int").alias("at"))
        .groupBy("k", "at")
        .agg(F.count("*").alias("n"), F.sum("label").alias("good"))
        .collect()
    )
    for k in range(len(KINDS)):
        n = good = 0.0
        for r in sorted((r for r in graded if r["k"] == k), key=lambda r: -r["at"]):
            n, good = n + r["n"], good + r["good"]
            if good and good >= PRECISION * n:
                selector.thresholds[k] = r["at"] / steps
    return selector


def find(docs: DataFrame, selector: Selector) -> DataFrame:
    """doc_id, base and spans (arrays of k, s, e): base spans, and base spans with those that the trees add."""
    plain = lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("base", base_spans(F.col("text")))
    rows = described(rows.withColumn("cand", clear_of(candidates(F.col("text")), F.col("base"))))  # what overlaps base needs no score
    rows = rows.select("doc_id", F.transform("base", plain).alias("base"), "cand")
    scored = F.transform(
        "cand",
        lambda x: let(
            selector.score(x),
            lambda p: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), (-p).alias("worst"), (p >= selector.cut(x)).alias("take")),
        ),
    )
    added = let(F.filter(scored, lambda x: x["take"]), best_apart)
    return rows.select("doc_id", "base", F.sort_array(F.concat("base", added)).alias("spans"))


def _written(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs, fit(docs))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_written("base"), 256).alias("base_sha256"), _written("spans").alias("spans"))
