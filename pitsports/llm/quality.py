"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Words are runs of characters other than ASCII white space. Every word and every pair of neighbouring words falls into
one of ``buckets`` bins by hash. Two multinomials over the bins are counted - one over all documents labelled good,
one over the whole raw corpus - and each document is scored by the mean over its n-grams of
``ln(p_target(bin) / p_raw(bin))``. A document is kept if its score reaches a threshold; nothing is sampled.

The main path is DataFrame expressions only. The model is one array of ``buckets`` doubles (a fixed size), which
travels inside the plan.

Edge cases: a null or blank text has no words, fails the base rule and is rejected with score null; an empty corpus or
an empty target gives a model of zeros; repeated rows are scored alike; other columns are carried along in a struct,
whatever their names.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitsports.llm.common import packed, unpacked

BUCKETS = 4096
#: Pseudo-count of each bin in both multinomials.
SMOOTHING = 1.0
#: Labelled ids that are sent to all tasks; beyond that they are joined by shuffle. All are used either way.
SENT = 2_000_000
WHITE = r"[\x20\x09-\x0D]+"
WHITE_CHARS = " \t\n\x0b\f\r"
NOT_SYMBOLS = r"[^#*$%&|<>]+"
#: Bits of a long that number a window inside its text.
PLACE_BITS = 24


def let(value: Column, body) -> Column:
    """Bind ``value`` once: inside ``body`` it is a variable, not an expression that is computed at each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE))


def hashes_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def turned(x: Column, bits: int) -> Column:
    """Rotate a long to the left, so that combining hashes with xor depends on their order."""
    return F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits))


def bins_of(h: Column, buckets: int) -> Column:
    """Bins of all words, then of all neighbouring pairs, from the words' hashes; ``buckets`` is a power of two."""
    rest = F.greatest(F.size(h) - 1, F.lit(0))
    return F.concat(
        F.transform(h, lambda x: x.bitwiseAND(F.lit(buckets - 1)).cast("int")),
        F.zip_with(F.slice(h, 1, rest), F.slice(h, 2, rest), lambda a, b: turned(a, 23).bitwiseXOR(b).bitwiseAND(F.lit(buckets - 1)).cast("int")),
    )


def labelled(labels: DataFrame) -> DataFrame:
    """All labelled ids. Up to ``SENT`` of them (counted) travel to all tasks, so that no text is shuffled; more are joined by shuffle."""
    seen = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").alias("_id"), "quality").distinct()
    return F.broadcast(seen) if seen.count() <= SENT else seen


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> list[float]:
    """ln(p_target / p_raw) of each bin: the raw counts cover all documents, the target those of all documents labelled good.

    One flat aggregation on the bin number; the partial aggregation leaves at most ``buckets`` rows a task.
    """
    binned = docs.select("doc_id", "text").join(labelled(labels).where("quality = 1"), F.col("doc_id") == F.col("_id"), "left").select(
        F.col("quality").isNotNull().cast("long").alias("good"),
        F.explode(let(hashes_of(words_of(F.col("text"))), lambda h: bins_of(h, buckets))).alias("bin"),
    )
    counted = binned.groupBy("bin").agg(F.count("*").alias("raw"), F.sum("good").alias("target")).collect()
    raw_total = sum(r["raw"] for r in counted) + smoothing * buckets
    target_total = sum(r["target"] for r in counted) + smoothing * buckets
    model = [0.0] * buckets
    if target_total > smoothing * buckets:
        at = {r["bin"]: (r["raw"], r["target"]) for r in counted}
        for b in range(buckets):
            raw, target = at.get(b, (0, 0))
            model[b] = math.log((target + smoothing) / target_total) - math.log((raw + smoothing) / raw_total)
    return model


def repeated_words(h: Column) -> Column:
    """Number of words that lie in a 3-word window found at least twice in the text, from the words' hashes.

    If all windows are distinct the answer is 0. Else the windows' places are sorted by their hashes: by 40 bits of them,
    with the place in the same long, or as pairs where a text has more windows than ``PLACE_BITS`` can number. A window
    is a repeat if a near neighbour in that order has the same 64-bit hash; two neighbours on either side are compared, as
    another window may share the 40 bits. Each repeated window covers up to three words, less what the next repeated
    window covers itself.
    """
    low = (1 << PLACE_BITS) - 1

    def covered(w: Column, p: Column) -> Column:
        same = lambda x, i: F.get(w, F.get(p, i)) == F.get(w, x)
        again = F.sort_array(F.filter(p, lambda x, i: same(x, i - 1) | same(x, i + 1) | same(x, i - 2) | same(x, i + 2)))
        return F.aggregate(
            again,
            F.struct(F.lit(0).cast("long").alias("total"), F.lit(-10).alias("last")),
            lambda acc, x: F.struct((acc["total"] + F.least(F.lit(3), x - acc["last"])).cast("long").alias("total"), x.alias("last")),
            lambda acc: acc["total"],
        )

    windows = F.transform(F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
    in_one = lambda w: F.transform(w, lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
    pairs = lambda w: F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    places = lambda w: F.when(
        F.size(w) <= low, F.transform(F.sort_array(in_one(w)), lambda x: x.bitwiseAND(F.lit(low)).cast("int"))
    ).otherwise(F.transform(F.sort_array(pairs(w)), lambda x: x["i"]))
    return let(
        windows,
        lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(let(places(w), lambda p: covered(w, p))),
    )


def measured(text: Column, model: list[float] | None = None) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and (with a model) llr of ``text``, from
    :func:`by_word` in the column ``_by_word``."""
    t = F.coalesce(text, F.lit(""))
    full = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.col("_by_word.n"),
        "word_chars": F.col("_by_word.chars"),
        "n_symbols": F.length(F.regexp_replace(t, NOT_SYMBOLS, "")).cast("long"),
        "n_dup_lines": let(full, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "n_repeat_words": F.col("_by_word.again"),
        "base_failed": (F.col("_by_word.n") < 50) | (100 * F.col("_by_word.again") > 50 * F.col("_by_word.n")),
        "llr": F.col("_by_word.llr"),
    }


def by_word(text: Column, model: list[float] | None) -> Column:
    """A struct of the measures that are made over the words of ``text``."""
    return let(
        words_of(text),
        lambda w: let(
            hashes_of(w),
            lambda h: F.struct(
                F.size(h).cast("long").alias("n"),
                F.length(F.array_join(w, "")).cast("long").alias("chars"),
                repeated_words(h).alias("again"),
                (mean_ratio(h, model) if model else F.lit(None).cast("double")).alias("llr"),
            ),
        ),
    )


def base_columns(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """``docs`` with the columns of :func:`measured`, which take the place of columns so named."""
    rows = packed(docs).withColumn("_by_word", by_word(F.col("_doc.text"), model))
    columns = measured(F.col("_doc.text"), model)
    return rows.select(*unpacked(rows, columns), *[c.alias(name) for name, c in columns.items()])


def mean_ratio(h: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of the n-grams of a text with word hashes ``h``; null if it has none."""
    weights = F.from_json(F.lit(json.dumps(model)), "array<double>")  # a constant: Catalyst folds it once
    n = F.nullif(2 * F.size(h) - 1, F.lit(-1))
    return F.aggregate(bins_of(h, len(model)), F.lit(0.0), lambda acc, x: acc + F.get(weights, x)) / n


def threshold(docs: DataFrame, labels: DataFrame, model: list[float], bins: int = 2000, low: float = -4.0, high: float = 4.0) -> float:
    """The score that best separates good from bad labels: the cut with the largest true-positive minus false-positive rate.

    The labelled documents' scores are counted in ``bins`` equal steps, so the driver sees ``bins`` rows at most. Ties take the
    lowest cut (fewer documents go). Without both labels the cut is ``low`` (keep all).
    """
    step = (high - low) / bins
    llr = let(hashes_of(words_of(F.col("text"))), lambda h: mean_ratio(h, model))
    place = F.least(F.greatest(F.floor((llr - low) / step), F.lit(0)), F.lit(bins - 1))
    rows = (
        docs.select("doc_id", "text").join(labelled(labels), F.col("doc_id") == F.col("_id"))
        .groupBy(place.alias("at"))
        .agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
        .where("at is not null")
        .collect()
    )
    good, bad = sum(r["good"] for r in rows), sum(r["bad"] for r in rows)
    if not good or not bad:
        return low
    best, cut, lost_good, lost_bad = 0.0, low, 0, 0
    for r in sorted(rows, key=lambda r: r["at"]):
        lost_good, lost_bad = lost_good + r["good"], lost_bad + r["bad"]
        gain = lost_bad / bad - lost_good / good
        if gain > best + 1e-12:
            best, cut = gain, low + (r["at"] + 1) * step
    return cut


def judged(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``_doc`` (a struct of the columns of ``docs``), the columns of :func:`measured` and ``kept`` (boolean)."""
    model = fit(docs, labels, buckets)
    cut = threshold(docs, labels, model)
    rows = packed(docs).withColumn("_by_word", by_word(F.col("_doc.text"), model))
    out = rows.select("_doc", *[c.alias(name) for name, c in measured(F.col("_doc.text"), model).items()])
    return out.withColumn("kept", F.coalesce(~F.col("base_failed") & (F.col("llr") >= F.lit(cut)), F.lit(False)))


def judge(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with the base columns, ``kept`` and, last, ``llr`` (double); they take the place of columns so named."""
    out = judged(docs, labels, buckets)
    new = [c for c in out.columns if c not in ("_doc", "llr")] + ["llr"]
    return out.select(*unpacked(out, new), *new)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return judge(docs, labels).drop("text")
