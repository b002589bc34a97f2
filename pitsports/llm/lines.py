"""Line dedup by distinct-site spread.

A line's key is its text without leading and trailing ASCII white space, as two 64-bit hashes. For each key a
HyperLogLog sketch of the sites that hold it is built and merged by aggregation (partial sketches per task, merged after
one shuffle of keys). A line whose estimate lies within the sketch's error of the threshold is *near*: for those, and
only those, the distinct sites are counted exactly. Lines on ``min_sites`` sites or more are boilerplate and are removed
from every document; all other lines stay as they are.

Every line that is not blank is a candidate, and the spread over sites alone decides; ``min_words`` can keep shorter lines
from being candidates.

Edge cases: a null text stays null (no lines); a null site counts as no site; blank lines stay; a document all of
whose lines go keeps an empty text; repeated rows are cleaned alike, also with equal or null ids, since rows are
keyed by ``doc_id`` and text hash; columns of ``docs`` are carried through in a struct, whatever their names; empty
tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitsports.llm.common import packed, settle, unpacked

MIN_SITES = 10
MIN_WORDS = 1
#: log2 of the sketch's buckets; its relative standard error is about 0.83 / sqrt(2 ** LOG_BUCKETS) in dense mode.
LOG_BUCKETS = 10
TRIM = " \t\n\x0b\f\r"


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(TRIM)))


def _is_candidate(line: Column, min_words: int) -> Column:
    return line.rlike(rf"^[^\x20\x09-\x0D]+([\x20\x09-\x0D]+[^\x20\x09-\x0D]+){{{min_words - 1}}}" if min_words > 1 else r"[^\x20\x09-\x0D]")


def _keyed(docs: DataFrame, site: str, min_words: int) -> DataFrame:
    """One row for each distinct candidate line of a document: site and the two hashes."""
    line = F.explode(F.filter(F.array_distinct(_lines(F.col("text"))), lambda x: _is_candidate(x, min_words)))
    rows = docs.select(F.col(site).alias("_site"), line.alias("_line"))
    return rows.select("_site", F.xxhash64("_line").alias("_h1"), F.xxhash64(F.lit(1), "_line").alias("_h2"))


def boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """Keys (``_h1``, ``_h2``) of the lines that at least ``min_sites`` distinct sites hold, with ``n_sites`` (exact or estimated)."""
    error = 4 * 0.83 / 2 ** (LOG_BUCKETS / 2)
    keyed = _keyed(docs, site, min_words)
    spread = (
        keyed.where("_site is not null")
        .groupBy("_h1", "_h2")
        .agg(F.hll_sketch_estimate(F.hll_sketch_agg("_site", F.lit(LOG_BUCKETS))).alias("_est"))
        .where(F.col("_est") >= min_sites * (1 - error) - 1)
    )
    spread = settle(spread)
    sure = spread.where(F.col("_est") > min_sites * (1 + error) + 1).select("_h1", "_h2", F.col("_est").alias("n_sites"))
    near = spread.where(F.col("_est") <= min_sites * (1 + error) + 1).select("_h1", "_h2")
    exact = (
        keyed.where("_site is not null")
        .join(near, ["_h1", "_h2"], "left_semi")
        .distinct()
        .groupBy("_h1", "_h2")
        .agg(F.count("*").alias("n_sites"))
        .where(F.col("n_sites") >= min_sites)
    )
    return sure.unionByName(exact)


def cleaned(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """``_doc`` (a struct of the columns of ``docs``), ``_text`` without boilerplate lines, ``_n_lines`` and ``_n_removed``.

    Hashes of candidate lines, not texts, meet the boilerplate keys; each document then gets the numbers of the lines it
    loses. Texts move once, to meet those numbers.
    """
    plain = docs.select("doc_id", "text", F.col(site).alias("_site"))
    keys = settle(boilerplate(plain, "_site", min_sites, min_words)).select("_h1", "_h2")
    hashed = plain.select(F.coalesce(F.col("doc_id"), F.lit(-1)).alias("_id"), F.xxhash64("text").alias("_key"), "text")  # once a text, not a line
    places = hashed.select("_id", "_key", F.posexplode(_lines(F.col("text"))).alias("_at", "_line")).where(_is_candidate(F.col("_line"), min_words))
    lost = (
        places.select("_id", "_key", "_at", F.xxhash64("_line").alias("_h1"), F.xxhash64(F.lit(1), "_line").alias("_h2"))
        .join(keys, ["_h1", "_h2"], "left_semi")
        .groupBy("_id", "_key")
        .agg(F.sort_array(F.collect_set("_at")).alias("_at"))
    )
    # a byte for each place up to the last one lost, 1 where a line goes: one look-up a line, however many lines there are
    before = F.concat(F.array(F.lit(-1)), F.slice("_at", 1, F.size("_at") - 1))
    marks = F.array_join(F.zip_with("_at", before, lambda at, last: F.concat(F.repeat(F.lit("0"), at - last - 1), F.lit("1"))), "")
    lost = lost.select("_id", "_key", F.size("_at").alias("_n_lost"), marks.cast("binary").alias("_lost"))
    lost = settle(lost).hint("merge")  # grows with the corpus: never broadcast
    text = F.col("_doc.text")
    same = (F.coalesce(F.col("_doc.doc_id"), F.lit(-1)) == F.col("_id")) & (F.xxhash64(text) == F.col("_key"))
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: F.substring("_lost", i + 1, F.lit(1)) != F.lit(b"1")), "\n")
    return packed(docs).join(lost, same, "left").select(
        "_doc",
        F.when(F.col("_lost").isNull(), text).otherwise(kept).alias("_text"),
        F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.split(text, "\n"))).cast("long").alias("_n_lines"),
        F.coalesce("_n_lost", F.lit(0)).cast("long").alias("_n_removed"),
    )


def clean(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without boilerplate lines, plus ``_n_lines`` and ``_n_removed`` (in the place of columns so named). Needs
    ``doc_id``, ``text`` and the site column."""
    out = cleaned(docs, site, min_sites, min_words)
    return out.select(*unpacked(out, ("_n_lines", "_n_removed"), text=F.col("_text")), "_n_lines", "_n_removed")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = clean(docs, min_words=1)
    return out.select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_removed").alias("n_removed"),
        F.length("text").cast("long").alias("n_chars_kept"),
        F.md5("text").alias("kept_md5"),
    )


OP3_SQL = rf"""
WITH lines AS (
  SELECT doc_id, source, text, unnest(coalesce(string_split(text, chr(10)), [NULL])) AS line, unnest(range(coalesce(len(string_split(text, chr(10))), 1))) AS pos FROM documents
), keyed AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM lines
), spread AS (
  SELECT k FROM keyed
  WHERE regexp_matches(k, '^[^\x20\x09-\x0D]+([\x20\x09-\x0D]+[^\x20\x09-\x0D]+){{{MIN_WORDS - 1}}}')
  GROUP BY k HAVING count(DISTINCT source) >= {MIN_SITES}
), marked AS (
  SELECT keyed.*, k IN (SELECT k FROM spread) AS gone FROM keyed
), kept AS (
  SELECT doc_id, count(text) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         CASE WHEN any_value(text) IS NOT NULL THEN coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE gone IS NOT TRUE), '') END AS text
  FROM marked GROUP BY doc_id
)
SELECT doc_id, n_lines, n_removed, length(text) AS n_chars_kept, md5(text) AS kept_md5 FROM kept
"""
