"""Structured Streaming jobs: latest-wins merges, facts that move to a later day, and running totals in state.

Late corrections may be months old, so no watermark drops them: each micro-batch rewrites the buckets of a Parquet table
that it touches, and replaying a batch gives the same table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pitsports.operators.tables import merge_latest


def hadoop_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _names(spark: SparkSession, path: str) -> list[str]:
    folder = hadoop_path(spark, path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []


def versions(spark: SparkSession, path: str, before: int | None = None) -> dict[int, list[int]]:
    """The complete batches (before ``before``) that hold each bucket of a merged table, oldest first."""
    out: dict[int, list[int]] = {}
    for name in _names(spark, path):
        if name.startswith("batch=") and (before is None or int(name[6:]) < before):
            inside = _names(spark, f"{path}/{name}")
            for bucket in inside if "_SUCCESS" in inside else ():
                if bucket.startswith("_bucket="):
                    out.setdefault(int(bucket[8:]), []).append(int(name[6:]))
    return {bucket: sorted(batches) for bucket, batches in out.items()}


def _read(spark: SparkSession, path: str, at: dict[int, list[int]], schema) -> DataFrame:
    paths = [f"{path}/batch={batches[-1]}/_bucket={bucket}" for bucket, batches in at.items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def merged_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest rows of a merged table, or None before the first batch."""
    at = versions(spark, path)
    if not at:
        return None
    bucket, batches = next(iter(at.items()))
    return _read(spark, path, at, spark.read.parquet(f"{path}/batch={batches[-1]}/_bucket={bucket}").schema)


def change_buckets(path: str, batch_id: int, changes: DataFrame, by: Sequence[str], change: Callable[[DataFrame, DataFrame], DataFrame], schema, buckets: int) -> None:
    """Apply ``change(old, changes)`` to the buckets of a merged table (rows hashed by ``by``) that ``changes`` touches.

    Only those buckets are read and written, as ``batch=<id>/_bucket=<b>``; others keep their earlier batch. Readers see a
    batch once it is complete, and a replayed batch starts from the batches before it, so the step can be repeated.
    Versions of a bucket before the last two are removed.
    """
    spark = changes.sparkSession
    bucket = F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int")
    touched = {r[0] for r in changes.select(bucket).distinct().collect()}  # at most ``buckets`` numbers
    at = {b: batches for b, batches in versions(spark, path, batch_id).items() if b in touched}
    old = _read(spark, path, at, schema)
    change(old, changes).withColumn("_bucket", bucket).write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/batch={batch_id}")
    for b, batches in at.items():
        for batch in batches[:-1]:
            place = hadoop_path(spark, f"{path}/batch={batch}/_bucket={b}")
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def merge_stream(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: Sequence[Column], by: Sequence[str] | None = None, buckets: int = 16) -> StreamingQuery:
    """Merge each micro-batch latest-wins by ``keys`` into ``path``, a table in ``buckets`` of ``by`` (default: the keys); a
    batch rewrites the buckets that it touches."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        change_buckets(path, batch_id, batch, by or keys, lambda old, new: merge_latest(old, new, keys, order), stream.schema, buckets)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dated_stream(facts: DataFrame, moves: DataFrame, path: str, checkpoint: str, key: str, day: str, to: str, keys: Sequence[str], order: Sequence[Column], buckets: int = 16) -> StreamingQuery:
    """Facts with ``available``, the day from which they count: their ``day``, or where their ``key`` has been moved, ``to``.

    ``facts`` and ``moves`` (``key``, ``to``) arrive in one query, in any order. A move is kept for facts that come later,
    and dates the facts that are there already anew: a batch rewrites the buckets of the keys of its facts and moves. Facts
    are latest-wins by ``keys``; of several moves of a key the latest day holds.
    """
    kept = f"{path}/moves"

    def apply(batch: DataFrame, batch_id: int) -> None:
        new_moves = batch.where("_move").select(key, to)
        change_buckets(kept, batch_id, new_moves, [key], lambda old, new: old.unionByName(new).groupBy(key).agg(F.max(to).alias(to)), moves.select(key, to).schema, buckets)

        def change(old: DataFrame, new: DataFrame) -> DataFrame:
            rows = merge_latest(old.drop("available"), new.where("not _move").select(facts.columns), keys, order)
            known = merged_table(batch.sparkSession, kept)
            moved = rows.join(known, key, "left") if known is not None else rows.withColumn(to, F.lit(None))
            return moved.withColumn("available", F.coalesce(to, day)).select(*facts.columns, "available")

        schema = facts.withColumn("available", F.col(day)).schema
        change_buckets(f"{path}/facts", batch_id, batch, [key], change, schema, buckets)

    both = facts.withColumn("_move", F.lit(False)).unionByName(moves.select(key, to).withColumn("_move", F.lit(True)), allowMissingColumns=True)
    return both.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: The state store that keeps a map for each key on disk, so that a key's days need not fit in memory.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunningTotals(StatefulProcessor):
    """Keyed state: a sum for each day, and the last day with the total up to it.

    Rows of days after the last one continue from its total. Rows of earlier days are patched in: the sums of the days from
    the first patched one on are read, and each of those days is put out again. Rows out: key, day and ``cum_`` totals.
    """

    def __init__(self, key: str, day: str, sums: Sequence[str]):
        self.key, self.day, self.sums = key, day, list(sums)

    def init(self, handle: StatefulProcessorHandle) -> None:
        columns = ", ".join(f"{c} long" for c in self.sums)
        self.days = handle.getMapState("days", "day int", columns)
        self.last = handle.getValueState("last", f"day int, {columns}")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        new = pd.concat(list(rows)).groupby(self.day)[self.sums].sum().sort_index()
        last = self.last.get() if self.last.exists() else None
        first = int(new.index[0])
        sums = {}
        for day, values in zip(new.index.tolist(), new.to_numpy().tolist(), strict=True):
            before = self.days.getValue((day,)) if last is not None and day <= last[0] and self.days.containsKey((day,)) else [0] * len(values)
            sums[day] = [int(a + b) for a, b in zip(values, before, strict=True)]
            self.days.updateValue((day,), tuple(sums[day]))
        if last is None or first > last[0]:
            total = list(last[1:]) if last is not None else [0] * len(self.sums)
        else:  # late days: everything from the first of them on changes
            total = [0] * len(self.sums)
            for (day,), values in self.days.iterator():
                if day < first:
                    total = [a + b for a, b in zip(total, values, strict=True)]
                else:
                    sums[day] = list(values)
        out = []
        for day in sorted(sums):
            total = [int(a + b) for a, b in zip(total, sums[day], strict=True)]
            out.append((key[0], day, *total))
        self.last.update((out[-1][1], *total))
        yield pd.DataFrame(out, columns=[self.key, self.day, *[f"cum_{c}" for c in self.sums]])

    def close(self) -> None:
        pass


def running_totals_stream(stream: DataFrame, key: str, day: str, sums: Sequence[str], path: str, checkpoint: str) -> StreamingQuery:
    """Running totals of ``sums`` by ``key`` and ``day`` (an int, such as days since 1970), kept in state.

    Each micro-batch writes the rows that it made or changed to ``batch=<id>`` below ``path``; :func:`latest_rows` reads the
    newest row of each key and day. A batch that is replayed writes its own rows again. The session's state store must be
    ``STATE_STORE``; it is set for the start of this query.
    """
    spark = stream.sparkSession
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    kind = stream.schema[key].dataType.simpleString()
    out = stream.groupBy(key).transformWithStateInPandas(
        RunningTotals(key, day, sums), f"{key} {kind}, {day} int, {', '.join(f'cum_{c} long' for c in sums)}", outputMode="Update", timeMode="None"
    )
    write = lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    spark.conf.set(setting, STATE_STORE)
    try:
        return out.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(setting, before)


def latest_rows(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The row of the newest batch for each of ``keys`` below ``path``."""
    rows = spark.read.option("basePath", path).parquet(path)
    values = F.struct(*[F.col(c) for c in rows.columns if c != "batch"])
    return rows.groupBy(*keys).agg(F.max_by(values, "batch").alias("_row")).select("_row.*")
