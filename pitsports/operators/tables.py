"""Table operations: conforming, latest-wins merges, upserts, compaction, snapshots and checked overwrites.

Tables are Parquet folders. A checked write goes to a new folder first; ``write_version`` switches readers to it by one
pointer file, ``checked_overwrite`` copies it into place.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns by name in the schema's order and types: missing ones become typed nulls, extra ones go.

    Doubles are rounded before they become integers.
    """
    kinds = dict(df.dtypes)
    out = []
    for field in schema:
        if field.name not in kinds:
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        c = F.col(field.name)
        if kinds[field.name] in ("double", "float") and isinstance(field.dataType, T.IntegralType):
            c = F.round(c)
        out.append(c.cast(field.dataType).alias(field.name))
    return df.select(*out)


def merge_latest(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """Union in which a key's row of ``new`` replaces that of ``old``; ``order`` breaks ties inside one side, last wins."""
    both = old.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    window = Window.partitionBy(*keys).orderBy(F.col("_src").desc(), *[c.desc() for c in order])
    return both.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank", "_src")


def replace_groups(old: DataFrame, new: DataFrame, group: Sequence[str], key: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """All rows of the groups in ``new`` replace those of ``old``; hand-set columns ``keep`` are carried over by ``key``."""
    rest = old.join(new.select(*group).distinct(), list(group), "left_anti")
    if keep:
        kept = old.select(*key, *[F.col(c).alias(f"_{c}") for c in keep])
        new = new.join(kept, list(key), "left").withColumns({c: F.coalesce(f"_{c}", c) for c in keep}).select(*new.columns)
    return rest.unionByName(new)


def insert_missing(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """``old`` with those rows of ``new`` whose key it lacks."""
    return old.unionByName(new.join(old.select(*key), list(key), "left_anti"))


def fill_nulls(table: DataFrame, source: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Null values of ``columns`` from ``source``; set values stay."""
    side = source.select(*key, *[F.col(c).alias(f"_{c}") for c in columns])
    return table.join(side, list(key), "left").withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).select(*table.columns)


def update_values(table: DataFrame, values: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Values of ``columns`` from ``values`` where it has the key and a value."""
    side = values.select(*key, *[F.col(c).alias(f"_{c}") for c in columns])
    return table.join(side, list(key), "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).select(*table.columns)


def compact(df: DataFrame, path: str, keys: Sequence[str], files: int) -> None:
    """Write key-sorted files: readers prune by the row groups' ranges."""
    df.repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.mode("overwrite").option("compression", "zstd").parquet(path)


def content_hash(df: DataFrame) -> DataFrame:
    """One row: rows and an order-free hash of all values."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")).cast("string").alias("content"))


def snapshot(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write every table below ``path`` and a manifest (name, columns, rows, content); returns the manifest."""
    manifest = None
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        row = content_hash(df.sparkSession.read.parquet(f"{path}/{name}")).select(F.lit(name).alias("name"), F.lit(len(df.columns)).alias("columns"), "rows", "content")
        manifest = row if manifest is None else manifest.unionByName(row)
    manifest.write.mode("overwrite").parquet(f"{path}/_manifest_table")
    return manifest


def verify_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows with what the files hold now and whether they agree."""
    manifest = spark.read.parquet(f"{path}/_manifest_table")
    now = None
    for (name,) in manifest.select("name").collect():  # a row for each table of the catalogue, not of data
        row = content_hash(spark.read.parquet(f"{path}/{name}")).select(F.lit(name).alias("name"), F.col("rows").alias("rows_now"), F.col("content").alias("content_now"))
        now = row if now is None else now.unionByName(row)
    return manifest.join(now, "name").withColumn("ok", (F.col("rows") == F.col("rows_now")) & (F.col("content") == F.col("content_now")))


def checked_overwrite(df: DataFrame, gates: Sequence[Callable[[DataFrame], DataFrame]], path: str) -> DataFrame:
    """Stage ``df``, run the gates on what was written, and replace ``path`` only if all pass; returns the gates' rows.

    The last step overwrites ``path`` in place; where readers must never see it half written, use :func:`write_version`.
    """
    spark = df.sparkSession
    staged = f"{path}__staged"
    df.write.mode("overwrite").parquet(staged)
    written = spark.read.parquet(staged)
    results = None
    for gate in gates:
        rows = gate(written)
        results = rows if results is None else results.unionByName(rows)
    if results is not None and results.where("not passed").limit(1).count():
        return results
    written.write.mode("overwrite").parquet(path)
    return results


def newest_version(spark: SparkSession, path: str) -> int:
    """Number of the version that the table's pointer names; 0 if there is none."""
    pointer = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_current")
    fs = pointer.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(pointer):
        return 0
    return max((int(x.getPath().getName()) for x in fs.listStatus(pointer)), default=0)


def current(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest complete version of a table written by :func:`write_version`, or a chosen one."""
    return spark.read.parquet(f"{path}/version={version or newest_version(spark, path)}")


def write_version(df: DataFrame, path: str, gates: Sequence[Callable[[DataFrame], DataFrame]]) -> bool:
    """Write ``df`` as a new version of the table at ``path`` and switch to it if all gates pass on what was written.

    A writer first claims the next number by creating a file of that name, which only one writer can. The switch is the
    creation of one empty pointer file named by the version, so a reader sees the old version or the new one, whole; a
    failure before it leaves the old one in place. Refused versions are removed; their numbers stay unused.
    """
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop(f"{path}/_claims"))
    version = newest_version(spark, path) + 1
    while not _created(fs, hadoop(f"{path}/_claims/{version}")):
        version += 1
    folder = f"{path}/version={version}"
    df.write.mode("overwrite").parquet(folder)
    written = spark.read.parquet(folder)
    if any(gate(written).where("not passed").limit(1).count() for gate in gates):
        fs.delete(hadoop(folder), True)
        return False
    fs.mkdirs(hadoop(f"{path}/_current"))
    return _created(fs, hadoop(f"{path}/_current/{version}"))


def _created(fs, path) -> bool:
    """Create an empty file; False if it is there already."""
    try:
        return bool(fs.createNewFile(path))
    except Exception as e:  # some file systems raise instead
        if fs.exists(path):
            return False
        raise e


def scratch(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, which all executors share. Unset, a local session gets one of its own.

    All paths of an application lie in one folder, which its driver deletes when it ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="pitsports-")
        spark.conf.set("spark.checkpoint.dir", root)
    own = f"{root.rstrip('/')}/tables-{spark.sparkContext.applicationId}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)
    return f"{own}/{uuid.uuid4().hex}"


def settled(df: DataFrame, into: SparkSession | None = None) -> DataFrame:
    """``df`` written below :func:`scratch` and read back, by the session ``into`` if it is given: what is derived from it several
    times is worked out once, and its files outlive executors."""
    path = scratch(df.sparkSession)
    if _passing and _passing[-1] is not None:
        _passing[-1].append(path)
    df.write.parquet(path)
    return (into or df.sparkSession).read.schema(df.schema).parquet(path)


#: Paths settled in the blocks of :func:`passing` that are open, innermost last; None in one of :func:`lasting`.
_passing: list[list[str] | None] = []


@contextmanager
def passing(spark: SparkSession):
    """Tables settled inside this block are deleted when it ends; nothing that reads them may leave it."""
    _passing.append([])
    try:
        yield
    finally:
        hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _passing.pop():
            hadoop(path).getFileSystem(conf).delete(hadoop(path), True)


@contextmanager
def lasting():
    """Tables settled inside this block stay, whatever block of :func:`passing` it lies in."""
    _passing.append(None)
    try:
        yield
    finally:
        _passing.pop()


#: Shuffle files go when the query that wrote them ends.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def tidy(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` whose shuffle files go when the query that wrote them ends, so that several tables
    settled in it one after another take the disk of the largest, not of all."""
    own = same_settings(spark)
    for key, value in TIDY.items():
        own.conf.set(key, value)
    return own


def same_settings(spark: SparkSession) -> SparkSession:
    """A new session with the settings of ``spark``."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key) and own.conf.get(key, None) != value:
            own.conf.set(key, value)
    return own
