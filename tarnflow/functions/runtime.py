"""Session helpers shared by all operators: scratch tables, size-checked broadcast, canonical numbers.

Iterative operators cut their lineage by writing each round as a Parquet table below the shared
folder named by ``spark.checkpoint.dir``. A table survives the loss of executors (all of them see
the folder), is written once (``checkpoint()`` computes its input twice) and keeps column pruning.
"""

from __future__ import annotations

import atexit
import contextlib
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side is sent to every executor. Callers count the side first; beyond this
#: they take a shuffle join instead.
BROADCAST_ROWS = 200_000

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode where it is unset."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    named = named or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if named:
        return str(named).rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own_dirs:
        _own_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="tarnflow-")
    return _own_dirs[sc.applicationId]


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers of the session, once, wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parent.parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path(root.name) / f.relative_to(root))
    # through the file system of the shared folder, which need not be a local one
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{sc.applicationId}/{root.name}.zip")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(path.toString())


class Scratch:
    """Tables of one operator run below the shared folder.

    ``put`` writes a DataFrame and returns a DataFrame over the written files. ``drop`` removes a
    table that no later plan reads. What is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tarnflow-{label}-{uuid.uuid4().hex[:12]}"
        self._path_of: dict[int, str] = {}
        self._n = 0
        atexit.register(self._remove, self.root)

    def put(self, df: DataFrame, partition_by: list[str] | None = None, rebalance: bool = False) -> DataFrame:
        """``rebalance`` evens out the files of a round that joins many parts: tiny partitions are
        merged and large ones split, at the cost of one exchange."""
        self._n += 1
        path = f"{self.root}/{self._n:04d}"
        writer = (df.hint("rebalance") if rebalance else df).write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._path_of[id(out)] = path
        out._scratch_path = path  # keeps the id unique for as long as the frame lives
        return out

    def put_bucketed(self, df: DataFrame, keys: list[str], buckets: int, sort: list[str] | None = None, placed: bool = False) -> DataFrame:
        """The same as a table in ``buckets`` buckets by ``keys``, sorted inside them: joins and groups by
        these keys need no exchange of it. ``placed``: the rows of a bucket are in one task already."""
        self._n += 1
        path, name = f"{self.root}/{self._n:04d}", f"tarnflow_{self.root[-12:]}_{self._n}"
        writer = (df if placed else df.repartition(buckets, *keys)).write.format("parquet").mode("overwrite").option("compression", "zstd").option("path", path)
        writer.bucketBy(buckets, *keys).sortBy(*(sort or keys)).saveAsTable(name)
        out = self.spark.table(name)
        out._scratch_path, out._scratch_table = path, name
        atexit.register(self._forget, name)
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if name := getattr(df, "_scratch_table", None):
                self._forget(name)
            path = getattr(df, "_scratch_path", None)
            if path:
                self._remove(path)

    def _forget(self, name: str) -> None:
        try:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        except Exception:  # the session has ended, and its own catalog with it
            pass

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended: nothing can be removed any more
            pass


def bucket_count(spark: SparkSession, rows: int, per_task: int = 20_000, per_bucket: int = 2_000_000) -> int:
    """Buckets for a table of so many rows: as many as there are cores as long as they are small, and
    beyond that by size."""
    return max(1, min(spark.sparkContext.defaultParallelism, rows // per_task), -(-rows // per_bucket))


@contextlib.contextmanager
def co_partitioned(spark: SparkSession):
    """While it lasts, joins use sides that are bucketed by a part of the join keys as they are."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint when the counted rows are at most ``limit``; else the frame as it is."""
    return F.broadcast(df) if rows <= limit else df


def salted_join(rows: DataFrame, state: DataFrame, on: list[str], spread: list[str], scratch: Scratch, parts: int = 256) -> DataFrame:
    """Inner join of ``rows``, in which a few keys may hold most rows, with ``state``.

    The rows of each key are counted first. A key with more than one part in ``parts`` of all rows (so
    fewer than ``parts`` keys, which bounds what is broadcast) is spread by ``spread`` over as many
    salts as its share asks for; its rows of ``state`` are repeated for them. Other keys join as they
    are. Null keys join nothing.
    """
    counted = scratch.put(rows.groupBy(*on).agg(F.count("*").alias("_n")))
    total = counted.agg(F.sum("_n")).first()[0] or 0
    salts = F.least(F.lit(parts), F.ceil(F.col("_n") * F.lit(parts) / F.lit(max(1, total)))).cast("long")
    hot = F.broadcast(counted.filter(F.col("_n") * parts > F.lit(total)).select(*on, salts.alias("_salts")))
    n = F.coalesce("_salts", F.lit(1).cast("long"))
    a = rows.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), n)).drop("_salts")
    b = state.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).drop("_salts")
    return a.join(b, [*on, "_salt"]).drop("_salt")


def plain_double(c: Column) -> Column:
    """Signed zeros become +0.0, every NaN the one NaN; null stays null."""
    d = c.cast("double")
    return F.when(F.isnan(d), F.lit(float("nan"))).otherwise(d + F.lit(0.0))


def same_number(a: Column, b: Column, tolerance: float) -> Column:
    """True if both are null, both NaN, equal, or at most ``tolerance`` apart. Never null."""
    # one part in 10^12 above the tolerance takes up the rounding of the subtraction itself
    # (bounded, so that nothing finite is near an infinity)
    near = F.abs(a - b) <= F.lit(tolerance) + F.lit(1e-12) * F.least(F.greatest(F.lit(1.0), F.abs(a)), F.lit(1e9))
    return (
        F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull())
        .when(F.isnan(a) | F.isnan(b), F.isnan(a) & F.isnan(b))
        .when(a == b, F.lit(True))
        .otherwise(F.coalesce(near, F.lit(False)))
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
