"""Changes between consecutive full snapshots.

A bucketed key-to-hash index stands for the last snapshot. The rows of the next one probe it by key
and hash alone, bucket against bucket, without an exchange of either side; only keys whose hash differs
fetch the old values and are compared by them. Where many snapshots come in one table they are
bucketed by key together, so that bucket n of every snapshot is the index that bucket n of the next
one probes, and all steps from one snapshot to the next run at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.functions.runtime import BROADCAST_ROWS, Scratch, bucket_count, co_partitioned, plain_double, salted_join, same_number

ADDED, REMOVED, CHANGED = "added", "removed", "changed"


def _hashes(df: DataFrame, values: list[str]) -> DataFrame:
    """Adds h and g, 64 and 32 bits over the canonical values; nulls keep their place, as the hashes
    themselves skip them. Equal hashes are taken for equal values."""
    kinds = dict(df.dtypes)
    cols = []
    for v in values:
        c = F.col(f"v_{v}")
        cols += [c.isNull(), plain_double(c) if kinds[f"v_{v}"] in ("double", "float") else c]
    return df.withColumns({"h": F.xxhash64(*cols), "g": F.hash(*cols)})


def _one_row(rows: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """One row for each key, of several the one with the largest values."""
    order = [F.col(f"v_{v}").desc_nulls_last() for v in values]
    w = Window.partitionBy(*key).orderBy(*order) if order else Window.partitionBy(*key).orderBy(F.lit(0))
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def _moved():
    return (F.col("h") != F.col("old_h")) | (F.col("g") != F.col("old_g"))


def _differs(kinds: dict[str, str], values: list[str], tolerance: float):
    out = F.lit(False)
    for v in values:
        a, b = F.col(f"v_{v}"), F.col(f"o_{v}")
        if kinds[f"v_{v}"] in ("double", "float"):
            same = same_number(a.cast("double"), b.cast("double"), tolerance)
        else:
            same = a.eqNullSafe(b)
        out = out | ~same
    return out


def snapshot_changes(
    df: DataFrame, *, series: list[str], version: str, key: str, values: list[str],
    delivery: str | None = None, tolerance: float = 0.0,
) -> DataFrame:
    """Added, removed and changed keys of every snapshot against the one before it.

    A snapshot is (series..., version). Its highest delivery replaces the lower ones as a whole;
    rows with a null key do not count, but their snapshot exists. Repeated rows of a key count once
    (should they differ, the row with the largest values holds). Numbers at most ``tolerance`` apart
    are equal, null equals null only, NaN equals NaN only. Rows with a null version or a null in
    series belong to no snapshot. The first snapshot of a series reports nothing. Other columns are
    ignored. Result: series..., version, key, change_kind.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "snapshots")
    d = F.col(delivery).cast("long") if delivery else F.lit(0).cast("long")
    rows = df.select(
        *[F.col(c).alias(f"s_{c}") for c in series], F.col(version).alias("ver"), F.col(key).alias("k"),
        F.coalesce(d, F.lit(-(2**63))).alias("dlv"), *[F.col(v).alias(f"v_{v}") for v in values],
    )
    s = [f"s_{c}" for c in series]
    for c in [*s, "ver"]:
        rows = rows.filter(F.col(c).isNotNull())
    # one row a snapshot: a hot series has no more rows here than it has snapshots
    heads = rows.groupBy(*s, "ver").agg(F.max("dlv").alias("dlv"), F.count("*").alias("n"))
    order = Window.partitionBy(*s).orderBy("ver")
    heads = scratch.put(heads.withColumns({"next_ver": F.lead("ver").over(order), "first": F.row_number().over(order) == 1}))
    n_heads, n_rows = heads.agg(F.count("*"), F.sum("n")).first()
    buckets, on = bucket_count(spark, n_rows or 0), [*s, "k"]
    top, known = heads.drop("n"), rows.filter(F.col("k").isNotNull())
    live = known.join(F.broadcast(top), [*s, "ver", "dlv"]) if n_heads <= BROADCAST_ROWS else salted_join(known, top, [*s, "ver", "dlv"], ["k"], scratch)
    with co_partitioned(spark):
        # one exchange and one sort by key: what follows stays inside the buckets
        flat = _one_row(live.repartition(buckets, *on), [*on, "ver"], values).drop("dlv")
        kinds = dict(flat.dtypes)
        held = scratch.put_bucketed(_hashes(flat, values), on, buckets, [*on, "ver"], placed=True)
        index = held.select(*on, "ver", "first", "h", "g")
        old = held.filter("next_ver is not null").select(*on, F.col("next_ver").alias("ver"), F.col("h").alias("old_h"), F.col("g").alias("old_g"))
        probe = index.join(old, [*on, "ver"], "full")
        # rows without an old hash are new (unless the snapshot is the first), rows without a new one are
        # gone, equal hashes are settled here
        probe = probe.filter(F.col("h").isNull() | (F.col("old_h").isNull() & ~F.col("first")) | _moved())
        kind = F.when(F.col("h").isNull(), REMOVED).when(F.col("old_h").isNull(), ADDED)
        probe = scratch.put_bucketed(probe.select(*on, "ver", kind.alias("change_kind")), on, buckets, [*on, "ver"], placed=True)
        asked = probe.filter("change_kind is null").select(*on, "ver")
        now = held.select(*on, "ver", *[f"v_{v}" for v in values])
        before = held.filter("next_ver is not null").select(*on, F.col("next_ver").alias("ver"), *[F.col(f"v_{v}").alias(f"o_{v}") for v in values])
        fetched = asked.join(now, [*on, "ver"]).join(before, [*on, "ver"]).filter(_differs(kinds, values, tolerance))
        changed = scratch.put(fetched.select(*on, "ver", F.lit(CHANGED).alias("change_kind")))
    out = probe.filter("change_kind is not null").unionByName(changed)
    return out.select(*[F.col(f"s_{c}").alias(c) for c in series], F.col("ver").alias(version), F.col("k").alias(key), "change_kind")


class SnapshotIndex:
    """The same for snapshots that arrive one by one.

    ``advance`` takes the next snapshot, returns its changes and swaps the index. The state is a
    table of (key, hash, values) below the shared folder, bucketed by key; the probe reads key and hash
    only. ``buckets`` is set by the size of the first snapshot unless given.
    """

    def __init__(self, spark, key: str, values: list[str], tolerance: float = 0.0, buckets: int | None = None):
        self.scratch = Scratch(spark, "snapshot-index")
        self.key, self.values, self.tolerance, self.buckets = key, list(values), tolerance, buckets
        self.state: DataFrame | None = None

    def advance(self, snapshot: DataFrame) -> DataFrame:
        """Changes (key, change_kind) against the last snapshot; none for the first one."""
        rows = snapshot.select(F.col(self.key).alias("k"), *[F.col(v).alias(f"v_{v}") for v in self.values]).filter("k is not null")
        if self.buckets is None:
            self.buckets = bucket_count(snapshot.sparkSession, rows.count())
        flat = _one_row(rows.repartition(self.buckets, "k"), ["k"], self.values)
        kinds = dict(flat.dtypes)
        new = self.scratch.put_bucketed(_hashes(flat, self.values), ["k"], self.buckets, placed=True)
        old, self.state = self.state, new
        if old is None:
            return new.limit(0).select(F.col("k").alias(self.key), F.lit(ADDED).alias("change_kind"))
        probe = new.select("k", "h", "g").join(old.select("k", F.col("h").alias("old_h"), F.col("g").alias("old_g")), "k", "full")
        kind = F.when(F.col("h").isNull(), REMOVED).when(F.col("old_h").isNull(), ADDED)
        probe = probe.filter(F.col("h").isNull() | F.col("old_h").isNull() | _moved()).select("k", kind.alias("change_kind"))
        probe = self.scratch.put_bucketed(probe, ["k"], self.buckets, placed=True)
        asked = probe.filter("change_kind is null").select("k")
        fetched = asked.join(new.drop("h", "g"), "k").join(old.select("k", *[F.col(f"v_{v}").alias(f"o_{v}") for v in self.values]), "k")
        changed = fetched.filter(_differs(kinds, self.values, self.tolerance)).select("k", F.lit(CHANGED).alias("change_kind"))
        out = self.scratch.put(probe.filter("change_kind is not null").unionByName(changed).select(F.col("k").alias(self.key), "change_kind"))
        self.scratch.drop(old, probe)
        return out
