"""Per-key results that no hot key slows down: distinct rows, extremes, exact quantiles, frequent keys.

Rows become distinct by their full identity (never by the key alone), counts and extremes are
combined map-side, and order statistics come by selection over histograms: every round counts the values
of each key in bins, keeps the bins that hold a wanted rank together with the least and greatest value
seen in them, and goes on with the rows of these bins only, until a bin holds one value. The counts of a
bin add up across tasks, so the values of a hot key are never gathered anywhere. Keys that hold a given
share of all rows come by the same selection over the keys themselves: in the order of keys such a key
covers so many ranks in a row that one of the evenly spaced ranks falls into it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.functions.runtime import BROADCAST_ROWS, Scratch, salted_join


def distinct_items(df: DataFrame, key: str, item: Sequence[str], value: str | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """One row for each (item..., key), with the least value and the least of each carried column.

    Columns: ident (struct of the item columns), key, value, carry..., lead. ``lead`` marks one row
    of each item, whatever keys it has, so that a sum over it counts the items.
    """
    v = F.col(value).cast("double") if value else F.lit(None).cast("double")
    cols = df.select(*[F.col(c).alias(f"id_{n}") for n, c in enumerate(item)], F.col(key).cast("long").alias("key"), v.alias("value"), *[F.col(c).alias(f"c_{c}") for c in carry])
    ids = [f"id_{n}" for n in range(len(item))]
    # one exchange by the item: the grouping by (item, key) and the window by item both use it
    one = cols.repartition(*[F.col(c) for c in ids]).groupBy(*ids, "key").agg(F.min("value").alias("value"), *[F.min(f"c_{c}").alias(f"c_{c}") for c in carry])
    if key in item:  # an item has one key then
        return one.select(F.struct(*ids).alias("ident"), "key", "value", *[F.col(f"c_{c}").alias(c) for c in carry], F.lit(True).alias("lead"))
    first = F.row_number().over(Window.partitionBy(*ids).orderBy("key")) == 1
    return one.select(F.struct(*ids).alias("ident"), "key", "value", *[F.col(f"c_{c}").alias(c) for c in carry], first.alias("lead"))


def _bin(bins: int):
    """Number of the bin of ``value`` in the finite range lo..hi; infinities have bins of their own.
    Ascending in value, and lo and hi never share a bin unless they are equal."""
    v, lo, hi = (F.col(c).cast("double") for c in ("value", "lo", "hi"))
    inner = F.least(F.floor((v / 2 - lo / 2) / (hi / 2 - lo / 2) * bins).cast("int"), F.lit(bins - 1))
    return (
        F.when(v == float("inf"), F.lit(bins))
        .when(v == float("-inf"), F.lit(-1))
        .when(F.col("lo") >= F.col("hi"), F.lit(0))
        .when(lo >= hi, (F.col("value") > F.col("lo")).cast("int"))  # integers that one double stands for
        .otherwise(inner)
    )


def select_ranks(rows: DataFrame, ranks: DataFrame, bins: int = 64, scratch: Scratch | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(key, q, value, m): the value of each rank (from 1, ascending) among the rows of its key, and how
    many of the key's rows have it. rows: key, value, neither null nor NaN; ranks: key, q, rank."""
    scratch = scratch or Scratch(rows.sparkSession, "ranks")
    # signed zeros are one value; only doubles have infinities, which no range takes in
    double = dict(rows.dtypes)["value"] == "double"
    value = F.col("value") + F.lit(0.0) if double else F.col("value")
    rows = rows.select("key", value.alias("value"))
    finite = F.when(F.abs("value") != float("inf"), F.col("value")) if double else F.col("value")
    zero = F.lit(0).cast(dict(rows.dtypes)["value"])
    base = scratch.put(rows.groupBy("key").agg(F.coalesce(F.min(finite), zero).alias("lo"), F.coalesce(F.max(finite), zero).alias("hi")))
    n = base.count()
    state = scratch.put(ranks.join(base, "key"))
    live = rows.join(F.broadcast(base), "key") if n <= broadcast_rows else salted_join(rows, base, ["key"], ["value"], scratch)
    at, done = ["key", "lo", "hi"], []
    while True:
        binned = live.withColumn("bin", _bin(bins))
        # at most bins + 2 rows for each range of a key here, whatever the key holds
        counted = binned.groupBy(*at, "bin").agg(F.count("*").alias("m"), F.min("value").alias("b_lo"), F.max("value").alias("b_hi"))
        upto = F.sum("m").over(Window.partitionBy(*at).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        near = counted.withColumn("before", upto - F.col("m")).join(state, at).filter((F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("before") + F.col("m")))
        hit = scratch.put(near.select("key", "lo", "hi", "bin", "b_lo", "b_hi", "m", "q", (F.col("rank") - F.col("before")).alias("rank")))
        done.append(hit.filter("b_lo = b_hi").select("key", "q", F.col("b_lo").alias("value"), "m"))
        left = hit.filter("b_lo < b_hi")
        state = left.select("key", "q", "rank", F.col("b_lo").alias("lo"), F.col("b_hi").alias("hi"))
        kept = scratch.put(left.select(*at, "bin", "b_lo", "b_hi").distinct())
        n = kept.count()
        if not n:
            break
        on = [*at, "bin"]
        part = binned.join(F.broadcast(kept), on) if n <= broadcast_rows else salted_join(binned, kept, on, ["value"], scratch)
        live = scratch.put(part.select("key", "value", F.col("b_lo").alias("lo"), F.col("b_hi").alias("hi")))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def exact_quantiles(items: DataFrame, quantiles: Sequence[float], bins: int = 64, scratch: Scratch | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Exact lower quantiles of ``value`` for each key: (key, q, quantile).

    Quantile q of n values is the value of rank max(1, ceil(q * n)) in ascending order. Null and NaN
    values and rows with a null key do not count; a key without values has no row. Infinite values
    are ordered as numbers. Ties need no care, as equal values share a bin at every width.
    """
    rows = items.select("key", F.col("value").cast("double").alias("value")).filter("key is not null and value is not null and not isnan(value)")
    n = rows.groupBy("key").agg(F.count("*").alias("n"))
    asked = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.greatest(F.lit(1), F.ceil(F.lit(float(q)) * F.col("n"))).cast("long").alias("rank")) for q in quantiles])
    ranks = n.select("key", F.explode(asked).alias("r")).select("key", "r.q", "r.rank")
    return select_ranks(rows, ranks, bins, scratch, broadcast_rows).select("key", "q", F.col("value").alias("quantile"))


def frequent_keys(df: DataFrame, key: str, item: Sequence[str], least_share: tuple[int, int], *, bins: int = 4096, scratch: Scratch | None = None) -> DataFrame:
    """(key, n_items): keys that hold at least least_share[0] / least_share[1] of all distinct items.

    Items are distinct by ``item`` (nulls in it are values of their own); rows with a null key count for
    the total only, an item with several keys counts once in the total and once for each key. With n
    items a wanted key has at least s = ceil(n * share) of them, so that in the order of keys one of the
    ranks s, 2s, ... falls into it: these ranks are selected exactly, and the histograms also tell how
    many items their keys have, by which they are checked. An empty table gives no rows.
    """
    scratch = scratch or Scratch(df.sparkSession, "frequent")
    num, den = least_share
    items = scratch.put(distinct_items(df, key, item).select("key", "lead", F.lit(0).alias("one")))
    total, n = items.agg(F.sum(F.col("lead").cast("long")), F.count("key")).first()
    total, step = int(total or 0), max(1, -(-int(total or 0) * num // den))
    if n < step:
        return df.sparkSession.createDataFrame([], "key long, n_items long")
    ranks = scratch.put(df.sparkSession.range(step, int(n) + 1, step).select(F.lit(0).alias("key"), F.col("id").alias("rank"), F.col("id").alias("q")))
    got = select_ranks(items.filter("key is not null").select(F.col("one").alias("key"), F.col("key").alias("value")), ranks, bins, scratch)
    return got.select(F.col("value").alias("key"), F.col("m").alias("n_items")).distinct().filter(F.col("n_items") * den >= F.lit(total).cast("long") * num)


def key_profile(df: DataFrame, key: str, item: Sequence[str], value: str | None = None, *, extent: Sequence[str] = (), quantiles: Sequence[float] = (0.5,), bins: int = 64) -> tuple[DataFrame, int]:
    """Per-key results and the number of distinct items of the whole table.

    Result: key, n_items, n_values, low, high, min_/max_ of each extent column, and q_<percent> for
    each quantile. Items are distinct by ``item`` (nulls in it are values of their own); an item
    delivered repeatedly counts once, with its least value. NaN values do not count. Rows with a
    null key count for the number of items only. An empty table gives no rows and 0.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "profile")
    rows = scratch.put(distinct_items(df, key, item, value, extent))
    real = F.when(~F.isnan("value"), F.col("value"))
    aggs = [F.count("*").alias("n_items"), F.count(real).alias("n_values"), F.min(real).alias("low"), F.max(real).alias("high")]
    for c in extent:
        aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    counted = scratch.put(rows.groupBy("key").agg(*aggs, F.sum(F.col("lead").cast("long")).alias("leads")))
    total = counted.agg(F.sum("leads")).first()[0] or 0
    out = counted.filter("key is not null").drop("leads")
    if quantiles:
        qs = exact_quantiles(rows, quantiles, bins, scratch)
        wide = qs.groupBy("key").agg(*[F.max(F.when(F.col("q") == float(q), F.col("quantile"))).alias(f"q_{round(q * 100)}") for q in quantiles])
        out = out.join(wide, "key", "left")
    return out, int(total)
