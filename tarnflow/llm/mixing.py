"""Mixing sources to target shares of tokens, with capped repetition.

Tokens are counted with a public tokenizer. The documents of a source are cut, in a seeded order,
into blocks of about equal tokens, shard by shard; a document that is longer than a block makes a
block of its own length. Sainte-Lague apportionment (highest quotients
share / (2k + 1)) gives every source an integer number of seats of ``block_tokens`` and splits it
over groups of shards, then over the shards of each group; a source never gets more seats than its
documents times their cap hold. Within a shard, all blocks are taken once for each full round that the
seats pay for, and for the rest blocks in the order of a seeded hash, by the tokens that they really
hold, to within half a block. The driver sees the table of targets and one row for each group, which is
GROUP_SHARDS * SHARD_BLOCKS blocks of a source: shards do not grow with the corpus.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.functions.runtime import Scratch

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Word pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Blocks that a shard is planned to hold, at least, and shards of a group.
SHARD_BLOCKS, GROUP_SHARDS = 64, 1024
#: A shard holds so many mean documents for each of its blocks, so that half a document is little of it.
BLOCK_DOCS = 4

_encoders: dict[str, object] = {}


def _local(path: str) -> str:
    """The vocabulary as the session has sent it to this worker, else the path itself."""
    from pyspark import SparkFiles

    try:
        sent = SparkFiles.get(os.path.basename(path))
    except Exception:  # no session here
        return path
    return sent if os.path.exists(sent) else path


def _encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(_local(path), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("counting", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def with_token_counts(docs: DataFrame, text_col: str, vocabulary: str = DEFAULT_VOCABULARY, out: str = "n_tokens") -> DataFrame:
    """Adds the number of tokens of the whole text; a null or empty text has 0."""

    if os.path.exists(vocabulary):
        docs.sparkSession.sparkContext.addFile(vocabulary)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        enc = _encoder(vocabulary).encode_ordinary
        return pd.Series([len(enc(t)) if t else 0 for t in texts], dtype="int64")

    return docs.withColumn(out, count(F.col(text_col)))


def sainte_lague(weights: Sequence[float], seats: int, caps: Sequence[int] | None = None, redistribute: bool = True) -> np.ndarray:
    """Seats by highest quotients weight / (2k + 1); ties go to the earlier entry.

    The quotients are not enumerated: the divisor is found by bisection and the last seats in order
    of their quotients. ``caps`` bounds the seats of an entry; with ``redistribute`` the seats that a
    capped entry can't take go to the others, else they stay empty. Entries of weight 0 get none.
    """
    w = np.asarray(weights, dtype=float)
    cap = np.full(len(w), np.iinfo(np.int64).max) if caps is None else np.asarray(caps, dtype=np.int64)
    if not redistribute:
        return np.minimum(sainte_lague(w, seats), cap)
    open_seats = int(min(seats, sum(int(c) for c, x in zip(cap, w, strict=True) if x > 0)))
    if not len(w) or open_seats <= 0 or not (w > 0).any():
        return np.zeros(len(w), dtype=np.int64)

    def at(x: float) -> np.ndarray:  # seats whose quotient is above x
        return np.minimum(np.maximum(np.ceil((w / x - 1) / 2), 0), cap).astype(np.int64)

    low, high = w[w > 0].min() / (2.0 * open_seats + 3) / 2, w.max() * 2
    while at(low).sum() < open_seats:
        low /= 2
    for _ in range(200):
        mid = (low + high) / 2
        if at(mid).sum() > open_seats:
            low = mid
        else:
            high = mid
    got = at(high)
    while got.sum() < open_seats:
        q = np.where((got < cap) & (w > 0), w / (2 * got + 1), -1.0)
        got[int(np.argmax(q))] += 1
    return got


def clean_source(c):
    """Source names without surrounding blanks and case."""
    return F.lower(F.regexp_replace(c, r"^[\s\u00a0]+|[\s\u00a0]+$", ""))


def plan_mix(docs: DataFrame, targets: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocabulary: str = DEFAULT_VOCABULARY, block_tokens: int = 4096, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(documents with how often each is used, report per source of ``targets``, a table of few rows).

    targets: source, target_share, max_repeats (a null share or cap counts as 0; of repeated rows of
    a source the greatest values hold). The mix aims at as many tokens as ``docs`` holds in all,
    documents without a source or of other sources included (``aim_tokens``); seats that a short source
    leaves empty are not given to others, so that every other source has its share of the aim, and of the
    smaller mix a little more than that. Documents with a null id can't be
    used but count for the total; documents without tokens are never used.

    Documents: id, source, n_tokens, times (1 to max_repeats). Report: source (as in targets),
    target_share, max_repeats, available_tokens, target_tokens, asked_blocks (seats without the caps),
    quota_blocks (with them), mixed_tokens, aim_tokens, share_of_aim (mixed / aim), actual_share (of all mixed
    tokens), short (the cap times the available tokens is less than the target; only sources whose cap
    takes seats from them, or nearly does, are compared).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    asked = targets.groupBy(F.col("source").alias("t_source")).agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("cap")).filter("t_source is not null").collect()
    asked = sorted(asked, key=lambda r: r["t_source"])
    names = spark.createDataFrame([(r["t_source"],) for r in asked], "t_source string").withColumn("s_key", clean_source("t_source"))
    counted = with_token_counts(docs.select(F.col(id_col).alias("id"), clean_source(F.col(source_col)).alias("s_key"), F.col(text_col).alias("body")), "body", vocabulary)
    base = scratch.put(counted.select("id", "s_key", "n_tokens").join(F.broadcast(names), "s_key", "left").select("id", "t_source", "n_tokens"))
    sums = {r["t_source"]: (int(r["n"] or 0), int(r["u"] or 0), int(r["m"] or 0)) for r in base.groupBy("t_source").agg(F.sum("n_tokens").alias("n"), F.sum(F.when(F.col("id").isNotNull(), F.col("n_tokens"))).alias("u"), F.count(F.when(F.col("id").isNotNull() & (F.col("n_tokens") > 0), 1)).alias("m")).collect()}
    total = sum(n for n, _, _ in sums.values())
    seats = total // block_tokens
    none = (0, 0, 0)
    usable = [sums.get(r["t_source"], none)[1] for r in asked]
    mean = [u / max(1, sums.get(r["t_source"], none)[2]) for r, u in zip(asked, usable, strict=True)]
    shards = [max(1, int(-(-u // (SHARD_BLOCKS * max(block_tokens, BLOCK_DOCS * m))))) for u, m in zip(usable, mean, strict=True)]
    cut = spark.createDataFrame([(r["t_source"], n) for r, n in zip(asked, shards, strict=True)], "t_source string, n_shards long")
    placed = base.filter("t_source is not null and id is not null and n_tokens > 0").join(F.broadcast(cut), "t_source")
    key = F.xxhash64(F.col("id").cast("string"), F.lit(seed))
    placed = placed.withColumn("shard", F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(seed + 1)), "n_shards")).withColumn("at", key)
    upto = F.sum("n_tokens").over(Window.partitionBy("t_source", "shard").orderBy("at", "id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    placed = scratch.put(placed.withColumn("block", F.floor((upto - F.col("n_tokens")) / block_tokens).cast("long")).drop("n_shards", "at"))
    blocks = placed.groupBy("t_source", "shard", "block").agg(F.sum("n_tokens").alias("held"))
    per = scratch.put(blocks.groupBy("t_source", "shard").agg(F.sum("held").alias("held")).withColumn("part", F.floor(F.col("shard") / GROUP_SHARDS)))
    by: dict[str, list] = {}
    for r in per.groupBy("t_source", "part").agg(F.sum("held").alias("held")).orderBy("t_source", "part").collect():
        by.setdefault(r["t_source"], []).append(r)
    caps = [-(-u * int(a["cap"]) // block_tokens) for a, u in zip(asked, usable, strict=True)]
    shares = [float(a["share"]) for a in asked]
    open_seats = int(seats * min(1.0, sum(shares)))
    wanted = sainte_lague(shares, open_seats)
    quota = np.minimum(wanted, np.array(caps, dtype=np.int64))
    rows = []
    for a, q in zip(asked, quota, strict=True):
        own = by.get(a["t_source"], [])
        n = [int(r["held"]) for r in own]
        got = sainte_lague(n, int(q), [-(-x * int(a["cap"]) // block_tokens) for x in n])
        rows += [(a["t_source"], int(r["part"]), int(k), int(a["cap"])) for r, k in zip(own, got, strict=True)]
    groups = spark.createDataFrame(rows, "t_source string, part long, seats long, cap long")

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        """Seats of a group over its shards: full rounds and the tokens of the rest."""
        pdf = pdf.sort_values("shard", ignore_index=True)
        held, cap = pdf["held"].to_numpy(), int(pdf["cap"].iloc[0])
        got = sainte_lague(held, int(pdf["seats"].iloc[0]), -(-held * cap // block_tokens))
        rounds, rest = np.divmod(np.minimum(got * block_tokens, held * cap), held)
        return pd.DataFrame({"t_source": pdf["t_source"], "shard": pdf["shard"], "rounds": rounds, "rest": rest})

    quotas = scratch.put(per.join(F.broadcast(groups), ["t_source", "part"]).groupBy("t_source", "part").applyInPandas(split, "t_source string, shard long, rounds long, rest long"))
    upto = F.sum("held").over(Window.partitionBy("t_source", "shard").orderBy(F.xxhash64("block", "shard", F.lit(seed)), "block").rowsBetween(Window.unboundedPreceding, 0))
    chosen = blocks.join(quotas, ["t_source", "shard"]).withColumn("upto", upto)
    times = F.col("rounds") + (F.col("upto") - F.col("held") / 2 < F.col("rest")).cast("long")
    used = placed.join(chosen.select("t_source", "shard", "block", times.alias("times")).filter("times > 0"), ["t_source", "shard", "block"])
    used = scratch.put(used.select("id", "t_source", "n_tokens", "times"))
    mixed = used.groupBy("t_source").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("mixed_tokens"))
    plan = []
    for a, w, q, c in zip(asked, wanted, quota, caps, strict=True):
        have, target = sums.get(a["t_source"], none)[0], float(a["share"]) * total
        near = c <= w + len(asked) + 1  # seats differ from the exact share by rounding
        plan.append((a["t_source"], float(a["share"]), int(a["cap"]), have, target, int(w), int(q), total, bool(near and int(a["cap"]) * have < target)))
    report = spark.createDataFrame(plan, "source string, target_share double, max_repeats long, available_tokens long, target_tokens double, asked_blocks long, quota_blocks long, aim_tokens long, short boolean")
    report = report.join(mixed.withColumnRenamed("t_source", "source"), "source", "left").fillna(0, ["mixed_tokens"])
    whole = mixed.agg(F.sum("mixed_tokens").alias("mix_total"))
    report = report.withColumn("share_of_aim", F.coalesce(F.try_divide(F.col("mixed_tokens").cast("double"), F.col("aim_tokens")), F.lit(0.0)))
    # one row
    report = report.crossJoin(F.broadcast(whole)).withColumn("actual_share", F.coalesce(F.try_divide(F.col("mixed_tokens").cast("double"), F.col("mix_total")), F.lit(0.0)))
    return used.select(F.col("id").alias(id_col), F.col("t_source").alias(source_col), "n_tokens", "times"), report.drop("mix_total")
