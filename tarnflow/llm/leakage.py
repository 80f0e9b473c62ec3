"""Evaluation texts inside a training corpus, by spaced-seed hashing.

Fixed masks lie over a stream of tokens; a mask keeps some positions and ignores the others, so that a
hash survives substitutions at the ignored positions. There are two streams. Over the words, masks
meet passages with altered words. Over the letters of the words, without any division, masks meet
passages whose words layout divides or joins: a run of the item's words has the same letters then. On
the item's side letter masks start at words only, on the corpus's side at every letter, as any letter
may begin a word of the item there.

Hashes of the evaluation items are joined with those of the corpus. Executors hold a bit table of the
items' hashes (at most 2^28 bits, whatever the items hold) and leave out windows that it rules out,
which loses nothing. Neighbouring windows of a document form one stretch; hits name (stretch, item)
pairs, and only these are verified: by the longest run of equal words, by the longest overlap along a
diagonal that tolerates substitutions, and by the letters of runs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.functions.runtime import BROADCAST_ROWS, Scratch, salted_join
from tarnflow.llm.wordstream import reader_words

#: Masks over words of span 9 and 10, kept positions 1: no longer than the 12 words that make a leak, so
#: a run of 12 equal words meets every mask. An altered word in the run leaves hits on its other side or
#: under an ignored position.
MASKS = ("110110101", "1101001101")
#: Mask over letters. Runs of fewer letters than this have a solid mask over as many letters as words.
LETTER_MASK = "111011011101101110110111"
#: Equal words in a row that make a leak.
MIN_RUN = 12
#: Hits under word masks that make a (stretch, item) pair worth verifying; one hit under a letter mask
#: does too. A run of 12 equal words has four windows under the shorter mask and three under the longer.
MIN_HITS = 3
#: Words on both sides of the outermost windows of a stretch that verification sees at least.
MARGIN = 14
#: Items' words up to which they are sent to the executors for verification, beside BROADCAST_ROWS.
ITEM_WORDS = 1_000_000

_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, dtype=np.uint64), dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


#: Factors of the kept positions: no simple relation between them, as letters are small numbers.
_FACTORS = _mix(_POWERS[:32]) | np.uint64(1)


def letters_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters of all words, where each word starts among them, hash of each word)."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.cumsum(sizes) - sizes
    if not len(codes):
        return codes, starts, np.zeros(0, np.uint64)
    place = (np.arange(len(codes)) - np.repeat(starts, sizes)) % len(_POWERS)
    return codes, starts, _mix(np.add.reduceat(codes * _POWERS[place], starts) + sizes.astype(np.uint64) * _FACTORS[31])


def mask_hashes(tokens: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Hash of every window of the tokens under a mask; none if there are fewer tokens."""
    keep = [k for k, c in enumerate(mask) if c == "1"]
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, (salt + 1) * 0xD1B54A32D192ED03 % 2**64, dtype=np.uint64)
    for slot, k in enumerate(keep):
        h += tokens[k : k + n] * _FACTORS[slot % 29]
    return _mix(h)


class _Sieve:
    """Bits of a bounded table at two places of every hash that the items have."""

    def __init__(self, hashes: DataFrame, n: int):
        self.bits = min(28, max(16, n.bit_length() + 8))
        high = F.expr(f"shiftrightunsigned(h, {64 - self.bits})")
        slots = hashes.select(F.explode(F.array(high, F.col("h").bitwiseAND(F.lit((1 << self.bits) - 1)))).alias("s"))
        words = slots.groupBy(F.expr("shiftrightunsigned(s, 6)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("b"))
        rows = words.toPandas()  # at most 2^28 / 64 rows, whatever the items hold
        table = np.zeros(1 << (self.bits - 6), dtype=np.uint64)
        table[rows["w"].to_numpy(dtype=np.int64)] = rows["b"].to_numpy(dtype=np.int64).view(np.uint64)
        self.table = hashes.sparkSession.sparkContext.broadcast(table)

    def kept(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that the table does not rule out."""
        table = self.table.value
        a = h >> np.uint64(64 - self.bits)
        at = np.flatnonzero((table[a >> np.uint64(6)] >> (a & np.uint64(63))) & np.uint64(1))
        b = h[at] & np.uint64((1 << self.bits) - 1)
        return at[((table[b >> np.uint64(6)] >> (b & np.uint64(63))) & np.uint64(1)).astype(bool)]


def overlaps(a: list[str], b: list[str], tolerance: int = 2, diagonals: Iterable[int] | None = None) -> tuple[int, int]:
    """(longest run of equal words, longest overlap along a diagonal of a and b that begins and ends
    with equal words and has at most ``tolerance`` unequal ones between). ``diagonals`` (position in a
    less position in b) limits the search; all of them are searched without it."""
    if not a or not b:
        return 0, 0
    ids = {w: k for k, w in enumerate(dict.fromkeys(a))}
    x = np.array([ids[w] for w in a])
    y = np.array([ids.get(w, -1) for w in b])
    best = wide = 0
    for shift in range(-len(y) + 1, len(x)) if diagonals is None else diagonals:
        lo, hi = max(0, shift), min(len(x), shift + len(y))
        if hi - lo <= min(wide, best):
            continue
        same = x[lo:hi] == y[lo - shift : hi - shift]
        if not same.any():
            continue
        bad = np.flatnonzero(np.concatenate(([True], ~same, [True])))
        best = max(best, int(np.diff(bad).max()) - 1)
        for k in range(len(bad) - 1):
            end = bad[min(k + tolerance + 1, len(bad) - 1)]
            if end - bad[k] - 1 <= wide:
                continue
            hits = np.flatnonzero(same[bad[k] : max(bad[k], end - 1)])
            if len(hits):
                wide = max(wide, int(hits[-1] - hits[0]) + 1)
    return best, wide


def _rejoined(stretch: list[str], item: list[str], run: int, at: Iterable[int]) -> bool:
    """One of the runs of the item's words that start at ``at`` occurs though some of its words are
    divided or joined in the text."""
    text, here, starts, ends = "".join(stretch), 0, set(), set()
    for w in stretch:
        starts.add(here)
        here += len(w)
        ends.add(here)
    for k in at:
        if k + run > len(item):
            continue
        s = "".join(item[k : k + run])
        p = text.find(s)
        while p >= 0:
            if p in starts and p + len(s) in ends:
                return True
            p = text.find(s, p + 1)
    return False


def _item_seeds(words: list[str], masks: tuple[str, ...], min_run: int) -> Iterator[tuple[int, int, bool]]:
    """(hash, word it starts at, over letters) of an item. Every run of ``min_run`` words has a letter
    mask at its first word that ends inside the run."""
    codes, starts, ids = letters_of(words)
    for m, mask in enumerate(masks):
        yield from ((h, p, False) for p, h in enumerate(mask_hashes(ids, mask, m).view(np.int64).tolist()))
    ends = np.append(starts, len(codes))
    span, short = len(LETTER_MASK), "1" * min_run
    long_h, short_h = mask_hashes(codes, LETTER_MASK, 100).view(np.int64), mask_hashes(codes, short, 101).view(np.int64)
    for p in range(len(words) - min_run + 1):
        letters = int(ends[p + min_run] - ends[p])
        yield int(long_h[starts[p]] if letters >= span else short_h[starts[p]]), p, True


def _stretches(batches: Iterator[pd.DataFrame], sieve: _Sieve, masks: tuple[str, ...], reach: int, short: int) -> Iterator[pd.DataFrame]:
    """Stretches of documents with windows that the items may have. ``reach``: letters of the longest run
    of an item; ``short``: letters of the solid mask, 0 if no item needs it."""
    near = max(map(len, masks))
    for pdf in batches:
        out = []
        for doc, text in zip(pdf["k"], pdf["t"], strict=True):
            words = reader_words(text)
            if not words:
                continue
            codes, starts, ids = letters_of(words)
            hashes, first, last = [], [], []
            for m, mask in enumerate(masks):
                h = mask_hashes(ids, mask, m)
                at = sieve.kept(h)
                hashes.append(h[at])
                first.append(at)
                last.append(at + len(mask) - 1)
            for salt, mask in ((100, LETTER_MASK), (101, "1" * short)):
                if mask:
                    h = mask_hashes(codes, mask, salt)
                    at = sieve.kept(h)
                    hashes.append(h[at])
                    first.append(np.searchsorted(starts, at, "right") - 1)
                    last.append(np.searchsorted(starts, at + len(mask) - 1, "right") - 1)
            h, a, b = (np.concatenate(x) for x in (hashes, first, last))
            if not len(h):
                continue
            order = np.argsort(a, kind="stable")
            h, a, b = h[order].view(np.int64), a[order], b[order]
            far = np.flatnonzero(a[1:] - np.maximum.accumulate(b)[:-1] > near) + 1
            bounds = [0, *far.tolist(), len(a)]
            n = 0
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                # a long group is cut every 2,000 words; windows at a cut are whole through the margins
                cuts = [lo, *(lo + np.flatnonzero(np.diff((a[lo:hi] - a[lo]) // 2000)) + 1).tolist(), hi]
                for p, q in zip(cuts, cuts[1:], strict=False):
                    w, e = int(a[p]), int(b[p:q].max())
                    left = max(0, min(w - MARGIN, int(np.searchsorted(starts, starts[w] - reach, "right")) - 1))
                    right = max(e + MARGIN, int(np.searchsorted(starts, starts[e] + len(words[e]) + reach, "left"))) + 1
                    out.append((doc, n, h[p:q].tolist(), (a[p:q] - left).tolist(), words[left:right]))
                    n += 1
        yield pd.DataFrame(out, columns=["k", "stretch", "hashes", "at", "words"])


def find_leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", item_text: str = "text", masks: tuple[str, ...] = MASKS, min_run: int = MIN_RUN, tolerance: int = 2, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Overlaps of all documents with all items: doc_id, item_id, run, overlap, exact.

    ``run`` is the longest run of equal words, ``overlap`` the longest one with at most ``tolerance``
    substituted words inside, ``exact`` whether ``min_run`` consecutive words of the item occur
    (words that layout divides or joins count as equal). One row for each pair that is exact or whose
    overlap has at least ``min_run`` words. Null
    texts and ids have no rows; rows that repeat an id are searched one by one and reported once.
    Texts shorter than a mask can't be hit: ``min_run`` must be at least the longest mask.
    """
    if min_run < max(map(len, masks)):
        raise ValueError("min_run must be at least the span of every mask")
    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")
    i_kind, d_kind = dict(items.dtypes)[item_id], dict(docs.dtypes)[doc_id]

    def item_rows(batches):
        for pdf in batches:
            rows = []
            for item, t in zip(pdf["i"], pdf["t"], strict=True):
                words = reader_words(t)
                letters = [sum(map(len, words[p : p + min_run])) for p in range(len(words) - min_run + 1)]
                rows.append((item, words, max(letters, default=0), any(x < len(LETTER_MASK) for x in letters)))
            yield pd.DataFrame(rows, columns=["item", "item_words", "reach", "short"])

    raw = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).filter("i is not null and t is not null")
    item_words = scratch.put(raw.mapInPandas(item_rows, f"item {i_kind}, item_words array<string>, reach int, short boolean"))
    n_words, reach, short = item_words.agg(F.sum(F.size("item_words")), F.max("reach"), F.max("short")).first()

    def item_hashes(batches):
        for pdf in batches:
            out = {(h, item, p, over) for item, ws in zip(pdf["item"], pdf["item_words"], strict=True) for h, p, over in _item_seeds(list(ws), masks, min_run)}
            yield pd.DataFrame(list(out), columns=["h", "item", "item_at", "letters"])

    hashes = scratch.put(item_words.select("item", "item_words").mapInPandas(item_hashes, f"h long, item {i_kind}, item_at int, letters boolean").distinct())
    n_hashes = hashes.count()
    sieve = _Sieve(hashes, n_hashes)
    source = docs.select(F.col(doc_id).alias("k"), F.col(text_col).alias("t")).filter("k is not null and t is not null")
    stretches = source.mapInPandas(lambda b: _stretches(b, sieve, masks, reach or 0, min_run if short else 0), f"k {d_kind}, stretch long, hashes array<long>, at array<int>, words array<string>")
    stretches = scratch.put(stretches.withColumn("sid", F.monotonically_increasing_id()))
    windows = stretches.select("sid", F.explode(F.arrays_zip("hashes", "at")).alias("z")).select("sid", F.col("z.hashes").alias("h"), F.col("z.at").alias("at"))
    small = n_hashes <= broadcast_rows
    # a window that many texts share is a hot key
    joined = windows.join(F.broadcast(hashes), "h") if small else salted_join(windows, hashes, ["h"], ["sid", "at"], scratch)
    # hits of a pair by diagonal: at most as many as a stretch and an item have words
    run_at = F.collect_set(F.when(F.col("letters"), F.col("item_at"))).alias("runs")
    met = joined.groupBy("sid", "item").agg(F.sum(F.when(F.col("letters"), MIN_HITS).otherwise(1)).alias("n"), F.collect_set(F.col("at") - F.col("item_at")).alias("diagonals"), run_at)
    hits = scratch.put(met.filter(F.col("n") >= MIN_HITS).drop("n"))
    pairs = hits.join(stretches.select("sid", "k", "words"), "sid")
    bare = item_words.select("item", "item_words")
    # so is an item that leaked into many documents
    pairs = pairs.join(F.broadcast(bare), "item") if small and (n_words or 0) <= ITEM_WORDS else salted_join(pairs, bare, ["item"], ["sid"], scratch)

    def verify(batches):
        for pdf in batches:
            out = []
            for k, item, a, b, d, at in zip(pdf["k"], pdf["item"], pdf["words"], pdf["item_words"], pdf["diagonals"], pdf["runs"], strict=True):
                a, b = list(a), list(b)
                run, wide = overlaps(a, b, tolerance, d)
                out.append((k, item, run, wide, run >= min_run or _rejoined(a, b, min_run, at)))
            yield pd.DataFrame(out, columns=["k", "item", "run", "overlap", "exact"])

    checked = pairs.select("k", "item", "words", "item_words", "diagonals", "runs").mapInPandas(verify, f"k {d_kind}, item {i_kind}, run long, overlap long, exact boolean")
    best = checked.groupBy("k", "item").agg(F.max("run").alias("run"), F.max("overlap").alias("overlap"), F.max("exact").alias("exact"))
    best = best.filter(F.col("exact") | (F.col("overlap") >= min_run))
    return best.select(F.col("k").alias(doc_id), F.col("item").alias(item_id), "run", "overlap", "exact")
