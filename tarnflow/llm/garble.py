"""Texts that were read with another encoding than they were written in.

A wrong code page is a substitution cipher on the bytes above 127: every byte (or, for text written
in UTF-8, every byte sequence) stands for a letter it does not mean. A source has its own ciphers, and a
document may be enciphered as a whole or in places only. What the maps between pairs of public code pages
do, UTF-8 once or twice among them, serves as starting points; what none of them explains is learned
without a start.

Expectation-maximization has three stages. The first runs over documents and finds those that were
read with one wrong page as a whole. E-step: the evidence of all distinct runs of a document for
every pair of pages, with the weights that its source gives the keys; a document takes the best key
whose odds suffice. M-step: bigrams are counted again from what the documents are now taken to mean,
and so are the weights of the keys per source. Before the first round sources of many rows count no
more than an average one, and odd runs (a symbol or capital inside a word) little, so that one large
damaged source does not become the language. The second stage runs over the distinct runs of
non-ASCII characters of the corpus so corrected, each with the character before and after it:
posterior of every reading with constant prior odds, bigrams counted again. The third stage learns a
map from symbols to letters for each source, from the documents that have one swapped page (starting from
the map of that pair of pages) and from those whose runs hardly occur in the language and which no pair
explains (starting from nothing): E-step, forward and backward over a run, the posterior of the letter
behind each symbol under the bigrams; M-step, the map's weights from these posteriors. Symbols are
characters, or whole runs where a letter became a sequence of characters.

A document is judged by its own runs under the learned bigrams, key weights and maps of its source, and
restored by ``translate`` with its map. A corpus that is damaged by one page throughout has no clean
source to learn from and can't be told from a language.

Texts are read once for all this; everything else works on their runs. The bigram table is over the
characters of the code pages and one class for each 256 other characters, whatever the corpus holds.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.functions.runtime import BROADCAST_ROWS, Scratch

RUN = re.compile("[^\x00-\x7f]+")
#: Code pages that texts are read or written in, by their public names.
CODE_PAGES = ("cp1252", "latin-1", "iso8859-15", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "iso8859-5", "mac_roman", "mac_cyrillic", "cp437", "cp850", "cp852")
#: Space-like and invisible characters: a run of them alone is layout and no evidence for a code page.
LAYOUT = frozenset("\u00a0\u00ad\u2007\u2008\u2009\u200a\u200b\u202f\ufeff")
LOST = "\ufffd"
ITERATIONS = 4
#: Pseudo-count of the bigram model.
ALPHA = 2.0
#: Prior log-odds of a key against the plain reading, for UTF-8 read as a code page and for a swap of
#: two code pages.
PRIOR = {True: -3.0, False: -6.0}
#: Evidence (natural log of a likelihood ratio) that makes a document damaged: of one run and of all
#: its distinct runs under UTF-8 keys, of one run and of a whole line under the others.
UTF8_RUN, UTF8_ALL, PAGE_RUN, PAGE_LINE = 3.0, 5.0, 5.0, 10.0
#: Log-odds, prior included, that make a document or line damaged by a swap of pages.
PAGE_ODDS = PAGE_LINE + PRIOR[False]
#: Rounds over documents; documents that the prior of a source's key weights counts as; weight of odd
#: runs in the first bigrams; runs whose evidence a worker keeps.
ROUNDS, PSEUDO_DOCS, ODD_WEIGHT, KEPT_RUNS = 3, 10.0, 0.1, 50_000
#: Charge for a run in a line that the key could not have produced.
IMPOSSIBLE = 4.0
#: Mean log P(b | a) / P(b) over the bigrams of a document's runs below which it does not look like the
#: language. Clean documents have 1 and more.
POOR_FIT = 0.0
#: Rounds of the third stage, least weight of a letter, occurrences of a symbol that give it a letter, and
#: distinct mapped symbols in a document that make it damaged.
CIPHER_ROUNDS, LEAST_WEIGHT, LEAST_SEEN, LEAST_SYMBOLS = 8, 1e-3, 3, 3
#: Another letter than the starting map's needs so many times its counts, and so many counts more.
START_FACTOR, START_WEIGHT = 3.0, 20.0
CHARACTERS, RUNS = "characters", "runs"


@lru_cache(maxsize=1)
def _pages() -> dict[str, tuple[list[str], dict[str, int]]]:
    """Of each code page: byte to character and back. Bytes without a character stay what they are."""
    out = {}
    for name in CODE_PAGES:
        chars = []
        for b in range(256):
            try:
                chars.append(bytes([b]).decode(name))
            except UnicodeDecodeError:
                chars.append(chr(b))
        back = {c: b for b, c in reversed(list(enumerate(chars)))}
        out[name] = (chars, back)
    return out


@lru_cache(maxsize=1)
def _swaps() -> dict[tuple[str, str], dict[int, str]]:
    """Letter maps for translate() of all pairs (written in, read as) of code pages."""
    pages = _pages()
    out = {}
    for read in CODE_PAGES:
        for written in CODE_PAGES:
            if written != read:
                out[written, read] = {ord(c): pages[written][0][b] for c, b in pages[read][1].items() if b > 127 and ord(c) > 127}
    return out


@lru_cache(maxsize=1)
def _tables() -> tuple[dict[str, int], list[tuple[str, str]], np.ndarray, np.ndarray]:
    """(index of each character of the pages, keys, key x character -> character it means, key x
    character: the page read has no such character). The last index is any other character."""
    pages, swaps = _pages(), _swaps()
    chars = sorted({c for cs, _ in pages.values() for c in cs} | LAYOUT)
    at = {c: k for k, c in enumerate(chars)}
    keys = list(swaps)
    means = np.tile(np.arange(len(chars) + 1, dtype=np.int32), (len(keys), 1))
    lacks = np.zeros(means.shape, dtype=bool)
    lacks[:, -1] = True
    for n, key in enumerate(keys):
        for o, c in swaps[key].items():
            means[n, at[chr(o)]] = at[c]
        for c in chars:
            lacks[n, at[c]] = ord(c) > 127 and c not in LAYOUT and c not in pages[key[1]][1]
    return at, keys, means, lacks


def _from_utf8(run: str, read: str) -> str | None:
    back = _pages()[read][1]
    try:
        out = bytes(map(back.__getitem__, run)).decode("utf-8")
    except (KeyError, ValueError):
        return None
    return out if out != run else None


def readings(run: str) -> dict[str, list[tuple[str, str]]]:
    """What a run can mean: reading -> keys (written in, read as)."""
    out: dict[str, list[tuple[str, str]]] = {}
    chars = set(run)
    pages, swaps = _pages(), _swaps()
    for read in CODE_PAGES:
        if not chars <= pages[read][1].keys():
            continue
        once = _from_utf8(run, read)
        if once is not None:
            out.setdefault(once, []).append(("utf-8", read))
            twice = _from_utf8(once, read)
            if twice is not None:
                out.setdefault(twice, []).append(("utf-8 twice", read))
        for written in CODE_PAGES:
            if written != read:
                got = run.translate(swaps[written, read])
                if got != run:
                    out.setdefault(got, []).append((written, read))
    return out


def utf8_readings(run: str) -> dict[str, list[tuple[str, str]]]:
    """The readings of a run as UTF-8 alone."""
    out: dict[str, list[tuple[str, str]]] = {}
    for read in CODE_PAGES:
        once = _from_utf8(run, read)
        if once is not None:
            out.setdefault(once, []).append(("utf-8", read))
            twice = _from_utf8(once, read)
            if twice is not None:
                out.setdefault(twice, []).append(("utf-8 twice", read))
    return out


class _Classes(dict):
    """For translate(): characters that no code page has, by blocks of 256, become one private character."""

    def __missing__(self, o: int) -> str:
        c = chr(o)
        self[o] = c if o < 128 or c in _tables()[0] else chr(0xF0000 + (o >> 8))
        return self[o]


_CLASSES = _Classes()


def fold(s: str) -> str:
    return s.translate(_CLASSES)


class Bigrams:
    """Smoothed bigrams P(b | a) over characters (folded)."""

    def __init__(self, pairs: dict[str, float], chars: dict[str, float]):
        self.pairs, self.chars = pairs, chars
        self.total = max(sum(chars.values()), 1.0)

    def log(self, s: str) -> float:
        out, s = 0.0, fold(s)
        for a, b in zip(s, s[1:], strict=False):
            out += math.log((self.pairs.get(a + b, 0.0) + ALPHA * (self.chars.get(b, 0.0) + 0.01) / self.total) / (self.chars.get(a, 0.0) + ALPHA))
        return out

    def matrix(self) -> np.ndarray:
        """log P(b | a) by the indices of _tables()."""
        at = _tables()[0]
        n = len(at)
        chars, pairs = np.zeros(n + 1), np.zeros((n + 1, n + 1))
        for c, x in self.chars.items():
            chars[at.get(c, n)] += x
        for p, x in self.pairs.items():
            pairs[at.get(p[0], n), at.get(p[1], n)] += x
        return np.log((np.maximum(pairs, 0) + ALPHA * (np.maximum(chars, 0)[None, :] + 0.01) / self.total) / (np.maximum(chars, 0)[:, None] + ALPHA)).astype(np.float32)


def _evidence(runs: list[str], logs: np.ndarray) -> np.ndarray:
    """Run (with context) x key: evidence for the swap of pages. Layout has none."""
    at, keys, means, lacks = _tables()
    out = np.zeros((len(runs), len(keys)), dtype=np.float32)
    for lo in range(0, len(runs), 2000):
        part = runs[lo : lo + 2000]
        size = np.fromiter(map(len, part), dtype=np.int64)
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        flat = np.fromiter((at.get(c, len(at)) for w in part for c in w), dtype=np.int64, count=int(size.sum()))
        first = np.ones(len(flat), dtype=bool)
        first[start + size - 1] = False
        p = np.flatnonzero(first)
        a, b = flat[p], flat[p + 1]
        got = logs[means[:, a], means[:, b]] - logs[a, b]
        e = np.add.reduceat(got, start - np.arange(len(part)), axis=1)
        e[np.logical_or.reduceat(lacks[:, flat], start, axis=1)] = -IMPOSSIBLE
        out[lo : lo + 2000] = e.T
        for k, w in enumerate(part):
            if set(w[1:-1]) <= LAYOUT:
                out[lo + k] = 0
    return out


def _odd(w: str) -> bool:
    """A symbol or capital inside a word of small letters: rare in any language, usual in garble."""
    return w[0].islower() and w[-1].isalpha() and (w[1].isupper() or unicodedata.category(w[1])[0] in "SCN")


def _contexts(text: str):
    n = len(text)
    for m in RUN.finditer(text):
        s, e = m.span()
        yield (text[s - 1] if s else "\n") + m.group() + (text[e] if e < n else "\n")


def parse(text: str) -> tuple[list[str], list[list[int]]]:
    """(distinct runs with context, of each line that has any the numbers of its runs)."""
    place: dict[str, int] = {}
    lines = []
    if not text.isascii():
        for x in text.split("\n"):
            if not x.isascii():
                lines.append([place.setdefault(w, len(place)) for w in _contexts(x)])
    return list(place), lines


def _document_runs(batches):
    """Documents with runs, and one row a batch with the counts of the ASCII characters of all (s null)."""
    for pdf in batches:
        rows, ascii_counts = [], np.zeros(256, dtype=np.int64)
        for k, s, t in zip(pdf["k"], pdf["s"], pdf["t"], strict=True):
            ascii_counts += np.bincount(np.frombuffer(t.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256)
            ws, lines = parse(t)
            if ws:
                rows.append((k, s, LOST in t, ws, np.bincount(np.concatenate(lines), minlength=len(ws)), lines))
        rows.append((None, None, False, [chr(c) for c in range(128)], ascii_counts[:128], []))
        yield pd.DataFrame(rows, columns=["k", "s", "lost", "ws", "ns", "lines"])


def _seed(batches, weights: dict[str, float]):
    """Bigrams (two characters) and characters (one) of the runs, odd ones and large sources lowered, and
    the least and greatest of the sources that have them."""
    for pdf in batches:
        runs: dict[str, list] = {}
        for s, ws, ns in zip(pdf["s"], pdf["ws"], pdf["ns"], strict=True):
            v = weights.get(s, 1.0)
            for w, n in zip(ws, ns, strict=True):
                at = runs.setdefault(w, [0.0, s, s])
                at[0] += n * v
                at[1], at[2] = min(at[1], s), max(at[2], s)
        ends: dict[str, list] = {}
        for w, (_, lo, hi) in runs.items():
            for k in _parts({w: 0.0}):
                at = ends.setdefault(k, [lo, hi])
                at[0], at[1] = min(at[0], lo), max(at[1], hi)
        out = _parts({w: x * (ODD_WEIGHT if _odd(w) else 1.0) for w, (x, _, _) in runs.items()})
        if out:
            yield pd.DataFrame({"key": list(out), "x": [float(v) for v in out.values()], "lo": [ends[k][0] for k in out], "hi": [ends[k][1] for k in out]})


def _parts(runs: dict[str, float]) -> dict[str, float]:
    """Weight of the bigrams (two characters) and inner characters (one) of weighted runs."""
    out: dict[str, float] = {}
    for w, x in runs.items():
        w = fold(w)
        for k in range(len(w) - 1):
            p = w[k : k + 2]
            out[p] = out.get(p, 0.0) + x
        for c in w[1:-1]:
            out[c] = out.get(c, 0.0) + x
    return out


def _prior(source: str, priors: dict[str, np.ndarray]) -> np.ndarray | float:
    return priors.get(source, PRIOR[False])


def _assigned(pdf, logs: np.ndarray, priors: dict[str, np.ndarray]):
    """Of each document: source, runs, counts and the index of its key, None if it is clean."""
    place: dict[str, int] = {}
    for ws in pdf["ws"]:
        for w in ws:
            place.setdefault(w, len(place))
    e = _evidence(list(place), logs)
    for s, ws, ns in zip(pdf["s"], pdf["ws"], pdf["ns"], strict=True):
        odds = e[[place[w] for w in ws]].sum(axis=0) + _prior(s, priors)
        k = int(np.argmax(odds))
        yield s, ws, ns, k if odds[k] >= PAGE_ODDS else None


def _meant(w: str, k: int | None) -> str:
    if k is None or set(w[1:-1]) <= LAYOUT:
        return w
    return w.translate(_swaps()[_tables()[1][k]])


def _maximize(batches, logs: np.ndarray, priors: dict[str, np.ndarray], weights: dict[str, float]):
    """M-step over documents: bigrams and characters of what they mean (source null), and documents
    per source and key (index)."""
    for pdf in batches:
        runs: dict[str, float] = {}
        taken: Counter = Counter()
        for s, ws, ns, k in _assigned(pdf, logs, priors):
            v = weights.get(s, 1.0)
            if k is not None:
                taken[s, str(k)] += 1
                ws = [_meant(w, k) for w in ws]
            for w, n in zip(ws, ns, strict=True):
                runs[w] = runs.get(w, 0.0) + n * v
        rows = [(None, k, x) for k, x in _parts(runs).items()] + [(s, k, float(n)) for (s, k), n in taken.items()]
        if rows:
            yield pd.DataFrame(rows, columns=["s", "key", "x"])


def _corrected(batches, logs: np.ndarray, priors: dict[str, np.ndarray]):
    """Runs as the documents are taken to mean them (n) and as they stand (n = 0)."""
    for pdf in batches:
        out: Counter = Counter()
        for _, ws, ns, k in _assigned(pdf, logs, priors):
            for w, n in zip(ws, ns, strict=True):
                out[_meant(w, k)] += int(n)
                out[w] += 0
        if out:
            yield pd.DataFrame({"key": list(out), "n": list(out.values())})


def _model(rows: dict[str, float], chars: dict[str, float]) -> Bigrams:
    """Bigrams with the counts of ASCII characters from the whole texts, of others from the runs."""
    low = {c: x for c, x in chars.items() if ord(c) < 128}
    return Bigrams({k: x for k, x in rows.items() if len(k) == 2}, low | {k: x for k, x in rows.items() if len(k) == 1})


def _correct_pages(docs: DataFrame, chars: dict[str, float], scratch: Scratch) -> tuple[DataFrame, dict[str, np.ndarray], Bigrams]:
    """First stage, over the runs of documents: (runs of the corpus with counts once whole documents are read
    right, log-odds of the keys by source, bigrams that more than one source has). Runs that only stand in
    damaged documents have count 0."""
    docs = docs.select("s", "ws", "ns")
    size = {r["s"]: (int(r["d"]), float(r["n"])) for r in docs.groupBy("s").agg(F.count("*").alias("d"), F.sum(F.aggregate("ns", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n")).collect()}
    mean = sum(n for _, n in size.values()) / max(1, len(size))
    weights = {s: mean / n for s, (_, n) in size.items() if n > mean}
    step = docs.mapInPandas(lambda b: _seed(b, weights), "key string, x double, lo string, hi string").groupBy("key").agg(F.sum("x").alias("x"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    logs = _model({r["key"]: r["x"] for r in step}, chars).matrix()
    language = _model({r["key"]: r["x"] for r in step if r["lo"] != r["hi"] or len(size) == 1}, chars)
    priors: dict[str, np.ndarray] = {}
    for _ in range(ROUNDS):
        step = docs.mapInPandas(lambda b, m=logs, p=priors: _maximize(b, m, p, weights), "s string, key string, x double").groupBy("s", "key").agg(F.sum("x").alias("x")).collect()
        logs = _model({r["key"]: r["x"] for r in step if r["s"] is None}, chars).matrix()
        found: dict[str, np.ndarray] = {}
        for r in step:
            if r["s"] is not None:
                found.setdefault(r["s"], np.zeros(len(_tables()[1])))[int(r["key"])] = r["x"]
        # a key is never likelier than the plain reading before its evidence is seen
        priors = {s: np.minimum(0.0, np.log((n + PSEUDO_DOCS * math.exp(PRIOR[False])) / (size[s][0] - n.sum() + PSEUDO_DOCS))) for s, n in found.items()}
    runs = docs.mapInPandas(lambda b: _corrected(b, logs, priors), "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return scratch.put(runs), priors, language


def _is_utf8(keys: list[tuple[str, str]]) -> bool:
    return keys[0][0].startswith("utf-8")


def _expect(batches, model: Bigrams):
    """E-step: expected bigrams of runs under the posterior of their readings."""
    out: dict[str, float] = {}
    for pdf in batches:
        for w, n, cands, utf8 in zip(pdf["w"], pdf["n"], pdf["cands"], pdf["utf8"], strict=True):
            base, odds = model.log(w), []
            for r, u in zip(cands, utf8, strict=True):
                z = fold(w[0] + r + w[-1])
                odds.append((math.exp(min(50.0, PRIOR[bool(u)] + model.log(z) - base)), z))
            whole = 1.0 + sum(p for p, _ in odds)
            for p, z in [(1.0, fold(w)), *odds]:
                share = n * p / whole
                if share > 1e-3:
                    for a, b in zip(z, z[1:], strict=False):
                        out[a + b] = out.get(a + b, 0.0) + share
    if out:
        yield pd.DataFrame({"pair": list(out), "x": list(out.values())})


def _candidates(batches, model: Bigrams):
    """Readings of each run that the first model does not rule out."""
    for pdf in batches:
        rows = []
        for w, n in zip(pdf["key"], pdf["n"], strict=True):
            base = model.log(w)
            scored = [(model.log(w[0] + r + w[-1]) - base, r, _is_utf8(k)) for r, k in readings(w[1:-1]).items()]
            kept = sorted((x for x in scored if x[0] > -8.0), reverse=True)
            rows.append((w, int(n), [r for _, r, _ in kept], [u for _, _, u in kept]))
        if rows:
            yield pd.DataFrame(rows, columns=["w", "n", "cands", "utf8"])


def _pairs(batches):
    """Bigrams of the corrected runs by their counts."""
    for pdf in batches:
        out = {k: x for k, x in _parts(dict(zip(pdf["key"], pdf["n"], strict=True))).items() if len(k) == 2}
        if out:
            yield pd.DataFrame({"pair": list(out), "x": [float(x) for x in out.values()]})


def learn_bigrams(docs: DataFrame, scratch: Scratch, iterations: int = ITERATIONS) -> tuple[Bigrams, DataFrame, dict[str, np.ndarray], Bigrams]:
    """Of the runs of documents (as from _document_runs): (bigram model without the damaged runs, the runs
    with their readings, log-odds of the page keys by source, bigrams that more than one source has)."""
    low = docs.filter("s is null").select(F.explode(F.arrays_zip("ws", "ns")).alias("z")).groupBy("z.ws").agg(F.sum("z.ns").alias("n"))
    chars = {r["ws"]: float(r["n"]) for r in low.collect()}
    runs, priors, language = _correct_pages(docs.filter("s is not null"), chars, scratch)
    kept = runs.filter("n > 0")
    step = kept.mapInPandas(_pairs, "pair string, x double").groupBy("pair").agg(F.sum("x").alias("x"))
    start = {r["pair"]: float(r["x"]) for r in step.collect()}
    single: Counter = Counter()
    for p, x in start.items():
        single[p[0]] += x
    model = _model(start | {c: x for c, x in single.items() if ord(c) > 127}, chars)
    chars = model.chars
    known = scratch.put(runs.mapInPandas(lambda b, m=model: _candidates(b, m), "w string, n long, cands array<string>, utf8 array<boolean>"))
    for _ in range(iterations):
        step = known.filter("n > 0").mapInPandas(lambda b, m=model: _expect(b, m), "pair string, x double").groupBy("pair").agg(F.sum("x").alias("x"))
        model = Bigrams({r["pair"]: r["x"] for r in step.collect()}, chars)
    return model, known, priors, language


def _source(docs: DataFrame, source_col: str):
    """Name of a document's source; without the column all documents are of one."""
    return F.coalesce(F.lower(F.trim(F.col(source_col).cast("string"))), F.lit("")) if source_col in docs.columns else F.lit("")


class Judge:
    """Decides about documents under a learned model. Judged runs are kept for the next document."""

    def __init__(self, model: Bigrams, priors: dict[str, np.ndarray] | None = None, likely: set[str] | None = None, ciphers: dict | None = None, language: Bigrams | None = None):
        """likely: the runs that have a likelier reading as UTF-8, where they are known; language: the bigrams
        that a document should have, those of more than one source."""
        self.model, self.priors, self.likely, self.ciphers = model, priors or {}, likely, ciphers or {}
        self.logs = model.matrix()
        at = _tables()[0]
        unigram = np.full(len(at) + 1, 0.01)
        language = language or model
        for c, x in language.chars.items():
            unigram[at.get(c, len(at))] += max(x, 0.0)
        self.lift = language.matrix() - np.log(unigram / unigram.sum())[None, :]
        self.rows: dict[str, np.ndarray] = {}
        self.utf8: dict[str, list] = {}
        self.gains: dict[tuple, float] = {}

    def prepare(self, runs: Iterable[str]) -> None:
        """Evidence of runs for every swap of two pages, all new ones at once."""
        new = [w for w in dict.fromkeys(runs) if w not in self.rows]
        if len(self.rows) + len(new) > KEPT_RUNS:
            self.rows = {}
            new = list(dict.fromkeys(runs))
        self.rows |= zip(new, _evidence(new, self.logs), strict=True)

    def score(self, w: str) -> list[tuple[float, str, list[tuple[str, str]]]]:
        """Readings of a run as UTF-8 that are likelier than the plain one: (evidence, reading, keys)."""
        if self.likely is not None and w not in self.likely:
            return []
        got = self.utf8.get(w)
        if got is None:
            base = self.model.log(w)
            got = [(e, r, k) for r, k in utf8_readings(w[1:-1]).items() if (e := self.model.log(w[0] + r + w[-1]) - base) > 0]
            if len(self.utf8) < 500_000:
                self.utf8[w] = got
        return got

    def fit(self, runs: list[str]) -> float:
        """Mean of log P(b | a) / P(b) over the bigrams of the runs: low where no language has them."""
        at = _tables()[0]
        n = len(at)
        each = []
        for w in runs:
            ix = np.array([at.get(c, n) for c in w])
            each.append(float(self.lift[ix[:-1], ix[1:]].mean()))
        return float(np.mean(each))

    def gain(self, w: str, source: str, cluster: str) -> float:
        """Evidence of a run for the learned map of a source."""
        key = (w, source, cluster)
        if key not in self.gains:
            if len(self.gains) > 500_000:
                self.gains = {}
            new = decipher(w[1:-1], self.ciphers[source, cluster], cluster)
            self.gains[key] = self.model.log(w[0] + new + w[-1]) - self.model.log(w) if new != w[1:-1] else 0.0
        return self.gains[key]

    def keys(self, ws: list[str], lines: list[list[int]], source: str = "") -> list[tuple[float, tuple[str, str]]]:
        """Keys under which the text of these runs is damaged, with their evidence, the strongest first."""
        real = [k for k, w in enumerate(ws) if not set(w[1:-1]) <= LAYOUT]
        if not real:
            return []
        names = _tables()[1]
        utf8: Counter = Counter()
        strong: dict[tuple[str, str], float] = {}
        for k in real:
            for e, _, keys in self.score(ws[k]):
                for key in keys:
                    utf8[key] += e
                    strong[key] = max(strong.get(key, 0.0), e)
        found = [(v, key) for key, v in utf8.items() if strong[key] >= UTF8_RUN and v >= UTF8_ALL]
        if any(w not in self.rows for w in ws):
            self.prepare(ws)
        m = np.stack([self.rows[w] for w in ws])
        prior = _prior(source, self.priors)
        total = m[real].sum(axis=0)
        odds = total + prior
        whole = int(np.argmax(odds))
        if odds[whole] >= PAGE_ODDS:
            cluster = _page(whole)
            if (source, cluster) not in self.ciphers or sum(self.gain(ws[k], source, cluster) for k in real) + (odds - total)[whole] >= PAGE_ODDS:
                found.append((float(total[whole]), names[whole]))
        else:
            whole = -1
        some = np.flatnonzero(m[real].max(axis=0) >= PAGE_RUN)
        some = some[some != whole]
        if len(some):
            size = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
            flat = np.fromiter((k for x in lines for k in x), dtype=np.int64, count=int(size.sum()))
            each = np.add.reduceat(m[:, some][flat], np.cumsum(size) - size, axis=0)
            best, total = each.max(axis=0), np.maximum(each, 0.0).sum(axis=0)
            own = np.full(len(some), prior) if isinstance(prior, float) else prior[some]
            found += [(float(total[k]), names[some[k]]) for k in np.flatnonzero(best + own >= PAGE_ODDS)]
        if not found:
            found = self.learned(ws, source)
        return sorted(found, key=lambda x: (-x[0], x[1]))

    def learned(self, ws: list[str], source: str) -> list[tuple[float, tuple[str, str]]]:
        """Whether a map that was learned without a start explains the document."""
        out = []
        for cluster in (CHARACTERS, RUNS):
            table = self.ciphers.get((source, cluster))
            if not table or self.fit(ws) >= POOR_FIT:
                continue
            symbols = {x for w in ws for x in _symbols(w, cluster) if x in table}
            total = sum(self.gain(w, source, cluster) for w in ws)
            # letters were chosen freely: each costs the choice, shared by the documents it was learned from
            if len(symbols) >= LEAST_SYMBOLS and total - len(symbols) * math.log(len(_tables()[0])) / table[""] >= PAGE_LINE:
                out.append((total, (LEARNED, cluster)))
        return out

    def restore(self, text: str, source: str = "") -> tuple[str, list[str]]:
        """The text with its damaged places restored, and the keys applied. Every step makes the text
        likelier, so it comes to an end; a text that was there before ends it too."""
        used: list[str] = []
        seen = {text}
        while True:
            ws, lines = parse(text)
            keys = [key for _, key in self.keys(ws, lines, source)]
            for key in keys:
                # places may have been misread in different ways: each run takes the best of the keys
                same = [k for k in keys if k[0].startswith("utf-8")] if key[0].startswith("utf-8") else [key]
                new, by = self._apply(text, same, source)
                if new not in seen:
                    break
            else:
                return text, used
            used += [f"{k[0]} read as {k[1]}" if k[0] != LEARNED else f"map of the source over {k[1]}" for k in by]
            text = new
            seen.add(text)

    def _apply(self, text: str, keys: list[tuple[str, str]], source: str) -> tuple[str, list[tuple[str, str]]]:
        """The text restored by these keys (several only for UTF-8), and those that had a part in it."""
        written, read = keys[0]
        if written.startswith("utf-8") or keys[0] == (LEARNED, RUNS):
            by: dict[tuple[str, str], None] = {}

            def mend(m: re.Match) -> str:
                s, e = m.span()
                a, b = text[s - 1] if s else "\n", text[e] if e < len(text) else "\n"
                best, out, chosen = self.model.log(a + m.group() + b), m.group(), None
                for key in keys:
                    if key[0] == LEARNED:
                        got = decipher(m.group(), self.ciphers[source, RUNS], RUNS)
                    else:
                        got = _from_utf8(m.group(), key[1])
                        if got is not None and key[0] == "utf-8 twice":
                            got = _from_utf8(got, key[1]) or got
                    if got is not None and got != m.group() and (v := self.model.log(a + got + b)) > best:
                        best, out, chosen = v, got, key
                if chosen:
                    by[chosen] = None
                return out

            return RUN.sub(mend, text), list(by)
        if written == LEARNED:
            cluster, n = CHARACTERS, None
        else:
            n = _tables()[1].index(keys[0])
            cluster = _page(n)
        table = _swaps()[keys[0]] if n is not None else {}
        learned = self.ciphers.get((source, cluster))
        if learned:
            table = table | {ord(x): y for x, y in learned.items() if x}
        out = []
        for x in text.split("\n"):
            if not x.isascii():
                runs = list(_contexts(x))
                if learned:
                    gain = sum(self.gain(w, source, cluster) for w in runs)
                else:
                    self.prepare(runs)
                    gain = float(np.sum([self.rows[w][n] for w in runs]))
                if gain > 0:
                    x = x.translate(table)
            out.append(x)
        return "\n".join(out), keys


# ------------------------------------------------------------------ third stage: maps of the sources

LEARNED = "learned"


def _page(n: int) -> str:
    """Cluster of the documents of a source that have one swapped pair of pages."""
    return f"page {n}"


def _cut(run: str) -> list[str]:
    """The sequences of a run: a new one starts where its first character comes again. None if one is no
    longer than a character or longer than four."""
    at = [k for k, c in enumerate(run) if c == run[0]]
    parts = [run[p:q] for p, q in zip(at, [*at[1:], len(run)], strict=True)]
    return parts if all(2 <= len(x) <= 4 for x in parts) else []


def _symbols(w: str, cluster: str) -> list[str]:
    """What a letter stands for each in a run with context."""
    run = w[1:-1]
    return _cut(run) if cluster == RUNS else [c for c in run if c not in LAYOUT]


def decipher(run: str, table: dict[str, str], cluster: str) -> str:
    return "".join(table.get(x, x) for x in ((_cut(run) or [run]) if cluster == RUNS else run))


def _letters(model: Bigrams) -> np.ndarray:
    """Indices of the letters that a symbol may stand for: other than ASCII, of the code pages."""
    at = _tables()[0]
    return np.array(sorted(at[c] for c, x in model.chars.items() if x > 0 and ord(c) > 127 and c in at and c not in LAYOUT), dtype=np.int64)


def _start(cluster: str, symbol: str) -> str | None:
    """The letter that a symbol stands for at the start, if the cluster has such a map."""
    if not cluster.startswith("page "):
        return None
    return _swaps()[_tables()[1][int(cluster[5:])]].get(ord(symbol), symbol)


def _posteriors(batches, logs: np.ndarray, letters: np.ndarray, maps: dict):
    """E-step: expected letters behind the symbols of runs (s, c, w, n), forward and backward over a run.
    maps: (source, cluster) -> symbol -> weights of the letters; without an entry all are alike."""
    at = _tables()[0]
    names = sorted(at, key=at.get)
    n = len(at)
    inner = np.exp(logs[np.ix_(letters, letters)].astype(float))
    flat = np.full(len(letters), 1.0 / max(1, len(letters)))
    for pdf in batches:
        out: dict[tuple, np.ndarray] = {}
        for s, c, w, k in zip(pdf["s"], pdf["c"], pdf["w"], pdf["n"], strict=True):
            symbols = _symbols(w, c)
            if not symbols:
                continue
            table = maps.get((s, c), {})
            theta = [table.get(x, flat) for x in symbols]
            first = np.exp(logs[at.get(w[0], n), letters].astype(float))
            last = np.exp(logs[letters, at.get(w[-1], n)].astype(float))
            ahead = [first * theta[0]]
            for t in theta[1:]:
                v = (ahead[-1] @ inner) * t
                ahead.append(v / max(v.sum(), 1e-300))
            behind = last
            for p in range(len(symbols) - 1, -1, -1):
                v = ahead[p] * behind
                if v.sum() > 0:
                    key = (s, c, symbols[p])
                    out[key] = out.get(key, 0.0) + k * v / v.sum()
                behind = inner @ (theta[p] * behind)
                behind = behind / max(behind.sum(), 1e-300)
        rows = [(*key, names[letters[y]], float(x[y])) for key, x in out.items() for y in np.flatnonzero(x > LEAST_WEIGHT)]
        if rows:
            yield pd.DataFrame(rows, columns=["s", "c", "x", "y", "weight"])


def learn_ciphers(members: DataFrame, model: Bigrams, scratch: Scratch) -> dict[tuple[str, str], dict[str, str]]:
    """Maps of symbols to letters by source and cluster, from the runs of documents (s, c, ws, ns). Under the
    empty symbol a map has the number of its documents. Only maps of sources with damaged documents reach the
    driver, each with at most a few letters for each symbol."""
    sizes = {(r["s"], r["c"]): int(r["n"]) for r in members.groupBy("s", "c").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    each = members.select("s", "c", F.explode(F.arrays_zip("ws", "ns")).alias("z")).groupBy("s", "c", F.col("z.ws").alias("w")).agg(F.sum("z.ns").alias("n"))
    each = scratch.put(each)
    logs, letters, at = model.matrix(), _letters(model), _tables()[0]
    place = {int(y): k for k, y in enumerate(letters)}
    maps: dict = {}
    counts: dict = {}
    for _ in range(CIPHER_ROUNDS):
        step = each.mapInPandas(lambda b, m=maps: _posteriors(b, logs, letters, m), "s string, c string, x string, y string, weight double")
        counts = {}
        for r in step.groupBy("s", "c", "x", "y").agg(F.sum("weight").alias("weight")).collect():
            v = counts.setdefault((r["s"], r["c"]), {}).setdefault(r["x"], np.zeros(len(letters)))
            v[place[at[r["y"]]]] += r["weight"]
        maps = {}
        for key, table in counts.items():
            own = maps[key] = {}
            for x, v in table.items():
                to = _start(key[1], x)
                if to is not None:
                    if at.get(to) not in place:  # layout and other symbols stay what the page makes of them
                        continue
                    v = v.copy()
                    v[place[at[to]]] = START_FACTOR * v[place[at[to]]] + START_WEIGHT
                own[x] = v / v.sum()
    names = sorted(at, key=at.get)
    out = {}
    for key, table in maps.items():
        got = {}
        for x, v in table.items():
            y = names[letters[int(np.argmax(v))]]
            if _start(key[1], x) is not None or (v.max() >= 0.5 and counts[key][x].sum() >= LEAST_SEEN):
                got[x] = y
        got = {x: y for x, y in got.items() if x != y}
        if got:
            out[key] = got | {"": sizes[key]}
    return out


# ------------------------------------------------------------------ whole tables


def _likely(batches, model: Bigrams):
    """Runs with a reading as UTF-8 that is likelier than the plain one."""
    for pdf in batches:
        rows = []
        for w in pdf["w"]:
            base = model.log(w)
            if any(model.log(w[0] + r + w[-1]) > base for r in utf8_readings(w[1:-1])):
                rows.append(w)
        if rows:
            yield pd.DataFrame({"w": rows})


def _clusters(batches, judge: Judge):
    """Documents that the third stage learns from: those with one swapped page, and those without a key
    whose runs no language has. The latter are in two clusters, one for each kind of symbols."""
    names = {key: n for n, key in enumerate(_tables()[1])}
    for pdf in batches:
        judge.prepare(w for ws in pdf["ws"] for w in ws)
        rows = []
        for s, ws, ns, lines in zip(pdf["s"], pdf["ws"], pdf["ns"], pdf["lines"], strict=True):
            ws = list(ws)
            keys = judge.keys(ws, lines, s)
            if keys and keys[0][1] in names:
                table = _swaps()[keys[0][1]]
                if any(e >= UTF8_RUN for w in ws for e, _, _ in judge.score(w.translate(table))):
                    continue  # UTF-8 below the swap: its symbols are no letters yet
                rows.append((s, _page(names[keys[0][1]]), ws, ns))
            elif not keys and judge.fit(ws) < POOR_FIT:
                rows += [(s, c, ws, ns) for c in (CHARACTERS, RUNS)]
        if rows:
            yield pd.DataFrame(rows, columns=["s", "c", "ws", "ns"])


def learn(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, Judge]:
    """(runs of the documents: k, s, lost, ws, ns, lines; a judge that has learned from all of them)."""
    scratch = Scratch(docs.sparkSession, "garble")
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("k"), _source(docs, source_col).alias("s"), F.col(text_col).alias("t")).filter("t is not null")
    parsed = scratch.put(rows.mapInPandas(_document_runs, f"k {kind}, s string, lost boolean, ws array<string>, ns array<long>, lines array<array<int>>"))
    model, known, priors, language = learn_bigrams(parsed, scratch)
    likely = scratch.put(known.mapInPandas(lambda b: _likely(b, model), "w string"))
    # where these runs are too many to send, executors look at every run themselves, to the same end
    few = {r["w"] for r in likely.collect()} if likely.count() <= BROADCAST_ROWS else None
    judge = Judge(model, priors, language=language)
    texts = parsed.filter("s is not null")
    members = scratch.put(texts.select("s", "ws", "ns", "lines").mapInPandas(lambda b: _clusters(b, judge), "s string, c string, ws array<string>, ns array<long>"))
    return texts, Judge(model, priors, few, learn_ciphers(members, model, scratch), language)


def find_garbled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Ids of documents whose text was, wholly or partly, read with a wrong encoding.

    Replacement characters (U+FFFD) are what a wrong decoder leaves and count by themselves. Null,
    empty and pure ASCII texts are never damaged. Repeated ids are judged row by row.
    """
    texts, judge = learn(docs, id_col, text_col, source_col)

    def decide(batches):
        for pdf in batches:
            judge.prepare(w for ws in pdf["ws"] for w in ws)
            bad = [lost or bool(judge.keys(list(ws), lines, s)) for lost, ws, lines, s in zip(pdf["lost"], pdf["ws"], pdf["lines"], pdf["s"], strict=True)]
            yield pdf.loc[bad, ["k"]]

    kind = dict(docs.dtypes)[id_col]
    return texts.select("k", "s", "lost", "ws", "lines").mapInPandas(decide, f"k {kind}").withColumnRenamed("k", id_col)


def restore_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The damaged documents only: id, restored_text, swaps applied, has_losses (some characters are
    gone for good)."""
    _, judge = learn(docs, id_col, text_col, source_col)
    judge.likely = None  # a text half restored has runs that the corpus has not
    kind = dict(docs.dtypes)[id_col]

    def restore(batches):
        for pdf in batches:
            rows = []
            for k, s, t in zip(pdf["k"], pdf["s"], pdf["t"], strict=True):
                if t.isascii():
                    continue
                fixed, used = judge.restore(t, s)
                if used or LOST in t:
                    rows.append((k, fixed, used, LOST in fixed))
            if rows:
                yield pd.DataFrame(rows, columns=["k", "restored_text", "swaps", "has_losses"])

    rows = docs.select(F.col(id_col).alias("k"), _source(docs, source_col).alias("s"), F.col(text_col).alias("t")).filter("t is not null")
    return rows.mapInPandas(restore, f"k {kind}, restored_text string, swaps array<string>, has_losses boolean").withColumnRenamed("k", id_col)
