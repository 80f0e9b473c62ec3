import random

import numpy as np
import pytest

from tarnflow.llm import leakage
from tarnflow.llm.leakage import LETTER_MASK, find_leaks, letters_of, mask_hashes, overlaps
from tarnflow.llm.wordstream import reader_words

VOC = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)]


def run_of(a, b):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            best = max(best, k)
    return best


def test_words_as_a_reader_takes_them():
    same = "the inflow of twenty four dykes resists cafe naive fillings".split()
    for text in (
        "The inflow of twenty-four dykes resists café naïve fillings.",
        "THE INFLOW OF TWENTY~FOUR dykes re\\-sists caf{\\'e} na{\\\"\\i}ve \\emph{fil}lings",
        "% The in\u00adflow of\\\\ twenty\\,four\n% dykes \\textbf{resists cafe\u0301} naïve ﬁllings",
        "the inflow\\cite{a9} of \\label{x}twenty four {dykes} resists \u200bcafe naive\u2009fillings",
        "<p class='x'>the <b>in</b>flow of twenty&nbsp;four [dykes](http://a.b/c) re<em>sists</em> caf&eacute; na&#239;ve fillings</p>",
    ):
        assert reader_words(text) == same, text
    assert reader_words("golf\\footnote{a \\emph{b} {c}} hotel \\thanks{d} if a <b and c> d") == "golf hotel if a b and c d a b c d".split()
    assert reader_words(None) == reader_words("") == []


def test_overlaps():
    a, b = list("abcdefghij"), list("xxcdefQhixx")
    assert overlaps(a, b) == (4, 7)
    assert overlaps(a, b, tolerance=0) == (4, 4)
    assert overlaps([], b) == (0, 0)
    rnd = random.Random(0)
    for _ in range(30):
        x, y = ([rnd.choice("abc") for _ in range(rnd.randrange(1, 15))] for _ in range(2))
        assert overlaps(x, y)[0] == run_of(x, y) <= overlaps(x, y)[1] or run_of(x, y) == 0


def test_masks_ignore_their_open_positions():
    w = np.arange(1, 13, dtype=np.uint64)
    other = w.copy()
    other[2] = 99
    a, b = mask_hashes(w, "1101101", 0), mask_hashes(other, "1101101", 0)
    assert a[0] == b[0] and a[1] != b[1]


def test_letters():
    words = ["ab", "c", "", "defg"][:2] + ["defg", "ab"]
    codes, starts, ids = letters_of(words)
    assert "".join(map(chr, codes)) == "abcdefgab" and starts.tolist() == [0, 2, 3, 7]
    assert ids[0] == ids[3] and len(set(ids.tolist())) == 3
    assert len(letters_of([])[2]) == 0
    rnd = random.Random(1)
    seen = {tuple(mask_hashes(np.array([rnd.randrange(97, 123) for _ in range(24)], dtype=np.uint64), LETTER_MASK, 0).tolist()) for _ in range(20000)}
    assert len(seen) == 20000  # small numbers give no collisions


@pytest.mark.parametrize("broadcast_rows", [leakage.BROADCAST_ROWS, 0])
def test_against_brute_force(spark, broadcast_rows):
    rnd = random.Random(4)
    items = [(k, " ".join(rnd.choice(VOC) for _ in range(40)), "x") for k in range(12)]
    docs = []
    for d in range(40):
        words = [rnd.choice(VOC) for _ in range(rnd.randrange(0, 120))]
        for _ in range(rnd.randrange(3)):
            src = items[rnd.randrange(12)][1].split()
            n, s, p = rnd.randrange(8, 20), rnd.randrange(20), rnd.randrange(len(words) + 1)
            words[p:p] = src[s : s + n]
        docs.append((d, " ".join(words), "clash"))
    docs += [(100, None, ""), (101, "", ""), (None, items[0][1], ""), (102, "word " * 30000 + items[3][1] + " word" * 30000, ""), (5, docs[5][1], "")]
    ddf = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    idf = spark.createDataFrame([*items, (None, "a b", ""), (77, None, "")], "item_id long, text string, words string")
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(ddf, idf, broadcast_rows=broadcast_rows).filter("exact").collect()}
    want = {(d, i) for d, t, _ in docs if d is not None and t and d != 102 for i, u, _ in items if run_of(t.split(), u.split()) >= 12} | {(102, 3)}
    assert got == want


def test_divided_words_and_substitutions(spark):
    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey"
    one = item.replace("kilo", "ki- lo")
    two = item.replace("hotel", "motel").replace("romeo", "juliet")
    docs = spark.createDataFrame([(1, one), (2, two), (3, item.upper())], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in find_leaks(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()}
    assert rows[1]["exact"] and rows[3]["exact"] and rows[3]["run"] == 23
    assert not rows[2]["exact"] and rows[2]["overlap"] == 23


@pytest.mark.parametrize("item", ["alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima", "a be c de 1 22 a 3 of to 7 be"])
def test_every_divided_or_joined_word_of_the_shortest_run(spark, item):
    """12 words alone, one of them divided or two joined, each in other words on both sides."""
    words = item.split()
    runs = [words[:k] + [w[:1] + "-\n", w[1:]] + words[k + 1 :] for k, w in enumerate(words) if len(w) > 1]
    runs += [words[:k] + [words[k] + words[k + 1]] + words[k + 2 :] for k in range(11)]
    runs += [list("".join(words)), ["".join(words)]]
    docs = [(n, f"quebec romeo {' '.join(r).replace('- ', '-')} sierra tango") for n, r in enumerate(runs)]
    docs += [(100, "quebec " + item.replace(words[5], "xray") + " sierra"), (101, "quebec" + item + "sierra"), (102, "x" + " ".join(words[:11]))]
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, "uniform " + item + " victor")], "item_id long, text string"))
    assert {r["doc_id"] for r in got.filter("exact").collect()} == set(range(len(runs)))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert find_leaks(empty, items).count() == 0
    assert find_leaks(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), items.limit(0)).count() == 0
    with pytest.raises(ValueError):
        find_leaks(empty, items, min_run=5)
