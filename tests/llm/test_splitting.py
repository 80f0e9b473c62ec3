import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnflow.llm import splitting
from tarnflow.llm.splitting import LEVEL_NAMES, cut_kinds, pack, range_items, split_ranges, split_texts, text_levels


def clean(lo, hi, limit, overlap, cuts):
    """Whether cuts at the lines alone suffice, by search over all of them."""
    todo, seen = [lo], set()
    while todo:
        s = todo.pop()
        if hi - s + 1 <= limit:
            return True
        for p in cuts:
            if s < p <= min(hi, s + limit) and p - overlap > s and p - overlap not in seen:
                seen.add(p - overlap)
                todo.append(p - overlap)
    return False


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 60), st.integers(0, 150), st.integers(2, 30), st.integers(0, 12), st.lists(st.integers(0, 220), max_size=12))
def test_pack(lo, length, limit, overlap, cuts):
    hi, cuts = lo + length - 1, sorted(set(cuts))
    overlap = min(overlap, limit - 1)
    out = list(pack(lo, hi, limit, overlap, [cuts]))
    if length == 0:
        assert not out
        return
    assert out[0][0] == lo and out[-1][1] == hi and out[-1][2] == -1
    assert all(b - a + 1 <= limit for a, b, _ in out)
    for (_, b, level), (a2, _, _) in zip(out, out[1:], strict=False):
        assert a2 == b + 1 - overlap and (level == 1 or b + 1 in cuts)
    if length > limit:
        assert (all(level != 1 for *_, level in out)) == clean(lo, hi, limit, overlap, cuts)


def test_ranges_of_all_spellings(spark):
    cols = "domain_id long, grid_id long, xrange string, yrange string, i_lo long, i_hi long, j_lo long, j_hi long, max_len long, overlap_len long, axis string"
    rows = [
        (1, 1, "1:10", " 5 : 9", None, None, None, None, 4, 1, "clash"),
        (1, 1, "1:10", None, None, None, 5, 9, 4, 1, "clash"),
        (2, 1, "UnitRange(1, 10)", "3:1:2", None, None, None, None, 10, 0, None),
        (3, 2, None, None, 1, 9, None, None, 3, None, None),
        (4, None, None, None, 1, 9, 1, 9, 5, 9, None),
        (None, 1, "1:90", "1:90", None, None, None, None, 4, 1, None),
        (5, 1, "x", "", None, None, None, None, 4, 1, None),
        (6, 1, "1:9", "1:9", None, None, None, None, None, 1, None),
    ]
    lines = spark.createDataFrame([(1, "x", 4), (1, "x", 4), (1, "x", None), (1, "x", 7), (1, "x", 9), (1, "y", 8)], "grid_id long, axis string, pos long")
    pieces = split_ranges(range_items(spark.createDataFrame(rows, cols)), lines)
    got = {(r["domain_id"], r["axis"]): r["cut_kind"] for r in cut_kinds(pieces).collect()}
    assert got == {(1, "x"): "clean", (1, "y"): "clean", (3, "x"): "forced", (4, "x"): "forced", (4, "y"): "forced"}
    x = [(r["lo"], r["hi"]) for r in pieces.filter("domain_id = 1 and axis = 'x'").orderBy("piece").collect()]
    assert x == [(1, 3), (3, 6), (6, 8), (8, 10)]
    assert split_ranges(range_items(spark.createDataFrame([], cols)), lines.limit(0)).count() == 0


def test_texts_round_trip(spark):
    rnd = random.Random(3)
    long = "".join(rnd.choice(["word ", "Ärger. ", "\n\n", "\\section{A}\n", "x" * 90, "。"]) for _ in range(400))
    docs = spark.createDataFrame([(1, long, "c"), (2, "short", "c"), (3, None, "c"), (4, "", "c"), (5, "y" * 1000, "c")], "doc_id long, text string, piece string")
    out = split_texts(docs, "doc_id", "text", limit=120, overlap=15).orderBy("doc_id", "piece").collect()
    for k, text in ((1, long), (2, "short"), (5, "y" * 1000)):
        parts = [r for r in out if r["doc_id"] == k]
        assert all(len(r["piece_text"]) <= 120 for r in parts)
        assert parts[0]["piece_text"] + "".join(r["piece_text"][15:] for r in parts[1:]) == text
        assert parts[-1]["cut_kind"] == "end" and {r["cut_kind"] for r in parts[:-1]} <= set(LEVEL_NAMES)
    assert {r["doc_id"] for r in out} == {1, 2, 5}


def test_higher_levels_come_first():
    text = "One. Two.\n\n\\section{B}\nThree words here."
    sections, paragraphs, sentences, words = text_levels(text)
    assert sections == [text.index("\\section")] and paragraphs == [11] and 5 in sentences and len(words) > 4
    assert [level for *_, level in pack(0, len(text) - 1, 30, 0, text_levels(text))][0] == 0
    with pytest.raises(ValueError):
        list(pack(1, 9, 0, 0, []))


def test_pieces_leave_the_worker_in_bounded_frames(spark, monkeypatch):
    rows = [("a" * n,) for n in (3, 5, 9, 1, 1)]
    monkeypatch.setattr(splitting, "CHUNK_PIECES", 2)
    assert [len(f) for f in splitting._frames(iter(rows), ["t"])] == [2, 2, 1]
    monkeypatch.setattr(splitting, "CHUNK_CHARACTERS", 6)
    monkeypatch.setattr(splitting, "CHUNK_PIECES", 100)
    assert [len(f) for f in splitting._frames(iter(rows), ["t"], 0)] == [2, 1, 2]
    assert list(splitting._frames(iter([]), ["t"])) == []
