import random

import pytest

from tarnflow.llm import garble
from tarnflow.llm.garble import CODE_PAGES, find_garbled, readings, restore_texts

CLEAN = {
    "de": "Die größte Höhe über der Fläche wächst während der Übergangszeit, später fällt die Böschung für größere Störungen.",
    "fr": "L'été très sec précède généralement la crue décennale, la forêt évolue près des dépôts où l'étiage observé décroît.",
    "pl": "Średni przepływ rośnie wraz z długością źródeł, część północna zagłębienia poprzedza dłuższą suszę.",
    "ru": "Средний расход воды определяется через влажность почвы, кроме того верхний водосбор зависит от уклона склона.",
    "en": "It’s enough that the “noisy lattice” stays within 12–40 m³ at 20 °C ± 3 in the plain of São Tomé.",
}


def corpus(n=150):
    rnd = random.Random(0)
    out = []
    for k in range(n):
        lang = rnd.choice(list(CLEAN))
        words = CLEAN[lang].split()
        lines = [" ".join(rnd.sample(words, len(words))) for _ in range(6)]
        out.append((k, lang, "\n".join(lines)))
    return out


def misread(text, written, read):
    out = []
    for b in text.encode(written, "replace"):
        try:
            out.append(bytes([b]).decode(read))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


SWAPS = [("utf-8", "cp1252", None), ("utf-8", "latin-1", None), ("utf-8", "cp437", None), ("utf-8", "mac_roman", None), ("cp1251", "cp1252", "ru"), ("koi8-r", "cp1251", "ru"), ("iso8859-2", "latin-1", "pl"), ("latin-1", "cp850", "de"), ("mac_roman", "cp1252", "fr")]


def test_damage_is_found_and_restored(spark):
    docs, want, damaged = corpus(), {}, []
    for n, (written, read, lang) in enumerate(SWAPS):
        k, _, t = next(d for d in docs[n * 3 :] if (lang is None or d[1] == lang) and d[0] not in want)
        bad = misread(t, written, read)
        if bad != t:
            want[k] = t
            damaged.append((k, bad))
    bad = dict(damaged)
    k, _, t = next(d for d in docs if d[1] == "de" and d[0] not in want)
    bad[k], want[k] = misread(misread(t, "utf-8", "cp1252"), "utf-8", "cp1252"), t
    k, _, t = next(d for d in docs if d[1] == "fr" and d[0] not in want)
    lines = t.split("\n")
    bad[k], want[k] = "\n".join([*lines[:3], misread(lines[3], "utf-8", "cp1252"), *lines[4:]]), t
    rows = [(k, bad.get(k, t), "clash") for k, _, t in docs]
    rows += [(500, None, ""), (501, "", ""), (502, "plain ascii", ""), (503, "lost caf\ufffd", ""), (504, "keep\u00a0it\u00a0apart \u00adand ﬁne │├─", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, restored_text string")
    assert {r["doc_id"] for r in find_garbled(df).collect()} == set(want) | {503}
    out = {r["doc_id"]: r for r in restore_texts(df).collect()}
    assert set(out) == set(want) | {503}
    same = [k for k in want if out[k]["restored_text"] == want[k]]
    assert len(same) >= len(want) - 1, [k for k in want if k not in same]
    assert out[503]["has_losses"]


def test_readings_hold_the_true_one():
    assert ("utf-8", "cp1252") in readings("Ã©")["é"]
    assert ("utf-8 twice", "cp1252") in readings("ÃƒÂ©")["é"]
    assert any(k == ("koi8-r", "cp1251") for k in readings("ЧПДБ")["вода"])
    assert all(r != "é" for r in readings("é"))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert find_garbled(df).count() == 0 and restore_texts(df).count() == 0


@pytest.mark.parametrize("text", ["é", "a" * 200_000 + "é"])
def test_single_documents(spark, text):
    assert find_garbled(spark.createDataFrame([(1, text)], "doc_id long, text string")).count() == 0


def test_one_page_for_a_large_source(spark):
    docs = [(k, t) for k, lang, t in corpus(400) if lang in ("de", "fr")]
    bad = {k for k, _ in docs if k % 5 < 3}
    rows = [(k, "Large " if k in bad else f"small{k % 4}", misread(t, "cp1252", "cp850") if k in bad else t) for k, t in docs]
    # one of the large source that is clean
    rows += [(900, "large", docs[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert {r["doc_id"] for r in find_garbled(df).collect()} == bad
    out = {r["doc_id"]: r["restored_text"] for r in restore_texts(df).collect()}
    assert out == {k: t for k, t in docs if k in bad}


@pytest.mark.parametrize("written,read", [("latin-1", "cp1253"), ("utf-8", "cp1257")])
def test_a_swap_that_is_on_no_list_is_learned_by_source(spark, written, read):
    assert read not in CODE_PAGES
    docs = [(k, t) for k, lang, t in corpus(300) if lang in ("de", "fr")]
    bad = {k for k, _ in docs if k % 6 == 1}
    rows = [(k, "odd" if k in bad or k % 6 == 2 else f"other{k % 4}", misread(t, written, read) if k in bad else t) for k, t in docs]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert {r["doc_id"] for r in find_garbled(df).collect()} == bad
    out = {r["doc_id"]: r["restored_text"] for r in restore_texts(df).collect()}
    true = dict(docs)
    words = [(x, y) for k in bad for x, y in zip(out[k].split(), true[k].split(), strict=True) if not y.isascii()]
    # a letter that is seen in one word only can be taken for another
    assert sum(x == y for x, y in words) > 0.9 * len(words)


def test_rare_symbols_that_belong_to_the_text(spark):
    docs = [(k, t) for k, lang, t in corpus(200)]
    docs += [(500 + k, f"the angle α{k} and β, x ≥ γ, ∀δ ∈ Ω; {t}") for k, t in docs[:6]]
    assert find_garbled(spark.createDataFrame(docs, "doc_id long, text string")).count() == 0


def test_both_sides_of_the_size_switch_agree(spark, monkeypatch):
    docs = [(k, t if k % 7 else misread(t, "utf-8", ("cp1252", "cp850", "cp1251")[k % 3])) for k, _, t in corpus(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    a = {r["doc_id"] for r in find_garbled(df).collect()}
    monkeypatch.setattr(garble, "BROADCAST_ROWS", -1)
    assert {r["doc_id"] for r in find_garbled(df).collect()} == a == {k for k, _ in docs if k % 7 == 0}


def test_four_kinds_of_damage_in_one_text(spark):
    clean = corpus(150)
    t = next(t for _, lang, t in clean if lang == "de")
    lines = t.split("\n")
    bad = [misread(x, "utf-8", p) for x, p in zip(lines, ("cp1252", "cp850", "cp1251", "mac_roman"), strict=False)] + lines[4:]
    df = spark.createDataFrame([(k, t) for k, _, t in clean] + [(900, "\n".join(bad))], "doc_id long, text string")
    out = restore_texts(df).collect()
    assert [r["doc_id"] for r in out] == [900] and out[0]["restored_text"] == t and len(out[0]["swaps"]) == 4
