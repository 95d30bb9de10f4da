"""Forms of text: what must be equal, what must stay different."""

import itertools

import pytest

from knotwork.llm.textforms import full_form, look_alike_classes, look_alike_pairs, normalized, visual_form

SAME = [
    ("café", "café", "ca​fé", "ｃａｆé", "сafé", " café\n", "ca­f͏é", "﻿café "),
    ("two words", "two words", "two \t\r\n words", "two　words", "two​  words", "two words"),
    ("file office", "ﬁle oﬃce", "fi⁠le of‍fice"),
    ("well-known", "well‐known", "well‑known", "well－known"),
    ("Рaper HOPE", "Paper HOPE", "Ρaper ΗΟΡΕ", "Paper НОРЕ"),
    ("ガ", "ガ", "ｶﾞ"),
    ("ё", "ё", "ë"),
    ("", " \n​", "　﻿"),
]
DIFFERENT = ["Café", "café", "cafe", "CAFE", "m2", "m²", "m₂", "a-b", "a–b", "a—b", "a b", "ab", "0", "O", "1", "l", "I", "rn", "m", "a.", "a", "½", "1/2", "'", "’", "ß", "ss", "x…", "x...", "№", "No", "①"]


def test_same():
    for group in SAME:
        assert len({visual_form(t) for t in group}) == 1, group
    assert len({visual_form(g[0]) for g in SAME}) == len(SAME)


def test_letters_of_other_scripts_without_a_latin_twin():
    for group in (("Γ", "Г", "Ⲅ"), ("Π", "П", "Ⲡ"), ("Φ", "Ф", "Ⲫ"), ("φ", "ф", "ⲫ"), ("æ", "ӕ"), ("k", "к", "κ")):
        assert len({visual_form(t) for t in group}) == 1, group
    assert visual_form("a\ufff9b") == "ab" and full_form("a\ufff9b") != "ab"  # not ignorable by its property, but not seen


def test_forms_differ_by_folding_and_what_is_kept():
    """The visual form is the named form without folding, but for kept signs and letters of other scripts."""
    import sys
    import unicodedata

    from knotwork.llm.textforms import SAME_SHAPE, HYPHENS

    moved = {c for there, _ in SAME_SHAPE for c in there} | set(HYPHENS)
    for code in range(0x20, sys.maxunicode):
        ch = chr(code)
        seen = visual_form("x" + ch + "x")
        if unicodedata.category(ch) != "Cs" and not {ch, *unicodedata.normalize("NFKD", ch)} & moved and seen != "x" + ch + "x" and not 0xFFF9 <= code <= 0xFFFB:
            assert full_form(seen) == full_form("x" + ch + "x"), hex(code)


def test_copied_pages_are_met_in_blocks(spark, monkeypatch):
    """One spelling of a page holds most rows, another few: every pair across them, none within."""
    from knotwork.operators import skew

    monkeypatch.setattr(skew.block_join, "__defaults__", (50,))
    monkeypatch.setattr(skew.Crowded.of, "__defaults__", (50,))
    df = spark.range(600).selectExpr("id as doc", "if(id % 200 = 7, 'soft​ error', 'soft error') as text")
    pairs = {tuple(r) for r in look_alike_pairs(df, "doc", "text").collect()}
    assert pairs == {tuple(sorted((a, b))) for a in (7, 207, 407) for b in range(600) if b % 200 != 7}


def test_different():
    for a, b in itertools.combinations(DIFFERENT, 2):
        assert visual_form(a) != visual_form(b), (a, b)


@pytest.mark.parametrize("form", [visual_form, full_form])
def test_idempotent(form):
    for text in [*DIFFERENT, *itertools.chain(*SAME), "Straße ΣΊΣΥΦΟΣ ﬅ ǅ İ ŉ ㎏ ℌ ｶﾞ 각 각 ̈́ ̀"]:
        assert form(form(text)) == form(text), text


def test_full_form():
    assert full_form("Straße") == full_form("STRASSE") == "strasse"
    assert full_form("m² Ａ​B ﬁ") == "m2 ab fi"
    assert full_form("ΣΊΣΥΦΟΣ") == full_form("σίσυφος")


def test_ascii_is_never_a_look_alike():
    seen = {visual_form(chr(c)) for c in range(33, 127)}
    assert len(seen) == 94


def test_column(spark):
    long = "Ａ​" * 100_000
    df = spark.createDataFrame([(1, "Ａ"), (2, None), (3, ""), (4, long), (5, "Ａ")], "id bigint, t string")
    got = {r["id"]: (r["f"], r["v"]) for r in df.select("id", normalized("t").alias("f"), normalized("t", visual=True).alias("v")).collect()}
    assert got == {1: ("a", "A"), 2: (None, None), 3: ("", ""), 4: ("a" * 100_000, "A" * 100_000), 5: ("a", "A")}


def test_pairs(spark, rows):
    data = [(1, "café"), (2, "café"), (3, "café"), (4, "cafe"), (5, None), (6, ""), (7, "​x"), (8, "x "), (9, "x"), (10, "y"), (11, "y"), (2, "café"), (12, " "), (13, "\n")]
    df = spark.createDataFrame(data, "doc bigint, text string").selectExpr("doc", "text", "1 as id", "2 as form_key", "3 as spelling")
    assert rows(look_alike_pairs(df, "doc", "text"), "id_a", "id_b") == sorted([(1, 2), (2, 3), (7, 8), (7, 9), (8, 9), (12, 13)], key=repr)
    assert look_alike_classes(df, "doc", "text").count() == 12
    assert look_alike_pairs(df.limit(0), "doc", "text").count() == 0


def test_copies_of_one_spelling_never_meet(spark):
    df = spark.range(20_000).selectExpr("id as doc", "if(id = 77, 'soft​ error', 'soft error') as text")
    assert look_alike_pairs(df, "doc", "text").count() == 19_999
