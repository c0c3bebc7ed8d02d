from hypothesis import given, settings, strategies as st

import numpy as np
from inkwell.functions.textform import consistent, variant_pattern
from inkwell.llm import lookalike as L
from inkwell.llm.points import TOP

DDL = "chapter_id long, title string, paragraphs array<string>, book_id long, id string, form string"
PAIRS = {
    "ＡＰＰ１２３": "APP123", "ﬁre ﬂag oﬃce": "fire flag office", "café": "café", "Ａ̊ngel": "Ångel", "看​见﻿了⁠": "看见了", "so­ft": "soft",
    "a b c　d": "a b c d", "　　缩进": "　　缩进", "他　　说": "他  说", "Воss": "Boss", "ΝΡС": "ΝΡС", "ΝPС": "NPC", "Спасибо": "Спасибо", "γνῶσις": "γνῶσις",
    "雨⽔": "雨水", "修行": "修行", "👩‍🚀": "👩‍🚀", "❤️‍🔥": "❤️‍🔥", "a‍b": "ab", "①Ⅲ㎏，！": "①Ⅲ㎏，！", "Chарtér": "Chaptér", "\u1112\u1161\u11ab": "\ud55c", "": "", "plain": "plain",
}
TEXT = st.text("aeＡｅ１é́̊​‍　  оеСР中⽔行ﬁ👩🚀。", max_size=30)


def counts_of(*texts):
    out = np.zeros(TOP, dtype=np.int64)
    for t in texts:
        for c in t:
            out[ord(c)] += 1
    return out


def test_rules():
    for a, b in PAIRS.items():
        assert consistent(a) == b, a
        assert consistent(b) == b


@settings(max_examples=1500, deadline=None)
@given(TEXT)
def test_automaton_gives_the_consistent_form(text):
    r = L.Rewriter(counts_of(text, *PAIRS, *PAIRS.values()))
    assert r(text) == consistent(text)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_form_is_a_fixed_point(text):
    assert consistent(consistent(text)) == consistent(text)


def test_variants(spark):
    rows = [(i, a, [None, a, b, ""], 1, "x", "y") for i, (a, b) in enumerate(PAIRS.items())]
    rows += [(100, None, None, 1, "x", "y"), (101, "Ａ", [], None, "x", "y"), (102, None, ["中" * 30_000 + "Ａ"], 1, "x", "y")]
    df = spark.createDataFrame(rows, DDL)
    got = {(r["id"], r["para_no"]): r["form"] for r in L.variants(df, skip_garbled=False).collect()}
    want = {(101, -1): "A", (102, 0): "中" * 30_000 + "A"}
    for i, (a, b) in enumerate(PAIRS.items()):
        if a != b:
            want[i, -1] = want[i, 1] = b
    assert got == want
    assert L.variants(df.limit(0)).count() == 0


def test_jvm_pattern_misses_nothing(spark):
    df = spark.createDataFrame([(a,) for a in [*PAIRS, *PAIRS.values()]], "t string")
    found = {r["t"] for r in df.where(df["t"].rlike(variant_pattern())).collect()}
    assert {a for a, b in PAIRS.items() if a != b} <= found


def test_garbled_paragraphs_are_left_out(spark):
    rows = [(i, "好", ["他慢慢放下茶杯，看着窗外的雪。"] * 5, i % 3, "x", "y") for i in range(300)]
    rows[7] = (7, "好", ["他慢慢ＡＢ放下茶杯", "看着�ＡＢ窗外"], 1, "x", "y")
    got = {(r["id"], r["para_no"]) for r in L.variants(spark.createDataFrame(rows, DDL)).collect()}
    assert got == {(7, 0)}


def test_frequency_decides_where_no_form_is_given():
    often_composed, often_apart = counts_of("é" * 9 + "é"), counts_of("é" + "é" * 9)
    assert L.look_classes(often_composed, False, None)["é"] == "é"
    assert L.look_classes(often_apart, False, None)["é"] == "é"
    assert L.look_classes(often_apart, False)["é"] == "é" and "é" not in L.look_classes(often_apart, False)  # the form overrules it
    radicals, ideographs = counts_of("⽔" * 9 + "水"), counts_of("⽔" + "水" * 9)
    assert L.look_classes(radicals, False, None)["水"] == "⽔" and L.look_classes(ideographs, False, None)["⽔"] == "水"
