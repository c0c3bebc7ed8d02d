import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from inkwell.functions import views as V
from inkwell.operators import catalogue as K, sequences as S, splits as SP, statistics as T
from inkwell.sources import readers as R, writers as W


def test_views():
    assert V.skeleton("“因为下雪。”他说。\n\n走了abc<NUM>！") == "“因为C。”C说。¶C！"
    assert V.counterfactual("因为下雪a1，") == "因为下龘XX，" and V.topic_swapped("雪夜归人", ["雪夜", "雪"]) == "龘龘归人" and V.topic_swapped("x", []) == "x"
    assert V.style_ablated("因为下雪，的") == "龘雪龘" and V.dialogue_shape("他说“好的”\n走") == "C“S”¶C"
    assert V.han_window("天a地，玄黄", 1, 2) == "地，玄" and V.han_window("天", 3, 1) == "" and V.truncated("abcdef", 4) == "abc…"
    assert V.number_loss("3个人走了三十里", "3个人走了很远") == ["三十"] and V.number_loss("", "") == []
    text = "天地\n玄黄宇宙\n洪荒"
    assert V.excerpt_start(text, "k", 2) in (0, 3, 8) and V.excerpt_start(text, "k", 99) == 0


@settings(max_examples=200, deadline=None)
@given(st.text("天地，。“”\nab1因为", max_size=40))
def test_skeleton_has_no_runs(text):
    s = V.skeleton(text)
    assert "CC" not in s and "¶¶" not in s and set(s) <= set("C¶，。“”因为")


def test_windows():
    assert S.word_windows([100, 150, 20], 230, 120) == [(0, 3)] and S.word_windows([10], 230, 120) == [] and S.word_windows([230, 130], 230, 120) == [(0, 1), (1, 2)]
    assert S.excerpt_windows([200, 200, 400, 10], 330, 520) == [(0, 2), (2, 3)]
    assert S.aligned_windows([700, 900, 100]) == [(0, 1), (1, 3)] and S.aligned_windows([]) == []
    assert S.numbered_items(["1. a", "x", "2. b"]) == [0, 2] and S.numbered_items(["1. a", "3. b"]) == [] and S.numbered_items(["一、a"]) == []
    assert S.rejoined(["他说，", "好", "”", "走"]) == ["他说，好”", "走"]
    assert S.note_ranges(["正文", "作者有话要说：谢谢", "明天见", "***", "第二章", "（作者的话）"]) == [(1, 3), (5, 6)]


@given(st.integers(1, 30), st.lists(st.integers(0, 29), max_size=8), st.integers(1, 6))
def test_covering_windows(n, failed, width):
    failed = [f for f in failed if f < n]
    w = S.covering_windows(n, failed, width)
    assert all(0 <= a < b <= n and b - a <= width for a, b in w)
    assert set(failed) <= {k for a, b in w for k in range(a, b)}


def test_diverse_selection_keeps_its_distance():
    rows = [{"id": i, "book": i % 2, "at": i, "scene": "xyz"[i % 3]} for i in range(30)]
    got = SP.diverse(rows, 6, ["scene", "book"], "book", "at", 3, "s")
    assert len(got) == 6 and {r["scene"] for r in got} == set("xyz") and sum(r["book"] for r in got) == 3
    assert all(a is b or a["book"] != b["book"] or abs(a["at"] - b["at"]) > 3 for a in got for b in got)
    assert got == SP.diverse(rows[::-1], 6, ["scene", "book"], "book", "at", 3, "s") and SP.diverse([], 3, [], "book", "at", 1, "s") == []


def test_paired_difference(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 1, 1), ("b", 0, 0), ("c", 1, 0), ("c", None, 1)], "c string, x int, y int")
    r = T.paired_difference(df, "c", "x", "y").first()
    assert r["mean"] == 0.5 and (r["both"], r["only_a"], r["only_b"], r["neither"]) == (1, 2, 0, 1) and r["lower"] <= 0.5 <= r["upper"]


def test_freedman_lane():
    rng = np.random.default_rng(0)
    x = np.column_stack([np.ones(40), rng.normal(size=40)])
    z = rng.normal(size=40)
    strong, p = T.freedman_lane(x[:, 1] + 3 * z + 0.1 * rng.normal(size=40), x, z[:, None], 199)
    assert strong > 0.9 and p <= 0.01
    _, p = T.freedman_lane(x[:, 1] + rng.normal(size=40), x, z[:, None], 199)
    assert p > 0.01


def test_pages():
    page = "<table><tr><th>名</th><th>字数</th></tr><tr><td> 雪 <b>夜</b></td><td>3</td></tr><tr></tr></table><a href='/c/1.html'>一</a><a href='/c/1.html#x'>again</a><a href=/c/2.html>二</a><a href=/x>no</a>"
    assert R.html_tables(page) == [[["名", "字数"], ["雪 夜", "3"]]]
    assert R.listing(page, {"title": 0, "words": 1}) == [{"title": "名", "words": "字数"}, {"title": "雪 夜", "words": "3"}]
    assert R.contents(page, "http://h.example/b/", r"/c/\d+") == [{"url": "http://h.example/c/1.html", "title": "一"}, {"url": "http://h.example/c/2.html", "title": "二"}]
    assert R.provider("https://m.a.example/x", {"p": ("example",), "q": ("a.example",)}) == "q" and R.provider("x", {"p": ("example",)}) is None
    doc = {"data": {"relationships": {"posts": {"data": [{"type": "post", "id": "2"}, {"type": "post", "id": "1"}, {"type": "post", "id": "9"}]}}}, "included": [{"type": "post", "id": "1", "attributes": {"t": "a"}}, {"type": "post", "id": "2", "attributes": None}]}
    assert R.collection(doc) == [{"id": "2"}, {"id": "1", "t": "a"}] and R.collection({}) == []


def test_runs():
    runs = [{"text": "天地", "bold": True}, {"text": "玄黄", "bold": False}]
    assert R.replace_run_text(runs, "天X地黄") == [{"text": "天X地", "bold": True}, {"text": "黄", "bold": False}]
    assert R.slice_runs(runs, 1, 3) == [{"text": "地", "bold": True}, {"text": "玄", "bold": False}] and R.slice_runs(runs, 3, 3) == []


def test_artifacts(tmp_path):
    p = str(tmp_path / "a.txt")
    assert W.write_once(p, "x") == W.write_once(p, "x")
    with pytest.raises(ValueError):
        W.write_once(p, "y")
    assert W.markdown_table(["a", "b"], [("x|y", None), (1.5, "z")]) == "| a | b |\n|---|---|\n| x\\|y |  |\n| 1.5 | z |\n"
    assert W.bar_chart("t<", [("a", 2.0), ("b", 0.0)]).count("<rect") == 2 and "t&lt;" in W.bar_chart("t<", [])


def test_outlines():
    tree = [{"member": "a"}, {"title": "v", "children": [{"member": "b"}, {"member": "b"}]}]
    assert K.ordered_members(tree) == ["a", "b", "b"] and K.outline_problems(tree, ["a", "b", "c"]) == ["missing c", "twice b"]
    with pytest.raises(ValueError):
        K.ordered_members([{"title": "v", "children": []}])
    assert K.walk({"a": ["x", {"b": "y"}, 3]}) == [(("a", "0"), "x"), (("a", "1", "b"), "y")]
