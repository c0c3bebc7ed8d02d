"""Name expressions, contract checks and summaries on small fixtures with their edge rows."""

import pytest
from pyspark.sql import functions as F

from inkwell.functions import names as N
from inkwell.operators import contracts as C, reports as R


def one(spark, column, value, ddl="string"):
    return spark.createDataFrame([(value, 1)], f"c {ddl}, n int").select(column("c").alias("r")).first()["r"]


def test_names(spark):
    path = lambda c: N.path_name(c, "none")
    assert [one(spark, path, v) for v in (None, "", " . ", 'a/b:"c"  d. ', "天\t地")] == ["none", "none", "none", "a_b_c_ d", "天 地"]
    cases = {"第1.5章": "第1.5章", "a.b": "a·b", "等等...": "等等...", "图.jpg": "图.jpg", "图.jpgx": "图·jpgx", ".": "·", "1.": "1·", "A.1": "A·1"}
    assert {k: one(spark, N.title_dots, k) for k in cases} == cases and one(spark, N.title_dots, None) is None
    assert [one(spark, N.is_mirror_line, v) for v in (None, "", "（•ｃｏｍ）", "想看更多请到《某站》", "域名《天地》最新章节", "他想看雪")] == [False, False, True, True, True, False]
    assert one(spark, N.damage, "天*地 锟斤拷") == ["mojibake", "missing_text_marker"] and one(spark, N.damage, None) == [] and one(spark, N.damage, "天\\地") == ["damaged_character", "escape_residue"]
    assert one(spark, N.declared_author, ["《书》", " 作者： 甲 ", "作者：乙"], "array<string>") == "甲" and one(spark, N.declared_author, [None, "x"], "array<string>") is None and one(spark, N.declared_author, ["x"] * 8 + ["作者：甲"], "array<string>") is None
    url = lambda c: N.query_value(c, "novelid")
    assert [one(spark, url, v) for v in (None, "http://x/?a=1&novelid=22#t", "http://x/?novelid=", "novelid=3")] == [None, "22", None, None]
    assert one(spark, N.declarations, "Color: red; ; margin:0 ; color : blue;bad") == {"color": "blue", "margin": "0"} and one(spark, N.declarations, None) == {}
    fields = lambda c: N.unknown_fields(c, ["title", "tags"])
    assert one(spark, fields, "title, x,,x ,tags") == ["x"] and one(spark, fields, None) is None
    assert one(spark, N.distinct_filled, ["a", " ", None, "a", "b "], "array<string>") == ["a", "b"]
    a = spark.createDataFrame([("m", "k")], "m string, k string").select(N.anchor("m", "k").alias("r")).first()["r"]
    assert a.startswith("anchor-") and len(a) == 27


def test_checks_break_on_their_rule(spark):
    v = spark.createDataFrame([("a", 1, "x", 5), ("b", 1, "x", 5), ("a", 2, None, 5), ("b", 2, "y", 5), ("a", 3, "z", 5), (None, 9, "q", 5)], "view string, id int, split string, views int")
    got = {r["id"]: (r["missing"], r["differing"]) for r in C.misaligned(v.drop("views"), "view", ["id"], ["split"]).collect()}
    assert got == {2: (0, "split"), 3: (1, "")}
    a, b = spark.createDataFrame([("x",), (None,), ("y",)], "k string"), spark.createDataFrame([("y",), ("z",), ("z",)], "k string")
    assert {tuple(r) for r in C.one_sided(a, b, ["k"]).collect()} == {("x", "left"), (None, "left"), ("z", "right")}
    assert C.one_sided(a, a, ["k"]).count() == 0
    n = spark.createDataFrame([("b", 1), ("b", 2), ("b", 4), ("c", 1), ("c", 1), ("d", 7), (None, 1), (None, 3), ("e", None)], "b string, k int")
    assert {(r["b"], r["missing"], r["repeated"]) for r in C.uncovered(n, ["b"], "k").collect()} == {("b", 1, 0), ("c", 0, 1), (None, 1, 0)}
    t = spark.createDataFrame([(1, "天地玄黄宇宙洪荒日"), (2, None), (3, "短")], "id int, t string")
    ref = spark.createDataFrame([("x天 地玄黄宇宙洪荒",)], "t string")
    assert {tuple(r) for r in C.introduced_grams(t, ref, t.limit(0), "id", "t").collect()} == {(1, "天地玄黄宇宙洪荒")}
    assert C.introduced_grams(t, ref, t, "id", "t").count() == 0
    p = spark.createDataFrame([(1, 1, ["甲", None, "乙"]), (1, 2, ["甲", "乙", "丙"]), (1, 3, ["丁"]), (1, 4, None), (2, 5, ["甲"]), (None, 6, ["甲"])], "b int, c int, p array<string>")
    assert {(r["c"], r["same"], r["prefix"]) for r in C.repeated_openings(p, "b", "c", "p").collect()} == {(2, 2, 2), (3, 0, 0)}
    g = spark.createDataFrame([(1, ["a", None, " ", "b", "c", ""]), (2, None), (3, [])], "k int, p array<string>")
    assert [tuple(r) for r in C.blank_gaps(g, "k", "p").collect()] == [(1, 0, 2)]
    e = C.exposed(t, "id", [("text", "t", spark.createDataFrame([("短",), (None,)], "x string")), ("again", "t", spark.createDataFrame([("短",)], "x string"))])
    assert {tuple(r) for r in e.collect()} == {(3, "text"), (3, "again")}
    for check in (lambda: C.misaligned(v.limit(0), "view", ["id"], ["split"]), lambda: C.uncovered(n.limit(0), ["b"], "k"), lambda: C.blank_gaps(g.limit(0), "k", "p"), lambda: C.repeated_openings(p.limit(0), "b", "c", "p")):
        assert check().count() == 0


def test_summaries(spark):
    s = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 3.0), ("a", 2, 5.0), ("b", 1, 2.0), ("b", 2, 1.0), ("b", None, 9.0), ("c", 3, None)], "arm string, u int, v double")
    assert {r["arm"]: (r["units"], r["mean"]) for r in R.equal_weight_means(s, "arm", "u", "v").collect()} == {"a": (2, 3.5), "b": (3, 4.0)}
    assert [tuple(r) for r in R.pairwise_outcomes(s, "arm", "u", "v").collect()] == [("a", "b", 1, 1, 0)]
    o = spark.createDataFrame([("a", 1, 0.5), ("a", None, None), ("a", 0, 1.5), ("b", None, None)], "arm string, o int, l double")
    got = {r["arm"]: tuple(r)[1:] for r in R.arm_summary(o, ["arm"], "o", "l").collect()}
    assert got["a"] == (3, 1, 0.5, pytest.approx(1 / 3), pytest.approx(2 / 3), 1.0, 1.0) and got["b"] == (1, 1, None, 0.0, 1.0, None, None)
    d = spark.createDataFrame([({"x": 1.0, "y": 2.0}, {"x": 3.0, "z": 2.0}), ({}, {})], "a map<string,double>, b map<string,double>")
    assert [r[0] for r in d.select(R.deltas(F.col("a"), F.col("b"))).collect()] == [{"x": -2.0}, {}]
    assert [r[0] for r in d.select(R.map_similarity(F.col("a"), F.col("b"))).collect()] == [pytest.approx(1 / (1 + 12**0.5)), 1.0]
    w = spark.createDataFrame([(1, k, v) for k, v in enumerate([1, 5, 5, 0, 5, 5])] + [(2, 0, 3)], "g int, k int, v int")
    assert {tuple(r) for r in R.busiest_window(w, "g", "k", "v", 2).collect()} == {(1, 1, 10), (2, 0, 3)}
    z = spark.createDataFrame([(1, 5, 0), (2, 5, 9), (3, 6, 0)], "id int, a int, b int")
    assert {tuple(r) for r in R.best_percentile(z, "id", ["a", "b"]).collect()} == {(1, "a", 2 / 3), (2, "b", 1.0), (3, "a", 1.0)}
    c = lambda rows: spark.createDataFrame(rows, "feature string, z double, support int")
    assert [tuple(r) for r in R.confirmed_contrasts(c([("f", 3.0, 9), ("g", -3.0, 9), ("h", 3.0, 1), ("i", 0.5, 9)]), c([("f", 1.0, 1), ("g", 1.0, 1), ("h", 1.0, 1)]), 2.0, 5).collect()] == [("f", 3.0, 1.0)]
    f = spark.createDataFrame([("a", "x", 3.0), ("a", "y", 4.0), ("b", "x", 1.0)], "g string, f string, w double")
    assert [tuple(r) for r in R.without_features(f, "g", "f", "w", F.col("f") == "x").collect()] == [("a", "y", 1.0)]
    for out in (R.best_percentile(z.limit(0), "id", ["a", "b"]), R.rate_bootstrap(z.limit(0), "id", "a"), R.busiest_window(w.limit(0), "g", "k", "v", 2), R.pairwise_outcomes(s.limit(0), "arm", "u", "v")):
        assert out.count() == 0
