"""Operators against brute force on small fixtures, with the edge rows every fixture has."""

import random
import re
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from inkwell.functions import text as X
from inkwell.operators import changes as CH, corpus as C, evaluation as E, features as FE, joins as J, learning as L, masking as M, profiles as P, sequences as S, similarity as SI, splits as SP, statistics as T

TEXTS = "doc_id long, text string, id string, term string, n int"


def texts(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], TEXTS)


# ---- near duplicates ----------------------------------------------------------------


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(1, 80))]
        rows.append((i, " ".join(base)))
        if i % 3 == 0:
            b = list(base)
            for _ in range(rng.randint(0, 2)):
                b[rng.randrange(len(b))] = rng.choice(words)
            rows.append((100 + i, " ".join(b)))
    rows += [(200, None), (201, ""), (202, " ,. "), (203, rows[0][1]), (204, "天地玄黄" * 3000), (204, "天地玄黄" * 3000), (205, "天地玄黄" * 2999)]
    df = texts(spark, rows)
    sets = {i: frozenset(SI.shingle_hashes(t)) for i, t in rows if t and SI.shingle_hashes(t)}
    rep = {}
    for i in sorted(sets):
        rep.setdefault(sets[i], i)
    reps = sorted(rep.values())
    want = {(a, b) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert {(r["a"], r["b"]) for r in SI.near_pairs(df, "doc_id", "text").collect()} == want
    got = {r["id"]: (r["class_id"], r["links"]) for r in SI.near_duplicates(df, "doc_id", "text").collect()}
    assert set(got) == set(sets)
    for i in sets:
        r = rep[sets[i]]
        assert got[i][1] == sum(r in p for p in want) and got[i][0] == got[r][0] <= i
    for a, b in want:
        assert got[a][0] == got[b][0]
    assert SI.near_duplicates(df.limit(0), "doc_id", "text").count() == 0


def _unlike(rng, n, length):
    return [" ".join(f"w{rng.randrange(50_000)}" for _ in range(length)) for _ in range(n)]


def _room(monkeypatch):
    """Sizes of the tables that near duplicates cut from now on."""
    sizes, cut = [], SI.cut

    def counted(df, *args):
        out = cut(df, *args)
        sizes.append(sum(Path(f.removeprefix("file:")).stat().st_size for f in out.inputFiles()))
        return out

    monkeypatch.setattr(SI, "cut", counted)
    return sizes


def test_near_pairs_write_less_than_the_texts(spark, monkeypatch):
    rows = list(enumerate(_unlike(random.Random(5), 300, 800)))
    rows.append((900, rows[7][1] + " end"))
    sizes = _room(monkeypatch)
    assert [(r["a"], r["b"]) for r in SI.near_pairs(texts(spark, rows), "doc_id", "text").collect()] == [(7, 900)]
    assert sum(sizes) < sum(len(t) for _, t in rows)


def test_near_duplicates_at_the_border_write_less_than_the_texts(spark, monkeypatch):
    rng = random.Random(6)
    rows = list(enumerate(_unlike(rng, 120, 1200)))
    for i in range(40):  # each word changed costs five shingles, so similarity is 0.70 to 0.95
        w = rows[i][1].split()
        for k in range(0, 1200, 1200 // (6 + i)):
            w[k] = "x"
        rows.append((500 + i, " ".join(w)))
    rows += [(600 + i, rows[7][1]) for i in range(5)]
    sets = {i: set(SI.shingle_hashes(t)) for i, t in rows}
    want = {(i, 500 + i) for i in range(40) if len(sets[i] & sets[500 + i]) >= 0.8 * len(sets[i] | sets[500 + i])}
    assert 5 < len(want) < 40
    sizes = _room(monkeypatch)
    got = {r["id"]: (r["class_id"], r["links"]) for r in SI.near_duplicates(texts(spark, rows), "doc_id", "text").collect()}
    least = {b: a for a, b in want} | {600 + i: 7 for i in range(5)}
    linked = {x for p in want for x in p} | ({600 + i for i in range(5)} if (7, 507) in want else set())
    assert got == {i: (least.get(i, i), int(i in linked)) for i, _ in rows}
    assert sum(sizes) < 2 * sum(len(t) for _, t in rows)


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}


@pytest.mark.parametrize("room", [1 << 21, 4000])  # whole groups in one place, and groups in blocks
def test_near_duplicates_with_many_links_write_less_than_the_texts(spark, monkeypatch, room):
    monkeypatch.setattr(SI, "ROOM", room, raising=False)
    base = _unlike(random.Random(7), 60, 1200)
    rows = [(10 * i + j, t + f" end {j}" * j) for i, t in enumerate(base) for j in range(7)]
    rows += [(1000 + j, " ".join(base[5].split()[80 * j :] + base[6].split()[: 80 * j])) for j in range(1, 4)]  # a chain of links
    sets = {i: set(SI.shingle_hashes(t)) for i, t in rows}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want = {(a, b) for a in sets for b in sets if a < b and near(a, b)}
    assert {(50, 1001), (1001, 1002)} <= want and (50, 1003) not in want
    sizes, before = _room(monkeypatch), _shuffle_files(spark)
    got = SI.near_pairs(texts(spark, rows), "doc_id", "text")
    for _ in range(50):  # they are deleted in the background
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert sum(sizes) < 0.5 * sum(len(t) for _, t in rows)
    assert {(r["a"], r["b"], round(r["similarity"], 9)) for r in got.collect()} == {(a, b, round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 9)) for a, b in want}


def test_best_author_looks_at_near_ones_only(spark, monkeypatch):
    rng = np.random.default_rng(2)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    x, y = unit(rng.random((300, 20))), unit(rng.random((1500, 20)))
    y[:200] = x[:200]
    y[700] = y[3]
    names = [f"a{k:04}" for k in range(1500)]
    best, score, found = P._Best(np.ones(20), 9, "id string, author string, score double"), np.zeros(300), [""] * 300
    seen, einsum = [], np.einsum
    monkeypatch.setattr(np, "einsum", lambda how, a, b: seen.append(len(a)) or einsum(how, a, b))
    for lo in range(0, 1500, 500):
        best._meet(x, y[lo : lo + 500], names[lo : lo + 500], score, found)
    exact = np.round(einsum("ij,kj->ik", x, y), 9)
    assert np.allclose(score, exact.max(axis=1), atol=1e-9) and found == [max(n for n, v in zip(names, row) if v == row.max()) for row in exact]
    assert found[3] == "a0700" and sum(seen) < 3 * 300


def test_pair_similarity():
    a = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁律吕调阳云腾致雨露结为霜金生丽水玉出昆冈剑号巨阙珠称夜光果珍李柰菜重芥姜海咸河淡鳞潜羽翔龙师火帝鸟官人皇"
    assert SI.pair_similarity(a, a)["reasons"] == ["equal"] and SI.pair_similarity("ab", "ab")["similarity"] == 1.0
    assert SI.pair_similarity("a" * 59, "a" * 58) is None and SI.pair_similarity("", a) is None
    assert SI.pair_similarity(a, a[:70] + "别的")["reasons"] == ["local"]
    assert "contained" in SI.pair_similarity(a + a[::-1], a + "。")["reasons"]
    assert SI.shared_regions("abcdeXabc", {"abc", "bcd"}, 3) == [(0, 4), (6, 9)]
    assert SI.longest_introduced("他说天地玄黄宇宙洪荒日", ["前天地玄黄宇宙洪荒后"], []) == "天地玄黄宇宙洪荒"
    assert SI.longest_introduced("他说天地玄黄宇宙洪荒日", ["前天地玄黄宇宙洪荒后"], ["天地玄黄宇宙洪荒"]) == ""
    assert SI.han_overlap("天地玄黄宇", ["天地玄黄"]) == 0.5 and SI.han_overlap("天", ["天地"]) == 0.0


@pytest.mark.parametrize("block", [4096, 7])
def test_top_k_against_all(spark, monkeypatch, block):
    monkeypatch.setattr(SI, "BLOCK", block)
    rng = np.random.default_rng(1)
    v = {i: rng.integers(-2, 3, 4).astype(float).tolist() for i in range(60)}
    df = spark.createDataFrame([*v.items(), (900, None), (901, [1.0])], "id long, v array<double>").repartition(3)
    unit = {i: np.array(x) / (np.linalg.norm(x) or 1) for i, x in v.items()}
    want = set()
    for q in range(0, 60, 7):
        best = sorted(((-round(float(unit[q] @ unit[i]), 6) + 0.0, i) for i in v if i != q))[:4]
        want |= {(q, i, k + 1) for k, (_, i) in enumerate(best)}
    got = SI.top_k(df, df.where("id % 7 = 0"), "id", "v", 4, 4)
    assert {(r["query_id"], r["id"], r["rank"]) for r in got.collect() if r["query_id"] < 900} == want


def test_hashed_vectors_count_every_gram():
    assert SI.hashed_vector("天地 玄黄").sum() == 3 + 2 + 1 and SI.hashed_vector("").sum() == 0


# ---- masks ---------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=4), max_size=8), st.text("abcd", max_size=30))
def test_matcher_is_leftmost_longest(terms, text):
    m = M.TermMatcher(terms)
    pattern = "|".join(sorted(map(re.escape, set(terms)), key=lambda t: (-len(t), t)))
    assert m.matches(text) == ([x.span() for x in re.finditer(pattern, text)] if pattern else [])


def test_masking_keeps_length(spark):
    df = texts(spark, [(1, "长河落日圆abc"), (2, None), (3, "")])
    got = {r["id"]: r["text"] for r in M.masked(df, "doc_id", F.col("text"), ["长河", "落日"]).collect()}
    assert got == {1: "某某某某圆<LATIN>", 2: None, 3: ""}
    assert M.TermMatcher([]).substitute("ab", "某", True) == "ab"


def test_canonical_terms_depend_on_order():
    assert M.canonical_terms({"林晚照", "林晚"}, {"林晚照": 100, "林晚": 100}) == ["林晚照"]
    assert M.canonical_terms({"林晚照道", "林晚照"}, {"林晚照道": 10, "林晚照": 100}) == ["林晚照"]
    assert M.canonical_terms({"林晚照道", "林晚照", "晚照"}, {"林晚照道": 10, "林晚照": 100, "晚照": 101}) == ["林晚照"]
    assert M.title_terms("雪夜《归人》") == {"雪夜", "归人"} and M.title_terms(None) == set()


# ---- sequences ------------------------------------------------------------------------


def test_pack():
    assert S.pack([800, 800, 100], 1500, 800) == [(0, 1), (1, 3)]
    assert S.pack([1500, 10], 1500, 800) == [(0, 2)] and S.pack([], 5, 2) == [] and S.pack([1], 5, 2) == [(0, 1)]


@given(st.lists(st.integers(0, 40), max_size=30))
def test_packs_are_contiguous_and_whole(sizes):
    p = S.pack(sizes, 50, 20)
    assert [k for a, b in p for k in range(a, b)] == list(range(len(sizes)))
    assert all(sum(sizes[a:b]) >= 20 for a, b in p[:-1])


@given(st.lists(st.integers(0, 30), min_size=1, max_size=9), st.integers(1, 4))
def test_balanced_blocks(sizes, k):
    from itertools import combinations

    got = S.balanced_blocks(sizes, k)
    k = min(k, len(sizes))
    cost = lambda cuts: sum((sum(sizes[a:b]) - sum(sizes) / k) ** 2 for a, b in zip([0, *cuts], [*cuts, len(sizes)]))
    best = min(cost(c) for c in combinations(range(1, len(sizes)), k - 1))
    assert abs(cost([a for a, _ in got[1:]]) - best) < 1e-6


def test_sequences_with_nulls_and_ties(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, None), ("a", 3, 5), ("a", 4, 5), ("b", 1, 7), ("c", 1, None)], "k string, o int, v int")
    r = {(x["k"], x["run_no"]): (x["value"], x["length"]) for x in S.runs(df, ["k"], ["o"], "v").collect()}
    assert r == {("a", 1): (None, 2), ("a", 2): (5, 2), ("b", 1): (7, 1), ("c", 1): (None, 1)}
    f = {(x["k"], x["o"]): x["f"] for x in S.forward_fill(df, ["k"], ["o"], "v", "f").collect()}
    assert f["a", 1] is None and f["a", 4] == 5
    n = spark.createDataFrame([("u", i, x) for i, x in enumerate([1, 2, 2, 5, 4, None, 5])], "unit string, pos int, number int")
    assert {(x["pos"], x["finding"]) for x in S.sequence_findings(n, "unit", "pos", "number").collect()} == {(1, "duplicate"), (2, "duplicate"), (3, "duplicate"), (4, "order"), (6, "duplicate")}
    assert S.runs(df.limit(0), ["k"], ["o"], "v").count() == 0


def test_chunks(spark):
    df = spark.createDataFrame([(1, ["天" * 900, None, " ", "地" * 900, "玄" * 10]), (2, None), (3, []), (4, ["x"])], "doc_id long, p array<string>")
    got = {(r["id"], r["chunk_no"]): r["han"] for r in S.chunks(df, "doc_id", F.col("p")).collect()}
    assert got == {(1, 0): 900, (1, 1): 910, (4, 0): 0}


# ---- text -----------------------------------------------------------------------------


@pytest.mark.parametrize(
    "name, fn, given_, want",
    [
        ("punctuation", X.canonical_punctuation, "他说...3.5,1:2,好--!", "他说……3.5,1:2，好——！"),
        ("quotes", X.curl_quotes, '"a"b"c"\n"odd', "“a”b“c”\n\"odd"),
        ("tidy", X.tidy, " a \r\n\r\n\r\n　b\r", "a\n\nb"),
        ("spaces", X.close_cjk_spaces, "好 ，他 说", "好，他 说"),
        ("placeholders", X.placeholders, "<LATIN>有3.5个abc-d", "<LATIN>有<NUM>个<LATIN>"),
        ("mask", X.collapse_mask_runs, "某某 某a某", "某a某"),
        ("id", X.safe_id, " a/b c ", "a_b_c"),
        ("xml", X.escape_xml, "<a&b>", "&lt;a&amp;b&gt;"),
    ],
)
def test_text(spark, name, fn, given_, want):
    df = spark.createDataFrame([(given_,), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(fn("t")).collect()]
    assert got[0] == want and got[1] is None


def test_flags(spark):
    df = texts(spark, [(1, "€€ x" * 12), (2, None), (3, "好\n好\nhttp://a"), (4, "")])
    got = {r["doc_id"]: r["f"] for r in df.select("doc_id", C.quality_flags(F.col("text"), F.col("text")).alias("f")).collect()}
    assert "systemic_encoding_corruption" in got[1] and got[2] == ["missing_txt"] and {"adjacent_duplicate_lines", "raw_url_or_domain_text"} <= set(got[3])


def test_passages_repeated_in_one_book_are_kept(spark):
    a, b = "天" * 90, "地" * 90
    df = spark.createDataFrame([("x", 0, a), ("x", 1, a), ("x", 2, b), ("y", 0, b), ("y", 1, "短")], "book string, pos long, line string")
    assert {(r["book"], r["pos"]) for r in C.marked_lines(df).collect()} == {("x", 2), ("y", 0)}
    left = C.decontaminated(df)
    assert left.count() == 3 and C.marked_lines(left).count() == 0


# ---- splits, joins, changes --------------------------------------------------------------


def test_split_of_the_target_author(spark):
    books = spark.createDataFrame([("t", f"b{i:02d}", 100 - i) for i in range(20)] + [("o", "x", 5), ("o", "y", 5), ("o", "z", 5), ("p", "q", 1)], "author string, title string, units long")
    roles = Counter((r["author"], r["role"]) for r in SP.split_books(books, "t").collect())
    assert roles == {("t", "proxy_transfer"): 2, ("t", "test"): 2, ("t", "dev"): 2, ("t", "train"): 14, ("o", "test"): 1, ("o", "dev"): 1, ("o", "train"): 1, ("p", "excluded"): 1}
    assert {r["title"]: r["role"] for r in SP.split_books(books).where("author = 'o'").collect()} == {"x": "test", "y": "dev", "z": "train"}


def test_williams_squares_are_balanced():
    for n in (2, 3, 4, 5, 6):
        rows = SP.williams_square(n)
        follows = Counter((a, b) for r in rows for a, b in zip(r, r[1:]))
        assert len(set(follows.values())) == 1 and len(follows) == n * (n - 1)


def test_interval_and_as_of_joins(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 3), i, s := rng.randint(-50, 50), s + rng.randint(0, 40)) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, i int, start long, stop long")
    got = sorted((r["i"], r["r_i"]) for r in J.interval_join(df, df, "k", 7).collect())
    assert got == sorted((a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[2] <= b[3] and b[2] <= a[3])
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 5), (None, 5)], "k string, ts int")
    right = spark.createDataFrame([("a", 2, 1.0), ("a", 5, 2.0), ("c", 1, 3.0)], "k string, ts int, v double")
    assert {(r["k"], r["ts"], r["o"]) for r in J.as_of(left, right, "k", "ts", "v", "o").collect()} == {("a", 5, 2.0), ("a", 1, None), ("b", 5, None), (None, 5, None)}


def test_adjudication(spark):
    df = spark.createDataFrame([("i", 1, True), ("i", 2, True), ("i", 3, False), ("j", 1, True), ("j", 2, False), ("j", 3, False), ("k", 1, True), ("k", 2, False)], "item string, rater int, ok boolean")
    assert {(r["item"], r["verdict"], r["decided_by"]) for r in J.two_of_three(df, "item", "rater", "ok").collect()} == {("i", True, "raters"), ("j", False, "third"), ("k", None, None)}


def test_changes_are_guarded_and_repeatable(spark):
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    base = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "k string, p string")
    ops = spark.createDataFrame(
        [("a", 1, "replace", sha("1"), "1x"), ("b", 2, "replace", "stale", "2x"), ("c", 3, "delete", sha("3"), None), ("d", 4, "append", None, "4"), ("e", 5, "append", None, "5"), ("e", 6, "append", None, "5"), ("z", 7, "replace", "x", "x")],
        "k string, op_index int, kind string, expected string, p string",
    )
    result, report = CH.apply_changes(base, ops, "k", "p")
    assert {tuple(r) for r in result.collect()} == {("a", "1x"), ("b", "2"), ("d", "4")}
    assert {r["op_index"]: r["outcome"] for r in report.collect()} == {1: "replaced", 2: "refused: changed", 3: "deleted", 4: "appended", 5: "refused: several changes", 6: "refused: several changes", 7: "refused: missing"}
    again, report = CH.apply_changes(result, ops.where("op_index = 4"), "k", "p")
    assert report.first()["outcome"] == "repeated" and again.count() == 3


# ---- evaluation and statistics ------------------------------------------------------------


def test_metrics_with_empty_classes(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "c")], "gold string, pred string")
    m = {r["label"]: (r["tp"], r["fp"], r["fn"], r["f1"]) for r in E.by_label(rows).collect()}
    assert m == {"a": (1, 0, 1, pytest.approx(2 / 3)), "b": (0, 1, 1, 0.0), "c": (0, 1, 0, 0.0)}
    s = E.summary(rows).first()
    assert s["macro_f1"] == pytest.approx(1 / 3) and s["balanced_accuracy"] == 0.25


def test_ranking_statistics(spark):
    rng = random.Random(7)
    rows = [(rng.randint(0, 1), rng.randint(0, 9) / 10) for _ in range(200)]
    df = spark.createDataFrame(rows, "truth int, score double")
    pos, neg = [s for t, s in rows if t], [s for t, s in rows if not t]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert E.auc(df).first()["auc"] == pytest.approx(want)
    best = E.choose_threshold(E.threshold_table(df), 0.3, 0.3).first()
    ok = [t for t in sorted({s for _, s in rows}) if sum(p >= t for p in pos) / len(pos) >= 0.3 and sum(n < t for n in neg) / len(neg) >= 0.3]
    assert best["threshold"] == ok[0]
    constant = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert T.spearman(constant, "a", "b").first()["rho"] is None
    assert T.wilson_lower(0, 0) == 0.0 and T.wilson_lower(8, 10) == pytest.approx(0.4902, abs=1e-3)


def test_weights_have_equal_mass(spark):
    df = spark.createDataFrame([("a", "x")] * 3 + [("a", "y")] + [("b", "z")] * 4, "author string, title string")
    w = E.hierarchical_weights(df, "author", "title").groupBy("author").agg(F.sum("weight").alias("w")).collect()
    assert all(r["w"] == pytest.approx(4.0) for r in w)
    w = E.hierarchical_weights(df, "author", "title", "a").agg(F.sum("weight")).first()[0]
    assert w == pytest.approx(8.0)


# ---- features and learning ---------------------------------------------------------------


def test_flow_metrics(spark):
    text = "“因为不得不走。”他说：\n雪……落！"
    assert FE.quoted_han("“天”地‘玄") == 2
    df = texts(spark, [(1, text), (2, None), (3, ""), (4, "天" * 20_000)])
    flow = {r["doc_id"]: r for r in FE.flow_metrics(df, "doc_id", "text").collect()}
    assert set(flow) == {1, 3, 4} and flow[3]["mean_sentence"] == 0.0 and flow[1]["sentences"] == 2


def test_classifier_and_calibration(spark):
    rng = random.Random(2)
    rows = [(i, "甲" if i % 2 else "乙", ("天地玄黄" if i % 2 else "宇宙洪荒") * rng.randint(2, 5)) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, author string, text string").withColumn("grams", L.gram_column("text"))
    assert sorted(df.select(L.gram_column("text").alias("g")).first()["g"]) == sorted(s[i : i + n] for s in [rows[0][2]] for n in (2, 3) for i in range(len(s) - n + 1))
    index, model = L.fit(df.where("id < 60"), "author", features=1 << 10)
    assert all(r["pred"] == r["author"] for r in L.predict(index, model, df.where("id >= 60")).collect())
    scored = spark.createDataFrame([(i % 7, i / 100, int(rng.random() < i / 100)) for i in range(1, 100)], "g int, score double, truth int")
    out = L.cross_fitted(scored, "g", "score", "truth").collect()
    assert len(out) == 99 and all(0 <= r["calibrated"] <= 1 for r in out)
    with pytest.raises(ValueError):
        L.ensemble(scored, {"score": 0.4, "truth": 0.5})


def test_profiles_prefer_their_own_author(spark):
    counts = spark.createDataFrame([("a", "x", 9), ("a", "y", 1), ("b", "y", 9), ("b", "z", 5)], "author string, feature string, n long")
    docs = spark.createDataFrame([("1", "x", 3), ("2", "y", 2), ("3", "none", 1)], "id string, feature string, n long")
    got = {r["id"]: r["pred"] for r in P.predict(P.score(docs, P.fit_profiles(counts, 10))).collect()}
    assert got == {"1": "a", "2": "b"}
    dense = {r["id"]: (r["pred"], r["score"]) for r in P.best_author(docs, P.fit_profiles(counts, 10), block=1).collect()}
    assert dense == {r["id"]: (r["pred"], r["score"]) for r in P.predict(P.score(docs, P.fit_profiles(counts, 10))).collect()}


def test_global_order_is_that_of_one_sort(spark):
    from inkwell.operators import order as O

    rng = random.Random(1)
    rows = [(x, rng.randint(0, 9)) for x in rng.sample(range(1000), 200)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(5)
    for down in (False, True):
        total, want = 0, {}
        for k, v in sorted(rows, reverse=down):
            want[k] = total
            total += v
        assert {r["k"]: r["b"] for r in O.with_prefix(df, "k", {"v": "b"}, down).collect()} == want
    assert {r["k"]: r["no"] for r in O.numbered(df, "k").collect()} == {k: i for i, (k, _) in enumerate(sorted(rows))}
    assert O.numbered(df.limit(0), "k").count() == 0


def test_ranks_within_groups_and_least_before(spark):
    from inkwell.operators import order as O

    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), v, rng.choice([None, 0.5, 0.25, rng.random()])) for v in rng.sample(range(500), 90)]
    df = spark.createDataFrame(rows, "g string, v int, p double").repartition(5)
    got = {(r["g"], r["v"]): r["b"] for r in O.grouped_prefix(df.withColumn("one", F.lit(1)), ["g"], "v", {"one": "b"}).collect()}
    assert got == {(g, v): sum(h == g and w < v for h, w, _ in rows) for g, v, _ in rows}
    near = {r["g"]: r["value"] for r in T.nearest_rank(df, ["g"], "v", 0.3).collect()}
    for g in ("a", "b", None):
        vs = sorted(v for h, v, _ in rows if h == g)
        assert near[g] == vs[max(1, -(-3 * len(vs) // 10)) - 1]
    least = {r["v"]: r["m"] for r in O.with_least(df, "v", "p", "m").collect()}
    for _, v, _ in rows:
        seen = [p for _, w, p in rows if w <= v and p is not None]
        assert least[v] == (min(seen) if seen else None)
    ps = sorted(p for *_, p in rows if p is not None)
    q = {r["p"]: r["q"] for r in T.benjamini_hochberg(df, "p").collect()}
    for p in set(ps):
        assert q[p] == pytest.approx(min(min(1, x * len(ps) / (k + 1)) for k, x in enumerate(ps) if x >= p))
    assert q[None] is None and T.benjamini_hochberg(df.limit(0), "p").count() == 0 and T.nearest_rank(df.limit(0), ["g"], "v", 0.5).count() == 0


def test_permutation_at_the_border(spark, monkeypatch):
    import hashlib

    rng = random.Random(7)
    rows = [(i, int(rng.random() < 0.4), rng.random(), "x") for i in range(60)] + [(99, None, 1.0, "x"), (98, 1, None, "x")]
    df = spark.createDataFrame(rows, "id long, g int, v double, r string")
    base = [r for r in rows if r[1] is not None and r[2] is not None]
    ones, mean = sum(r[1] for r in base), lambda x: sum(x) / len(x)
    seen = mean([r[2] for r in base if r[1]]) - mean([r[2] for r in base if not r[1]])
    large = 0
    for k in range(20):
        o = sorted(base, key=lambda r: (hashlib.md5(f"13:{k}:{r[0]}".encode()).hexdigest(), r[0]))
        large += abs(mean([r[2] for r in o[:ones]]) - mean([r[2] for r in o[ones:]])) >= abs(seen) - 1e-12
    for settled in (10_000, 2):
        monkeypatch.setattr(T, "_SETTLED", settled)
        r = T.permutation_test(df, "g", "v", 20).first()
        assert r["p"] == pytest.approx((large + 1) / 21) and r["observed"] == pytest.approx(seen) and r["permutations"] == 20
    assert T.permutation_test(df.limit(0), "g", "v", 5).count() == 0 and T.cluster_bootstrap(df.limit(0), "g", "v", 5).count() == 0


def test_canonical_author(spark):
    df = spark.createDataFrame([("乙",), ("甲",), (None,)], "a string")
    assert [r[0] for r in df.select(X.canonical_author("a", {"乙": "甲"})).collect()] == ["甲", "甲", None]
    assert [r[0] for r in df.select(X.canonical_author("a", {})).collect()] == ["乙", "甲", None]


def test_glossary_terms_of_any_number_of_words(spark):
    terms = spark.createDataFrame([("Long after supper", "晚饭后很久", None), ("lamp", "灯", ["the old oil lamp"]), ("King's night-watch", "夜巡", None), ("Café", "咖啡馆", ["——"])], "source string, target string, aliases array<string>")
    texts = spark.createDataFrame([(1, "Long after supper, the old oil lamp was lit."), (2, "The king’s night-watch met long after."), (3, "A CAFÉ; a lamp"), (4, ""), (5, None), (6, "cafés, lamps")], "id long, text string")
    got = {tuple(r) for r in J.glossary_hits(texts, terms, "id", "text").collect()}
    assert got == {(1, "晚饭后很久", 1), (1, "灯", 2), (2, "夜巡", 1), (3, "咖啡馆", 1), (3, "灯", 1)}
    assert J.glossary_hits(texts, terms.limit(0), "id", "text").count() == 0


def test_complement_nb_is_the_fitted_one_at_any_number_of_labels(spark, monkeypatch):
    rows = [(k, f"{k % 7}", f"{'春夏秋冬风雨雷'[k % 7]}来了，{'山河湖海'[k % 4]}边有{k // 5}人" if k % 11 else "") for k in range(140)] + [(150, None, "无名"), (151, "1", None)]
    df = spark.createDataFrame(rows, "id long, author string, text string")
    train, rest = df.where("id % 3 > 0"), df.where("id % 3 = 0").withColumn("note", F.when(F.col("id") % 2 == 0, "双"))
    full = df.where("author is not null and text is not null").withColumn("grams", L.gram_column("text"))
    want = {r["id"]: r["pred"] for r in L.predict(*L.fit(full.where("id % 3 > 0"), "author", features=1 << 8), full.where("id % 3 = 0")).collect()}
    for labels, docs in ((2048, 4096), (2, 5)):
        with monkeypatch.context() as m:
            m.setattr(L, "LABELS", labels)
            m.setattr(L, "DOCS", docs)
            got = L.complement_nb(train, rest.where("author is not null"), "author", "text", 1 << 8)
        assert got.columns == ["id", "author", "note", "pred"] and got.schema["id"].dataType == df.schema["id"].dataType
        assert {r["id"]: r["pred"] for r in got.collect()} == want
    many = spark.range(33_000).selectExpr("cast(id as string) author", "md5(cast(id as string)) text")  # a matrix of labels x features would have over 2 ** 31 cells
    some = L.complement_nb(many, many.where("author in ('7', '12345', '32999')"), "author", "text")
    assert all(r["pred"] == r["author"] for r in some.collect()) and some.count() == 3


def test_best_author_in_few_passes(spark):
    rng = random.Random(5)
    names, chars = [f"a{k:02}" for k in range(23)], "的一是在不了有和人这中为"
    prof = spark.createDataFrame([(a, c, rng.random() + 0.01, 1.0 + chars.index(c) / 9) for a in names for c in rng.sample(chars, 4)], "author string, feature string, w double, idf double").selectExpr("author", "feature", "w / sqrt(sum(w * w) over (partition by author)) weight", "idf")
    prof = prof.unionByName(prof.where("author = 'a03'").withColumn("author", F.lit("a99"))).localCheckpoint()  # ties go to the greater name
    texts = [(f"t{k}", [rng.choice(chars + "x") for _ in range(rng.randrange(0, 9))]) for k in range(60)] + [("none", ["x"]), ("twice", ["的", "的", "一"])]
    docs = spark.createDataFrame(texts, "id string, f array<string>")
    counts = docs.select("id", F.explode("f").alias("feature")).groupBy("id", "feature").agg(F.count("*").alias("n"))
    want = {tuple(r) for r in P.predict(P.score(counts, prof)).select("id", "pred", "score").collect()}
    for block in (4, 8192):
        assert {tuple(r) for r in P.best_author_of(docs, prof, block=block).select("id", "pred", "score").collect()} == want
        assert {tuple(r) for r in P.best_author(counts, prof, block=block).select("id", "pred", "score").collect()} == want
    met = P.best_author_of(docs, prof, block=4)._jdf.queryExecution().toString()
    assert "Cartesian" not in met and "NestedLoop" not in met  # blocks meet once, and the result is a table
