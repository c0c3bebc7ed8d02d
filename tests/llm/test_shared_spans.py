import random
from collections import defaultdict

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from inkwell.llm import shared_spans as S


def brute(texts):
    windows = defaultdict(set)
    for i, t in texts.items():
        for k in range(len(t) - S.MIN_RUN + 1):
            windows[t[k : k + S.MIN_RUN]].add(i)
    pairs, covered = set(), defaultdict(set)
    for w, ids in windows.items():
        ids = sorted(ids)
        pairs |= {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :]}
    for i, t in texts.items():
        for k in range(len(t) - S.MIN_RUN + 1):
            if len(windows[t[k : k + S.MIN_RUN]]) > 1:
                covered[i] |= set(range(k, k + S.MIN_RUN))
    return pairs, covered


def repeated(texts):
    """What a text with a lesser id holds too; equal texts stand for the least of them."""
    first, out = {}, defaultdict(set)
    for i in sorted(texts):
        t = texts[i]
        for k in range(len(t) - S.MIN_RUN + 1):
            if first.setdefault(t[k : k + S.MIN_RUN], i) != i:
                out[i] |= set(range(k, k + S.MIN_RUN))
    return dict(out)


def made(seed, n=40):
    rng = random.Random(seed)
    alphabets = ["天地玄黄宇宙洪荒日月盈昃辰宿列张", "abcdefgh ", "甲乙"]
    ends = ["。", "！", "\n", ". ", "，", ""]

    def text(size):
        a = rng.choice(alphabets)
        out = ""
        while len(out) < size:
            out += "".join(rng.choice(a) for _ in range(rng.choice([3, 20, 90, 300]))) + rng.choice(ends)
        return out[:size]

    pool = [text(rng.choice([150, 199, 200, 201, 205, 260, 400])) for _ in range(6)]
    texts = {}
    for i in range(n):
        t = text(rng.randint(0, 300))
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(pool)
            a = rng.randint(0, max(0, len(p) - 200))
            t += p[a:] + text(rng.randint(0, 120))
        texts[i] = t
    texts[n] = texts[n - 1]
    texts[n + 1] = "哈" * 500
    texts[n + 2] = "好" + "哈" * 260 + "。"
    texts[n + 3] = ""
    return texts


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("small", [48, 2])
def test_against_all_windows(spark, monkeypatch, seed, small):
    monkeypatch.setattr(S, "SMALL_GROUP", small)
    monkeypatch.setattr(S, "PAIRED", small)
    texts = made(seed)
    df = spark.createDataFrame([(i, [t]) for i, t in texts.items()], "chapter_id long, paragraphs array<string>")
    pairs, covered = brute(texts)
    assert {tuple(r) for r in S.shared_pairs(df).collect()} == pairs
    got = defaultdict(set)
    for r in S.shared_intervals(df).collect():
        got[r["id"]] |= set(range(r["start"], r["stop"]))
    assert dict(got) == dict(covered)
    later = defaultdict(set)
    for r in S.repeated_intervals(df, "chapter_id", S.joined_text()).collect():
        later[r["id"]] |= set(range(r["start"], r["stop"]))
    assert dict(later) == repeated(texts)


@settings(max_examples=60, deadline=None)
@given(st.text("ab。哈\n", max_size=150), st.text("ab。哈\n", max_size=150), st.text("abcd。，", min_size=200, max_size=230))
def test_a_shared_run_has_a_common_span(before, other, run):
    x, y = before + run, other + run + before
    spans = lambda t: {t[p : p + S.SPAN] for p in S.anchors(t) if p + S.SPAN <= len(t)}
    assert spans(x) & spans(y)


def test_edges(spark):
    ddl = "chapter_id long, paragraphs array<string>, id string, class_id string, text string, fp int"
    long = "很长的一段话，没有别的。" * 30
    rows = [(1, None, "x", "y", "z", 1), (2, [], "x", "y", "z", 1), (3, [None, ""], "x", "y", "z", 1), (None, [long], "x", "y", "z", 1), (4, [long], "x", "y", "z", 1), (4, [long], "x", "y", "z", 1), (5, [None, long, None], "x", "y", "z", 1)]
    df = spark.createDataFrame(rows, ddl)
    assert [tuple(r) for r in S.shared_pairs(df).collect()] == [(4, 5)]
    shares = {r["chapter_id"]: (r["n_chars"], r["shared_share"]) for r in S.shared_shares(df).collect()}
    assert shares[1] == (0, 0.0) and shares[4] == (len(long), 1.0) and shares[5] == (len(long), 1.0)
    assert S.shared_pairs(df.limit(0)).count() == 0
    assert S.shared_intervals(df.limit(0)).count() == 0


def test_first_owner_keeps_what_is_repeated(spark):
    run = "".join(f"第{i}句话说的是第{i}件事。" for i in range(40))
    df = spark.createDataFrame([(1, ["开头。", run]), (2, [run + "结尾。"]), (3, ["别的。"])], "chapter_id long, paragraphs array<string>")
    got = {r["chapter_id"]: r for r in S.drop_repeats(df).collect()}
    assert got[1]["text"] == "开头。\n" + run and got[1]["dropped_chars"] == 0
    assert got[2]["text"] == "结尾。" and got[2]["dropped_chars"] == len(run)
    assert got[3]["text"] == "别的。"


def test_other_columns_and_text(spark):
    df = spark.createDataFrame([(7, "x" * 300), (9, "y" + "x" * 250)], "doc long, body string")
    assert [tuple(r) for r in S.shared_pairs(df, "doc", F.col("body")).collect()] == [(7, 9)]
