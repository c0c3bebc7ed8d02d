import random

import pytest

from inkwell.llm import encoding as E

DDL = "chapter_id long, paragraphs array<string>, id string, p string, text string"
CHINESE = ["他慢慢放下茶杯，看着窗外的雪。", "“你先回去。”她低声说，“这里有我。”", "从渡口到山门要走三百里，谁也没有先开口。", "灯芯爆了一下，屋里又静了下来。", "更新时间：2014-10-18 字数：82541"]
ENGLISH = ["“I can’t stay here,” she said—and the door stayed shut.", "At the café by the harbor, nobody spoke for the third time.", "He didn’t look back until the light failed."]
CLEAN_TRAPS = ["“Спасибо，”他低声说。", "“γνῶσις 是什么意思？”她问。", "饕餮、耄耋、魑魅魍魉，他念着。", "“锟铻剑！”他喊道。", "她叫 Ångela Ñuño，低着头。", "“Привет,” he said.", "招牌上写着 CRÊPERIE ÉTOILE。", "① 放下；② 再说。", "第 Ⅲ 区 170 ㎏"]


def corpus(seed=1, n=1500):
    rng = random.Random(seed)
    out = [[rng.choice(CHINESE + ENGLISH).replace("2014", str(rng.randint(2000, 2024))) for _ in range(6)] for _ in range(n)]
    for t in CLEAN_TRAPS:
        out[rng.randrange(n)].append(t)
    return out


CASES = [("utf-8", w) for w in ("cp1252", "mac-roman", "cp1251", "koi8-r", "cp437", "latin-1")] + [("gb18030", w) for w in ("cp1252", "cp1251", "big5", "cp949")]


def test_finds_and_restores(spark):
    docs = corpus()
    rng = random.Random(2)
    want = {}
    for i in rng.sample(range(len(docs)), 60):
        right, wrong = rng.choice(CASES)
        good = rng.choice(CHINESE if right == "gb18030" else CHINESE + ENGLISH)
        bad = E.misread(good, right, wrong)
        if bad is None or bad == good:
            continue
        want[i, len(docs[i])] = (bad, good)
        docs[i].append(bad)
    lost = "灯芯爆了�下"
    docs[3].append(lost)
    rows = [(i, p, "x", "y", "z") for i, p in enumerate(docs)] + [(None, None, "x", "y", "z"), (9000, [], "x", "y", "z"), (9001, [None, "", "锟斤拷锟斤拷"], "x", "y", "z"), (9002, ["长" * 50_000], "x", "y", "z")]
    df = spark.createDataFrame(rows, DDL)
    got = {(r["id"], r["para_no"]): r["restored"] for r in E.garbled_paragraphs(df).collect()}
    extra = {(3, len(docs[3]) - 1), (9001, 2)}
    assert set(got) == set(want) | extra
    assert got[3, len(docs[3]) - 1] is None and got[9001, 2] is None
    right = sum(got[k] == good for k, (_, good) in want.items())
    assert right >= 0.95 * len(want)


def test_misreading_is_undone_exactly():
    import numpy as np

    from inkwell.llm.points import TOP

    counts = np.zeros(TOP, dtype=np.int64)
    for t in (CHINESE + ENGLISH) * 50:
        for c in t:
            counts[ord(c)] += 1
    model = E.Model(E.likelihoods(counts), {t: 5 for t in CASES})
    for right, wrong in CASES:
        for t in CHINESE:
            bad = E.misread(t, right, wrong)
            if bad is not None and bad != t:
                assert E.restore(bad, model)[0] == t, (right, wrong, t)
    twice = E.misread(E.misread(CHINESE[0], "utf-8", "latin-1"), "utf-8", "latin-1")
    assert E.restore(twice, model)[0] == CHINESE[0]


@pytest.mark.parametrize("text", CLEAN_TRAPS + CHINESE + ENGLISH)
def test_clean_text_stays(spark, text):
    import numpy as np

    from inkwell.llm.points import TOP

    counts = np.zeros(TOP, dtype=np.int64)
    for p in corpus(n=300):
        for t in p:
            for c in t:
                counts[ord(c)] += 1
    assert E.restore(text, E.Model(E.likelihoods(counts))) is None


def test_empty(spark):
    assert E.garbled_paragraphs(spark.createDataFrame([], DDL)).count() == 0


def test_repeated_lines_are_looked_at(spark):
    """A garbled line in a third of the chapters, and with another number in another, makes its own characters common."""
    rng = random.Random(3)
    line = "请记住本站域名并收藏本页"
    pool = [c for c in line + "".join(CHINESE) if "一" <= c <= "鿿"]
    docs = [["".join(rng.choices(pool, k=20)) + "。" for _ in range(6)] for _ in range(900)]
    bad = E.misread(line, "utf-8", "gb18030")
    for i in range(0, len(docs), 3):
        docs[i].append(bad)
        docs[i + 1].append(f"{i}：{bad}")
    df = spark.createDataFrame([(i, p) for i, p in enumerate(docs)], "chapter_id long, paragraphs array<string>")
    got = {r["id"]: r["restored"] for r in E.garbled_paragraphs(df).collect()}
    assert got == {i: line if i % 3 == 0 else f"{i - 1}：{line}" for i in range(len(docs)) if i % 3 < 2}


def test_twins_of_a_frequent_skeleton(spark):
    """300 clean texts share the skeleton of the garbled one; its twin is one of them."""
    rng = random.Random(4)
    pool = [c for c in "".join(CHINESE) if "一" <= c <= "鿿"]
    docs = [["2014-10-18" + "".join(rng.sample(pool, 8))] for _ in range(300)]
    for right, wrong in (("utf-8", "cp1252"), ("gb18030", "cp1251"), ("gb18030", "cp949")):
        twins = [E.misread(d[0], right, wrong) for d in docs]
        k = next(k for k, x in enumerate(twins) if x is not None)
        df = spark.createDataFrame([(i, p) for i, p in enumerate([*docs, [twins[k]]])], "chapter_id long, paragraphs array<string>")
        assert E.learn(df).votes.get((right, wrong), 0) > 0, (right, wrong)
