import pytest

from inkwell.llm import residue as S

DDL = "chapter_id long, paragraphs array<string>, id string, kind string, p string"
RESIDUE = [
    "{{ title }}", "亲爱的{{name}}，您订阅的书已更新。", "作者：<%= author %> 更新：@@date@@", "[[作者名]]", "${书名}", "#章节标题#", "%BOOK_NAME%以来，他慢慢走远了。", "{SITE_NAME}", "<主角名>想起了什么。", "__user.name__", "【此处插入正文】",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "内容内容内容内容内容内容内容内容", "测试文字测试文字测试文字", "正文待更新，正文待更新，正文待更新，",
    "HTTP Error 503: Service Unavailable.", "404 Not Found", "502 - 网关超时", "错误 500：系统繁忙，请稍后再试", "Traceback: KeyError 'book_title' (ab12ef34)", "[object Object]", "undefined", "null null null", "NaN / NaN",
    "正文加载中，请稍候……", "Loading chapter, please wait...", "图片加载失败", "正在跳转到阅读页……", "请启用 JavaScript 后刷新本页。", "Please enable JavaScript to view this chapter.", "您的网络环境存在异常，请完成验证后继续访问。", "Ｌｏａｄｉｎｇ ｃｈａｐｔｅｒ, ｐｌｅａｓｅ ｗａｉｔ...",
]
STORY = [
    "（此处省略300字，他随手摆正银簪。）", "他把《服务器维护入门》放下，看着窗外的雪。", "“又是脚本没开，”她问，“别回头。”", "“Script’s not loading,” he said, and the water kept rising.", "He read the error page twice, and the dogs went quiet, and opened the compass.",
    "她笑着说：“加载完毕，你怎么来了。”", "从渡口到山门要走300里，谁也没有先开口。", "“它不是你的。”他低声说。", "5 < 6 and 7 > 3, she thought.", "100%", "#1 of 3", "本站内容均由网友上传，侵权请联系我们。", "", "   ", None,
]


def test_found_and_left(spark):
    rows = [(i, [r, s, None], "x", "y", "z") for i, (r, s) in enumerate(zip(RESIDUE, (STORY * 3)[: len(RESIDUE)]))]
    rows += [(500 + i, ["灯芯爆了一下，屋里又静了下来。" * 3, "Nobody spoke for the third time, because the fire had gone out."], "x", "y", "z") for i in range(200)]
    rows += [(900, None, "x", "y", "z"), (901, [], "x", "y", "z"), (902, ["他走了很远的路。" * 5000], "x", "y", "z"), (None, ["404 Not Found"], "x", "y", "z")]
    df = spark.createDataFrame(rows, DDL)
    got = {(r["id"], r["para_no"]) for r in S.residue(df).collect()}
    want = {(i, 0) for i in range(len(RESIDUE))} | {(None, 0)}
    assert got == want
    assert S.residue(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", RESIDUE[:11])
def test_placeholders(text):
    assert S.Index().placeholder.search(text)


def test_grams_stay_inside_words():
    import numpy as np

    p = np.frombuffer("ab cd 中文1字".encode("utf-32-le"), dtype=np.uint32)
    at, _ = S.grams(p)
    assert at.tolist() == [0, 3, 6]


def test_wordings_left_out_are_found_by_the_others():
    """Index of half of the exemplars, tried on the other half."""
    import random

    lines = [e for e in S.default_exemplars() if e[0] != "placeholder" and len(S.grams(S._points(e[1]))[0]) >= S.LEAST_GRAMS]
    for seed in range(3):
        rng = random.Random(seed)
        rng.shuffle(lines)
        index = S.Index(lines[: len(lines) // 2])
        index.weigh({}, 1_000_000)
        rest = lines[len(lines) // 2 :]
        assert sum(index.judge(t) is not None for _, t in rest) / len(rest) >= 0.9
        assert not any(index.judge(t) for t in STORY if t and not t.isspace())


def test_own_exemplars(spark):
    df = spark.createDataFrame([(1, ["请稍等，书页正在装订当中。", "他走了。", "<<TITLE>> 归来"], "x", "y", "z")], DDL)
    got = {(r["para_no"], r["kind"]) for r in S.residue(df, exemplars=[("binding", "书页正在装订当中"), ("placeholder", "<<name>>")]).collect()}
    assert got == {(0, "binding"), (2, "placeholder")}
    assert S.residue(df, exemplars=[]).count() == 0
