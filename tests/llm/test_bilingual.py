import random

from inkwell.llm import bilingual as B

NAMES = dict(zip("Maren Tolvik Oshra Pellan Isolde Quent Fennick Yarrow Sable Dorrin".split(), "玛伦 托尔维克 奥什拉 佩兰 伊索德 昆特 芬尼克 雅萝 塞布尔 多林".split()))
THINGS = dict(zip("lantern ledger compass anchor helmet mirror ribbon basket".split(), "提灯 账册 罗盘 船锚 头盔 镜子 缎带 篮子".split()))
PLACES = dict(zip("orchard harbor tower kitchen quarry chapel".split(), "果园 港口 塔楼 厨房 采石场 礼拜堂".split()))
FORMS = [("{n} carried the {t} to the {p}.", "{N}把{T}带到了{P}。"), ("Why would {n} sell the {t} near the {p}?", "{N}为什么要在{P}卖掉{T}？"), ("{n} counted {k} steps from the {p} and hid the {t}.", "{N}从{P}数了{K}步，藏好了{T}。"), ("Only {n} knew that the {t} had left the {p}.", "只有{N}知道{T}离开了{P}。")]
DDL = "entry_id long, source array<string>, zh array<string>, score string, id long"
HAN = "零一二三四五六七八九"


def pair(rng):
    e, z = rng.choice(FORMS)
    n, t, p, k = rng.choice(list(NAMES)), rng.choice(list(THINGS)), rng.choice(list(PLACES)), rng.randint(21, 99)
    words = f"{'twenty thirty forty fifty sixty seventy eighty ninety'.split()[k // 10 - 2]}" + (f"-{'one two three four five six seven eight nine'.split()[k % 10 - 1]}" if k % 10 else "")
    return e.format(n=n, t=t, p=p, k=words), z.format(N=NAMES[n], T=THINGS[t], P=PLACES[p], K=HAN[k // 10] + "十" + (HAN[k % 10] if k % 10 else ""))


def entries(seed=1, n=400):
    rng = random.Random(seed)
    rows, truth = [], set()
    for i in range(n):
        pairs = [pair(rng) for _ in range(8)]
        s, z = [p[0] for p in pairs], [p[1] for p in pairs]
        links = {(k, k) for k in range(8)}
        if i % 4 == 0:  # merged, omitted, moved, with a null in front
            z = [None, z[0] + z[1], *z[3:], "（译注：此句存疑。）"]
            links = {(0, 1), (1, 1)} | {(k, k - 1) for k in range(3, 8)}
        if i % 5 == 1:
            s = [s[1], s[0], *s[2:]]
            links = {({0: 1, 1: 0}.get(a, a), b) for a, b in links}
        rows.append((i, s, z, "x", 1))
        truth |= {(i, a, b) for a, b in links}
    return rows, truth


def test_precision_and_recall(spark):
    rows, truth = entries()
    rows += [(900, None, ["甲"], "x", 1), (901, ["A"], [], "x", 1), (902, [None, ""], ["", None], "x", 1), (903, ["zzz qqq"], ["犇犇"], "x", 1)]
    df = spark.createDataFrame(rows, DDL)
    got = {(r["id"], r["source_no"], r["zh_no"]) for r in B.aligned(df).collect()}
    assert len(got & truth) / len(got) >= 0.95
    assert len(got & truth) / len(truth) >= 0.95
    assert not any(g[0] >= 900 for g in got)


def test_terms():
    assert B.english_terms("Forty-seven steps, 12 men; one lamp") == ["#47", "steps", "#12", "men", "one", "lamp"]
    assert "#47" in B.chinese_terms("四十七步") and "#110" in B.chinese_terms("一百一十步") and "#12" in B.chinese_terms("12人")


def test_empty(spark):
    assert B.aligned(spark.createDataFrame([], DDL)).count() == 0


def test_rare_terms_have_vectors_in_a_large_table(spark):
    """Names that stand in few of many entries, with nothing else to explain the pair."""
    rng = random.Random(5)
    rows = [(i, [pair(rng)[0]], [pair(rng)[1]], "x", 1) for i in range(6000)]
    names = [(f"quor{a}{b}", chr(0x7300 + 4 * k) + chr(0x7301 + 4 * k)) for k, (a, b) in enumerate((a, b) for a in "abcde" for b in "mnopq")]
    rare = [(7000 + 4 * k + j, [n, "x" * (j + 2)], [z, "犇" * (j + 1)], "x", 1) for k, (n, z) in enumerate(names) for j in range(4)]
    df = spark.createDataFrame(rows + rare, DDL)
    got = {(r["id"], r["source_no"], r["zh_no"]) for r in B.aligned(df).where("id >= 7000").collect()}
    assert {(r[0], 0, 0) for r in rare} <= got
