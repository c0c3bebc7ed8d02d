from collections import Counter, defaultdict

from inkwell.llm import site_lines as S

DDL = "chapter_id long, source_url string, paragraphs array<string>, line string, n long, s long"


def test_sources():
    cases = {
        "https://www.Site.example:443/book/1?x=2": "site.example", "http://m.site.example/": "site.example", "HTTP://SITE.EXAMPLE": "site.example", "//site.example/x": "site.example", "site.example/x": "site.example",
        "https://user@site.example/x": "site.example", "": None, "  ": None, None: None, "https://www.m.example/": "m.example",
    }
    for url, host in cases.items():
        assert S.source_of(url) == host, url


def brute(rows):
    size = Counter()
    by = defaultdict(set)
    for i, (_, url, ps) in enumerate(rows):
        s = S.source_of(url)
        if s is None:
            continue
        size[s] += 1
        for p in ps or []:
            if S.line_key(p) is not None:
                by[s, S.line_key(p)].add(i)
    often = {k for k, v in by.items() if len(v) >= 6 and 20 * len(v) >= size[k[0]]}
    return {(c, no) for c, url, ps in rows for no, p in enumerate(ps or []) if S.line_key(p) is not None and (S.source_of(url), S.line_key(p)) in often}


def test_against_counting(spark):
    rows = []
    for i in range(300):
        site = "a.example" if i % 3 else "b.example"
        ps = [f"故事第{i}章的话", None, "", "　"]
        if i % 7 == 0:
            ps.append(f"更新时间：20{i % 24:02d} 字数：{i}")
        if i % 30 == 1:
            ps.append("Ｓｈａｒｅ this" if i % 4 else "Share this")
        if i % 60 == 2:
            ps.append("很少见的一行")
        rows.append((i, f"https://www.{site}/book/{i}.html", ps))
    rows += [(1000, None, ["故事"]), (1001, "", ["故事"]), (1002, "https://a.example/", None), (1003, "https://a.example/", []), (1004, "https://c.example/", ["长" * 40_000])]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], DDL)
    got = {(r["id"], r["para_no"]) for r in S.site_lines(df).collect()}
    assert got == brute(rows) and got
    clean = {r["chapter_id"]: r["paragraphs"] for r in S.without_paragraphs(df, S.site_lines(df)).collect()}
    assert clean[1002] is None and clean[1003] == [] and clean[1000] == ["故事"]
    assert clean[7] == [p for k, p in enumerate(rows[7][2]) if (7, k) not in got]


def test_threshold_is_inclusive(spark):
    rows = [(i, "https://s.example/", ["一样"] if i < 7 else [f"别{chr(0x4E00 + i)}"]) for i in range(140)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], DDL)
    assert S.site_lines(df).count() == 7  # 7 of 140 are 5 %
    fewer = spark.createDataFrame([(*r, "x", 1, 2) for r in rows[:5] + rows[7:20]], DDL)
    assert S.site_lines(fewer).count() == 0
    assert S.site_lines(df.limit(0)).count() == 0
