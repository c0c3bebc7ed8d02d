"""Template residue and error-page text.

Method: retrieve labelled residue exemplars through an inverted index; compute
TF-IDF containment over passage windows and exclude high-coverage matches.

Exemplars are a table (kind, text), a parameter; `default_exemplars` is the one
used if none is given. Text is cut into grams: two characters from an ideograph
on, four from any other letter on; digits, spaces and punctuation make no
grams. The inverted index leads from grams to exemplars and to kinds. All
paragraphs are scanned with it in arrays; how often an exemplar's gram occurs in
all paragraphs gives its weight. A paragraph is residue if one exemplar covers
its sentence windows, and not by accident only, or if the exemplars of one kind
do together: so wordings that no exemplar has are found by those they are put
together from.

Exemplars of the kind "placeholder" go into the index by their marks: what
stands before and behind the name, and what the name may be; the scan looks for
every pair of marks that has an exemplar.
"""

from __future__ import annotations

import builtins
import re
from collections import defaultdict
from collections.abc import Iterator
from http import HTTPStatus

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from inkwell.functions.arrow import arrow_schema, as_batch
from inkwell.functions.textform import INVISIBLE, KANGXI, consistent
from inkwell.llm.points import TOP, points_of

#: Least share of a window's weight that one exemplar must cover.
COVERED = 0.72
#: Least share of an exemplar's weight that the window must hold, so that a scrap of one does not count.
HELD = 0.3
#: Coverage by all exemplars from which a window is looked at more closely: that of any one is no more. Less where
#: parts of the text are left out before it is judged.
LOOK, LOOK_VARIED = 0.6, 0.3

#: The same for filler Latin, whose words are made up anew.
LATIN_COVERED = 0.6
#: The same for the exemplars of one kind together, and the least number of different grams that they must cover.
TOGETHER, LEAST_GRAMS = 0.8, 4

# Exemplars of residue, by kind. A blank stands for what varies.
EXEMPLARS = {
    "error": """
Sorry, the page you requested could not be found.
The requested URL was not found on this server.
This page isn't working right now.
Access denied. Reference
You don't have permission to access this resource.
Request ID
Connection timed out after ms
Connection refused
Connection reset by peer
Traceback (most recent call last)
TypeError: cannot read property 'body' of undefined at line
TypeError: undefined is not a function
ReferenceError: is not defined
NullPointerException
Uncaught exception
Warning: missing template variable in view
Warning: undefined variable in on line
Fatal error: out of memory (tried to allocate bytes)
Fatal error: maximum execution time exceeded
Database connection failed
Something went wrong, please try again later.
[object Object]
抱歉，您访问的章节不存在或已被删除。
抱歉，您访问的页面不存在。
未找到对应的章节内容，错误编号
页面走丢了，秒后自动返回首页。
请求过于频繁，请秒后重试。
程序发生异常，请联系管理员
""",
    "loading": """
Loading chapter, please wait...
Loading, please wait
Redirecting to the reader...
Redirecting, please wait
You are being redirected.
Failed to load the content. Click to retry.
Image failed to load
正文加载中，请稍候……
章节内容获取中
内容正在手打中，请稍后刷新。
加载失败，点击重试
图片加载失败
正在跳转到阅读页……
正在加载，请稍候
页面正在跳转，请稍候
内容加载失败，请刷新重试
""",
    "demand": """
Please enable JavaScript to view this chapter.
You need to enable JavaScript and cookies to continue.
You need to enable JavaScript to run this app.
This site requires scripts; turn them on and reload
This site requires JavaScript. Please turn it on and reload the page.
Your browser is not supported. Please upgrade your browser.
Please upgrade to a modern browser to read on.
Checking your browser before you continue.
Please verify you are human.
Verify that you are not a robot to continue.
Complete the captcha to continue.
Please turn on cookies and reload this page.
请启用 JavaScript 后刷新本页。
您的浏览器禁用了脚本，正文无法显示。
本站需要开启脚本才能阅读，请检查浏览器设置。
浏览器版本过低，无法运行脚本，请升级后再试。
您的网络环境存在异常，请完成验证后继续访问。
请完成安全验证后继续阅读。
请拖动滑块完成验证
正在检查您的浏览器，请稍候
请使用其他浏览器打开本页
请开启 Cookie 后重试
""",
    "filler": """
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
Your text goes here
Insert text here
Sample text sample text
Dummy text dummy text
test test test test
asdf asdf asdf asdf
qwerty qwerty qwerty
foo bar foo bar
blah blah blah blah
xxx xxx xxx xxx
此处文字待补充
""",
}
# What a server of a Chinese site says is wrong.
STATES = "服务暂时不可用 网关超时 页面不存在 系统繁忙，请稍后再试 您没有访问权限 禁止访问 内部服务器错误 请求超时 连接失败 服务器无响应 参数错误 数据库连接失败 网络异常，请稍后重试 资源不存在".split()
#: Frames around what is wrong, and around the reason phrases of HTTP and the names of Python's exceptions.
FRAMES_ZH = ("{}", "错误：{}", "服务器返回，{}。", "出错了：{}", "抱歉，{}")
FRAMES_HTTP = ("{}", "Error: {}", "HTTP Error: {}.", "Error code ({})", "Status; {}", "HTTP status {}")
FRAMES_PYTHON = ("Traceback: {}", "Uncaught {}")
# What is loaded and how that goes, where a visitor is sent, and what is asked of them.
LOADED_ZH, LOADING_ZH = "正文 章节 章节内容 内容 图片 页面 数据".split(), "加载中 加载失败 获取中 获取失败 正在加载 正在手打中".split()
THEN_ZH = ("，请稍候", "，请稍后刷新", "，点击重试", "，请刷新重试")
SENT_ZH, TARGETS_ZH = "正在跳转到 即将返回 自动返回".split(), "首页 阅读页 目录页 登录页".split()
ASKED_ZH, SCRIPTS_ZH = "请启用 请开启 请打开 需要开启 您的浏览器禁用了 无法运行".split(), ("脚本", "JavaScript", "Cookie")
SO_ZH = ("后刷新本页", "才能阅读", "，正文无法显示", "，请检查浏览器设置", "，请升级浏览器后再试")
LOADED_EN, LOADING_EN = "chapter content image page text".split(), ("Loading {}, please wait...", "Failed to load the {}. Click to retry.", "Could not load {}, try again")
SENT_EN, TARGETS_EN = ("Redirecting to the {}...", "You are being redirected to the {}"), "reader page chapter site".split()
ASKED_EN, SCRIPTS_EN = ("Please enable {} to view this", "You need to enable {} to run this", "This site requires {}; turn on and reload", "{} disabled in your browser"), ("JavaScript", "scripts", "cookies", "JavaScript and cookies")
# Words that filler repeats, and what programs print for nothing.
FILLER_ZH, NOTHING = "内容 正文 文字 文本 占位内容 占位文字 测试内容 测试文字 示例文本 示例内容 填充文字 这里是正文 正文待更新， 内容待补充，".split(), "null undefined NaN None nil".split()
# How a place for text is named, and the brackets around that; the marks of template languages around a name.
PLACES, ENTER, BRACKETS = "此处 在此 请在此".split(), "插入 填写 输入 添加".split(), "【】 [] ［］ （） ()".split()
PLACEHOLDERS = "{{ name }} {% name %} ${name} <% name %> <%= name %> [[name]] @@name@@ __name__ #NAME# %NAME% {NAME} <NAME>"


def default_exemplars() -> list[tuple[str, str]]:
    """(kind, text): the fixed exemplars, and those that frames, states and brackets give."""
    out = [(kind, x) for kind, block in EXEMPLARS.items() for x in block.strip().split("\n")]
    phrases = sorted({s.phrase for s in HTTPStatus if s >= 400} | {"Gateway Time-out"})
    errors = sorted(n for n, e in vars(builtins).items() if isinstance(e, type) and issubclass(e, Exception) and n.endswith("Error"))
    for frames, fill in ((FRAMES_ZH, STATES), (FRAMES_HTTP, phrases), (FRAMES_PYTHON, errors)):
        out += [("error", f.format(x)) for x in fill for f in frames]
    out += [("loading", f"{x}{y}{z}") for x in LOADED_ZH for y in LOADING_ZH for z in THEN_ZH]
    out += [("loading", f"{x}{y}") for x in SENT_ZH for y in TARGETS_ZH]
    out += [("loading", f.format(x)) for xs, fs in ((LOADED_EN, LOADING_EN), (TARGETS_EN, SENT_EN)) for x in xs for f in fs]
    out += [("demand", f"{x}{y}{z}") for x in ASKED_ZH for y in SCRIPTS_ZH for z in SO_ZH]
    out += [("demand", f"{f.format(x)} {y}") for x in SCRIPTS_EN for f in ASKED_EN for y in LOADED_EN]
    out += [("filler", x * 4) for x in FILLER_ZH] + [("error", " ".join([x] * 3)) for x in NOTHING]
    out += [("placeholder", x) for x in re.findall(r"\S+ name \S+|\S+", PLACEHOLDERS)]
    out += [("placeholder", f"{b[0]}{p}{e}正文{b[1]}") for b in BRACKETS for p in PLACES for e in ENTER]
    return out


def latin_pieces(passage: str) -> list[str]:
    """The ends of two or three letters of the words of filler Latin, and its short words: what more of it is put together from."""
    words = set(re.findall("[a-z]+", passage.lower()))
    return sorted({x for w in words for x in (w[:2], w[:3], w[-2:], w[-3:]) if len(x) > 1})


_PROSE = "【［（(["  # brackets that prose has too, so the words behind them must be an exemplar's
_NAME = "[A-Z㐀-鿿][A-Z0-9_.㐀-鿿]{1,30}"


def placeholder_pattern(texts: list[str]) -> tuple[re.Pattern, str]:
    """What placeholders of the exemplars' kinds look like, and the characters that one begins with.

    Marks of two characters or more may hold any short name, single marks a name in
    capitals or ideographs, brackets of prose the four characters that the exemplar begins with."""
    found: dict[tuple[str, str], set[str]] = defaultdict(set)
    for t in texts:
        m = re.fullmatch(r"((?:(?!_)\W|_)+?)\s*([^\W_].*?)\s*((?:(?!_)\W|_)+)", t.strip())
        if m:
            found[m[1], m[3]].add(m[2][:4])
    parts = []
    for (a, z), begins in sorted(found.items(), key=lambda x: (-len(x[0][0]), x[0])):
        out = re.escape("".join(sorted(set(a + z) - {"_"})))
        if len(a) == 1 and a in _PROSE:
            name = "(?:" + "|".join(map(re.escape, sorted(begins))) + f")[^{out}\n]{{0,20}}"
        elif len(a) == 1 and len(z) == 1:
            name = _NAME
        elif a == z:  # marks that look alike on both sides hold no space
            name = rf"[^\W_]\S{{0,40}}?" if "_" in a else rf"[^{out}\s]{{1,40}}"
        else:
            name = rf"[^{out}\n]{{1,60}}"
        parts.append(re.escape(a) + name + re.escape(z))
    return re.compile("|".join(parts) or "(?!)"), "".join(sorted({a[0] for a, _ in found}))


_WINDOW = re.compile("[^。！？!?；;\n]+[。！？!?；;\n]*")

_VARIES = re.compile(r"'[^'\n]{1,40}'|\b(?=[a-f]*[0-9])[0-9a-f]{4,}\b")

SLOTS = 1 << 20


def _classes() -> np.ndarray:
    """0: makes no gram; 1: letter; 2: ideograph."""
    c = np.zeros(TOP, dtype=np.uint8)
    for lo, hi in ((0x41, 0x5B), (0x61, 0x7B), (0xC0, 0x250)):
        c[lo:hi] = 1
    for lo, hi in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x31350)):
        c[lo:hi] = 2
    c[0xFF21:0xFF3B] = c[0xFF41:0xFF5B] = 1
    c[0x2F00:0x2FD6] = 2
    return c


CLASS = _classes()
#: Lower case, half width, ordinary ideographs.
LOWER = np.arange(TOP, dtype=np.uint32)
LOWER[0xFF21:0xFF3B] -= 0xFEE0
LOWER[0xFF41:0xFF5B] -= 0xFEE0
LOWER[0x41:0x5B] += 32
LOWER[0xFF21:0xFF3B] += 32
for _k, _v in KANGXI.items():
    LOWER[ord(_k)] = ord(_v)


def grams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, slot) of every gram: letters and ideographs only, lower case.

    A gram never spans a line feed put between texts, nor digits or marks; a word of fewer than four letters is one gram."""
    kind = CLASS[points]
    q = LOWER[points].astype(np.uint64)
    n = len(points)
    if n == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        two = np.zeros(n, dtype=np.uint64)
        ok2 = np.zeros(n, dtype=bool)
        ok2[: n - 1] = (kind[:-1] == 2) & (kind[1:] == 2)
        two[: n - 1] = q[:-1] * np.uint64(0x9E3779B97F4A7C15) + q[1:]
        four = q.copy()
        run = kind == 1
        begins = run & np.concatenate(([True], kind[:-1] != 1))
        for k in range(1, 4):
            shifted = np.zeros(n, dtype=np.uint64)
            same = np.zeros(n, dtype=bool)
            if k < n:
                shifted[: n - k] = q[k:]
                same[: n - k] = kind[k:] == 1
            run = run & same
            four = four * np.uint64(0xD6E8FEB86659FD93) + np.where(run, shifted, np.uint64(0))
        ok4 = run | begins
        h = np.where(ok2, two, four)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    at = np.flatnonzero(ok2 | ok4)
    return at, (h[at] & np.uint64(SLOTS - 1)).astype(np.int64)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Index:
    """Inverted index from grams to exemplars and kinds, with the grams' weights once all paragraphs are counted."""

    def __init__(self, exemplars: list[tuple[str, str]] | None = None) -> None:
        lines = default_exemplars() if exemplars is None else exemplars
        self.placeholder, self.openers = placeholder_pattern([x for kind, x in lines if kind == "placeholder"])
        self.kinds: list[str] = []
        self.grams: list[np.ndarray] = []
        for kind, text in lines:
            g = np.unique(grams(_points(text))[1])
            if kind != "placeholder" and len(g):
                self.kinds.append(kind)
                self.grams.append(g)
        pieces = latin_pieces(" ".join(x for kind, x in lines if kind == "filler" and x.isascii() and x.count(" ") > 40))
        self.latin = len(self.kinds)
        if pieces:
            pairs = [a + b for a in pieces for b in pieces]
            self.kinds.append("filler")
            self.grams.append(np.unique(np.concatenate([grams(_points(" ".join(f"{x}{c}" for x in pairs)))[1] for c in pieces[::16]] + [grams(_points(" ".join(pairs)))[1]])))
        self.postings: dict[int, list[int]] = defaultdict(list)
        self.masks: dict[str, np.ndarray] = {k: np.zeros(SLOTS, dtype=bool) for k in dict.fromkeys(self.kinds)}
        self.of_latin, self.known = np.zeros(SLOTS, dtype=bool), np.zeros(SLOTS, dtype=bool)
        for e, g in enumerate(self.grams):
            self.known[g] = True
            if e == self.latin:
                self.of_latin[g] = True
                continue
            self.masks[self.kinds[e]][g] = True
            for s in g.tolist():
                self.postings[s].append(e)
        self.weights: np.ndarray | None = None

    def weigh(self, counts: dict[int, int], total: int) -> None:
        """Weight of a gram: log of all grams over its own; grams of no exemplar have the mean weight of rare ones."""
        top = np.log(max(2, total))
        w = np.full(SLOTS, min(top, 9.0), dtype=np.float32)
        for s in np.flatnonzero(self.known).tolist():
            w[s] = max(0.3, np.log(max(2, total) / (1 + counts.get(s, 0))))
        w = np.minimum(w, 9.0)
        self.weights = w
        self.totals = [float(w[g].sum()) for g in self.grams]

    def judge(self, text: str) -> str | None:
        """The kind of residue that a paragraph is, or None. What stands in ASCII quotes and hexadecimal numbers vary.

        A window that is residue makes its paragraph so if it is half of it or more."""
        text = consistent(text)
        if any(c in text for c in self.openers) and self.placeholder.search(text):
            return "placeholder"
        text = _VARIES.sub(" ", text)
        for window in [text, *(m.group() for m in _WINDOW.finditer(text))] if _WINDOW.fullmatch(text) is None else [text]:
            kind = self._window(window)
            if kind is not None and (window is text or len(window) * 2 >= len(text)):
                return kind
        return None

    def _window(self, window: str) -> str | None:
        at, slots = grams(_points(window))
        if not len(slots):
            return None
        weight = self.weights[slots]
        whole = float(weight.sum())
        if float(weight[self.known[slots]].sum()) < LOOK * whole:  # all together cover less than any one must
            return None
        if float(weight[self.of_latin[slots]].sum()) >= LATIN_COVERED * whole and len(slots) >= 12:
            return self.kinds[self.latin]
        kinds = {k: float(weight[m[slots]].sum()) for k, m in self.masks.items()}
        if sum(kinds.values()) < COVERED * whole:
            return None
        by: dict[int, float] = defaultdict(float)
        own: dict[int, float] = defaultdict(float)
        seen: set[int] = set()
        for s, x in zip(slots.tolist(), weight.tolist()):
            for e in self.postings.get(s, ()):
                by[e] += x
                if s not in seen:
                    own[e] += x
            seen.add(s)
        for e, covered in sorted(by.items(), key=lambda x: -x[1]):
            if covered < COVERED * whole:
                break
            if own[e] >= HELD * self.totals[e]:
                return self.kinds[e]
        joint = [k for k, covered in sorted(kinds.items(), key=lambda x: -x[1]) if covered >= TOGETHER * whole]
        return next((k for k in joint if len(np.unique(slots[self.masks[k][slots]])) >= LEAST_GRAMS), None)


class _Count:
    """How often the exemplars' grams, and all grams, occur."""

    def __init__(self, known: np.ndarray) -> None:
        self.at, self.schema = np.flatnonzero(known), arrow_schema("slot int, n long")

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, dtype=np.int64)
        for b in batches:
            _, slots = grams(_spaced(points_of(b.column(0))))
            total += np.bincount(slots, minlength=SLOTS)
        rows = [(int(s), int(total[s])) for s in self.at if total[s]] + [(-1, int(total.sum()))]
        yield as_batch(rows, self.schema, 2)


def _spaced(p) -> np.ndarray:
    """The code points with the first of every text hidden from the grams of the one before it."""
    return np.insert(p.points, p.starts[1:-1], 10) if len(p.starts) > 2 else p.points


class _Judge:
    def __init__(self, index: Index, ddl: str) -> None:
        self.index, self.schema = index, arrow_schema(ddl)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, known = self.index.weights, self.index.known
        opener = np.zeros(TOP, dtype=bool)
        opener[[ord(c) for c in self.index.openers]] = True
        varies, ends = np.zeros(TOP, dtype=bool), np.zeros(TOP, dtype=bool)
        varies[0x30:0x3A] = True  # numbers, and what the consistent form drops inside words
        varies[[ord(c) for c in INVISIBLE]] = True
        ends[[ord(c) for c in "。！？!?；;\n"]] = True
        for b in batches:
            ids = b.column(0).to_pylist()
            p = points_of(b.column(1))
            n = len(p.starts) - 1
            if n == 0:
                continue
            spaced = _spaced(p)
            at, slots = grams(spaced)
            text = np.searchsorted(p.starts[1:] + np.arange(n), at, "right")
            weight, hit = w[slots], w[slots] * known[slots]
            whole, covered = (np.bincount(text, weights=x, minlength=n) for x in (weight, hit))
            varied = (p.counts(varies[p.points]) > 0) | (p.counts(p.points == 0x27) > 1)
            look = (covered >= np.where(varied, LOOK_VARIED, LOOK) * whole) & (whole > 0) | (p.counts(opener[p.points]) > 0)
            end = ends[spaced]
            begins = np.flatnonzero(~end & np.concatenate(([True], end[:-1])))  # of the sentence windows
            if len(begins):
                window = np.searchsorted(begins, at, "right") - 1
                of_whole, of_covered = (np.bincount(window, weights=x, minlength=len(begins)) for x in (weight, hit))
                owner = np.searchsorted(p.starts[1:] + np.arange(n), begins, "right")
                long = np.diff(np.append(begins, len(spaced))) * 2 >= np.diff(p.starts)[owner]
                look[owner[long & (of_covered >= LOOK * of_whole) & (of_whole > 0)]] = True
            rows = []
            for k in np.flatnonzero(look):
                x = p.texts[int(k)].as_py()
                if (kind := self.index.judge(x)) is not None:
                    rows.append((ids[p.row[k]], int(p.no[k]), kind, x))
            yield as_batch(rows, self.schema, 4)


def residue(df: DataFrame, id_col: str = "chapter_id", list_col: str = "paragraphs", exemplars: list[tuple[str, str]] | None = None) -> DataFrame:
    """(id, para_no, kind, text) of every paragraph that a template or a failing site left.

    exemplars: (kind, text) rows, of the kind "placeholder" with their marks; they
    and their index travel with the tasks, so they are as many as a person labels,
    not a table that grows. Null, empty and blank paragraphs are none. What reaches
    the driver: counts of the exemplars' grams."""
    index = Index(exemplars)
    counts = df.select(F.col(list_col).alias("p")).mapInArrow(_Count(index.known), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    counts = {r["slot"]: r["n"] for r in counts}
    index.weigh(counts, counts.pop(-1, 0))
    ddl = "id long, para_no int, kind string, text string"
    return df.select(F.col(id_col).alias("id"), F.col(list_col).alias("p")).mapInArrow(_Judge(index, ddl), ddl)
