"""Column expressions on prose: counts, canonical forms, keys, labels. All run inside the JVM.

Null in gives null out unless a docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HAN = "[\\u4e00-\\u9fff]"
NOT_HAN = "[^\\u4e00-\\u9fff]"

# Full-width letters and digits, and their half-width forms.
FULL = "０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ"
HALF = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
# Variants of Chinese punctuation, and the form the corpus uses.
PUNCTUATION_FROM = "﹐﹑､﹒．｡!﹗?﹖;﹔﹕()﹙﹚[]﹝﹞「」﹁﹂『』〝〞–―─~＂"
PUNCTUATION_TO__ = "，、、。。。！！？？；；：（）（）【】【】“”“”‘’“”———～\""
# Characters that carry style rather than content.
FUNCTION_CHARS = "的一是在不了有和人这中为上个我以要他时来用们到地于出就对成会可也能下过而后定行得经之着等里如自起把性好应开还因由其些然前那与关各并已又但只没给被很最才让吗呢啊吧呀么"
# Lines that mirrors and shops add.
BOILERPLATE = (
    "晋江文学城|jjwxc|请收藏|收藏此文章|霸王票|手机阅读|最新网址|返回目录|书友群|盗文|防盗|点击下一章|上一章|下一章|本书由|整理制作|TXT下载|电子书|更多精彩|"
    "营养液加更|感谢.*营养液|这个段落是图片段落|请访问正确的网站|原版未篡改内容请移至|关闭广告拦截功能|退出浏览器阅读模式"
)
URL = "(?i)https?://|www\\.|\\.com|\\.net|\\.org"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def han_count(c: Column | str) -> Column:
    """Number of Han characters."""
    return F.length(F.regexp_replace(col(c), NOT_HAN, "")).cast("long")


def half_width(c: Column | str) -> Column:
    """Full-width letters and digits as ASCII; nothing else changes."""
    return F.translate(col(c), FULL, HALF)


def squeeze_commas(c: Column | str) -> Column:
    """Runs of ， as one, and ， before a full stop, exclamation or question mark dropped."""
    return F.regexp_replace(F.regexp_replace(col(c), "，{2,}", "，"), "，([。！？])", "$1")


def fix_doubled_quotes(c: Column | str) -> Column:
    """Doubled quotes: ““ at the start or behind a colon, ”” at the end, 。““ between speeches."""
    s = F.regexp_replace(col(c), "^““", "“")
    s = F.regexp_replace(s, "：““", "：“")
    s = F.regexp_replace(s, "””$", "”")
    return F.regexp_replace(s, "([。！？])““", "$1”“")


def close_cjk_spaces(c: Column | str) -> Column:
    """No space next to Chinese punctuation."""
    s = F.regexp_replace(col(c), " +([，。！？；：、”’）》】])", "$1")
    return F.regexp_replace(s, "([，。！？；：、“‘（《【]) +", "$1")


def drop_group_ads(c: Column | str) -> Column:
    """Without 资源群：number residue."""
    return F.regexp_replace(col(c), "资源群[:：] *[0-9]{5,}", "")


def collapse_space(c: Column | str) -> Column:
    """White-space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(col(c), "[ \\t\\n\\r\\x0B\\f\\u3000\\u00a0]+", " "))


def without_space(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "[ \\t\\n\\r\\x0B\\f\\u3000\\u00a0]+", "")


def strip(c: Column | str) -> Column:
    """Python's strip for the white space that occurs in prose."""
    return F.regexp_replace(col(c), "^[ \\t\\n\\r\\x0B\\f\\u3000\\u00a0]+|[ \\t\\n\\r\\x0B\\f\\u3000\\u00a0]+$", "")


def tidy(c: Column | str) -> Column:
    """One kind of line end, lines stripped, runs of blank lines as one, none at the ends."""
    s = F.regexp_replace(col(c), "\r\n?", "\n")
    s = F.regexp_replace(s, "[ \\t\\x0B\\f\\u3000\\u00a0]*\n[ \\t\\x0B\\f\\u3000\\u00a0]*", "\n")
    return strip(F.regexp_replace(s, "\n{3,}", "\n\n"))


def lines(c: Column | str) -> Column:
    """The lines of `tidy` text, with "" for a blank one. Null gives null, blank text an empty array."""
    s = tidy(c)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, "\n"))


def canonical_punctuation(c: Column | str) -> Column:
    """Ellipses, dashes and ASCII marks in their Chinese form; , . : between digits stay; balanced straight quotes stay for `curl_quotes`."""
    s = F.regexp_replace(col(c), "\\.{2,}", "……")
    s = F.regexp_replace(s, "…+", "……")
    s = F.regexp_replace(s, "-{2,}|[—–―─]{2,}", "——")
    for mark, to in ((",", "，"), ("\\.", "。"), (":", "：")):
        s = F.regexp_replace(s, f"(?<![0-9]){mark}|{mark}(?![0-9])", to)
    return F.translate(s, PUNCTUATION_FROM, PUNCTUATION_TO__)


def curl_quotes(c: Column | str) -> Column:
    """Straight double quotes as “ and ” in turn, in lines that have an even number of them."""

    def one(line: Column) -> Column:
        parts = F.split(line, '"')
        joined = F.aggregate(
            F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
            F.struct(F.get(parts, F.lit(0)).alias("s"), F.lit(True).alias("open")),
            lambda acc, x: F.struct(F.concat(acc["s"], F.when(acc["open"], "“").otherwise("”"), x).alias("s"), (~acc["open"]).alias("open")),
            lambda acc: acc["s"],
        )
        return F.when(F.size(parts) % 2 == 1, joined).otherwise(line)

    return F.array_join(F.transform(F.split(col(c), "\n"), one), "\n")


def placeholders(c: Column | str) -> Column:
    """Latin words as <LATIN>, numbers as <NUM>, nested brackets of placeholders as one."""
    s = F.regexp_replace(col(c), "[A-Za-z][A-Za-z0-9_'-]*", "<LATIN>")
    s = F.regexp_replace(s, "[0-9]+([.,:/-][0-9]+)*", "<NUM>")
    return F.regexp_replace(s, "<+(CONTENT|NUM|LATIN)>+", "<$1>")


def structure_only(c: Column | str) -> Column:
    """Every Han character as 文, after `placeholders`."""
    return F.regexp_replace(placeholders(c), HAN, "文")


def topic_distorted(c: Column | str) -> Column:
    """Every Han character that does not carry style as 文, after `placeholders`."""
    return F.regexp_replace(placeholders(c), f"(?![{FUNCTION_CHARS}]){HAN}", "文")


def collapse_mask_runs(c: Column | str) -> Column:
    """Every run of the mask character 某 as one, without white space."""
    return F.regexp_replace(without_space(c), "某+", "某")


def is_scene_break(c: Column | str) -> Column:
    return F.coalesce(strip(c).rlike("^(\\*{3,}|\\*( \\*){2,})$"), F.lit(False))


def is_separator(c: Column | str) -> Column:
    """A line of dashes only."""
    return F.coalesce(strip(c).rlike("^[-—–―─]{2,}$"), F.lit(False))


def escape_xml(c: Column | str) -> Column:
    s = F.replace(col(c), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(s, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def safe_id(c: Column | str) -> Column:
    """A name fit for files and keys; untitled where nothing is left."""
    s = F.regexp_replace(F.regexp_replace(strip(c), "[\\\\/:*?\"<>|]+", "_"), "[ \\t\\n\\r\\x0B\\f\\u3000\\u00a0]+", "_")
    return F.when(s == "", "untitled").otherwise(s)


def canonical_author(c: Column | str, aliases: dict[str, str]) -> Column:
    """An author's main name, by a map of second names."""
    if not aliases:
        return col(c)
    m = F.create_map(*[F.lit(x) for kv in sorted(aliases.items()) for x in kv])
    return F.coalesce(F.try_element_at(m, col(c)), col(c))


def section_kind(c: Column | str) -> Column:
    """What a heading opens: extra, afterword, synopsis, or the empty string for the story."""
    h = col(c)
    return F.when(h.rlike("番外|外传|外傳|特典"), "extra").when(h.rlike("后记|後記"), "afterword").when(h.rlike("简介|簡介|文案"), "synopsis").when(h.isNotNull(), "")


def is_chapter_heading(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike("^[ \\t\\u3000]*(第[0-9零一二三四五六七八九十百千万两〇]+[章节卷部篇回]|正文|楔子|引子|序章|序|尾声)([^\\p{L}\\p{N}_]|$)"), F.lit(False))


def per_1k(count: Column, whole: Column) -> Column:
    """Rate per thousand; 0 where the whole is 0 or null."""
    return F.coalesce(count / F.nullif(whole, F.lit(0)) * 1000, F.lit(0.0))


def bucket(value: Column, edges: tuple[int, ...]) -> Column:
    """le_x for the first edge x that is not exceeded, else gt_x of the last."""
    out = None
    for e in edges:
        out = F.when(value <= e, f"le_{e}") if out is None else out.when(value <= e, f"le_{e}")
    return out.otherwise(F.when(value.isNotNull(), f"gt_{edges[-1]}"))


def tercile(value: Column, first: Column, second: Column) -> Column:
    return F.when(value <= first, "low").when(value <= second, "medium").when(value.isNotNull(), "high")


def position_bucket(index: Column, last: Column) -> Column:
    """Where in a book a chunk stands: opening, early, middle, late or ending."""
    r = index / F.greatest(last, F.lit(1))
    return F.when(r <= 0.10, "opening").when(r <= 0.33, "early").when(r <= 0.67, "middle").when(r <= 0.90, "late").when(r.isNotNull(), "ending")


def salted(c: Column | str, salt: str) -> Column:
    """Order key: sha256 of salt:value."""
    return F.sha2(F.concat(F.lit(f"{salt}:"), col(c).cast("string")), 256)


def opaque_id(c: Column | str, seed: int, sample: str) -> Column:
    return F.concat(F.lit("s_"), F.substring(F.sha2(F.concat(F.lit(f"{seed}:{sample}:"), col(c).cast("string")), 256), 1, 24))


def paragraph_kind(c: Column | str) -> Column:
    """empty, dialogue, question, attribution_open or narration."""
    s = strip(c)
    return (
        F.when(s == "", "empty").when(s.rlike("^[“\"「『]"), "dialogue").when(s.rlike("[？?]$"), "question")
        .when(F.substring(s, 1, 18).rlike("说|道|问|答|喊|叫|笑"), "attribution_open").when(s.isNotNull(), "narration")
    )
