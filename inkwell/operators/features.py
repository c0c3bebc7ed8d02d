"""Stylometric features of texts: named families that give feature counts, and metrics in columns.

A family is a table of measures over views of a text. A view is an array or a
number made once per text by Column expressions (its lines, the Han lengths of
its sentences, its function words); a measure says what features a view gives.
`feature_counts` runs a family in the JVM; nothing is counted in Python."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from inkwell.functions import text as X

# Marks counted, marks of speech, ends of sentences.
MARKS = "，。！？；：、“”‘’（）《》【】…—,.!?;:\"'()[]"
SPEECH = "“”‘’「」『』"
ENDS = "[。！？!?]+"
# Function words by group.
FUNCTION_WORDS = {
    "connective": "因为 所以 因此 但是 不过 然而 而且 并且 或者 还是 如果 假如 虽然 尽管 既然 于是 然后 接着 随后 况且 此外 另外 以及 甚至 尤其 总之 至少 反正 其实 当然",
    "modal_aspect": "已经 正在 曾经 将要 快要 就要 仍然 依然 终于 立刻 马上 忽然 突然 大概 可能 也许 应该 必须 需要 可以 能够 愿意 不会 不是 没有 不能 不用 不要 不得不 未必",
    "deictic_pronoun": "这个 那个 这些 那些 这里 那里 这样 那样 这么 那么 怎么 什么 为什么 哪里 哪个 自己 别人 大家 彼此 对方",
    "particle_phrase": "而已 罢了 似的 一样 起来 下去 出来 进去 过去 过来 一下 一会儿 是不是 对不对 有没有 好不好 怎么办 怎么样 什么样 没什么",
    "preposition_frame": "关于 对于 由于 为了 按照 根据 通过 经过 除了 作为 并非 并不 无法 无论 不管 只要 只有 除非 无非 至于",
}
WORD_GROUP = {w: g for g, ws in FUNCTION_WORDS.items() for w in ws.split()}
WORD_PATTERN = "|".join(sorted(WORD_GROUP, key=lambda w: (-len(w), w)))
# White space, and what ends a line.
WHITE = "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
LINE_END = "\\r\\n|[\\n-\\r\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"
OPENING = "“\"「『"
# Characters that tell who speaks, near the start of a paragraph.
SAYING = "说道问答喊叫笑"


# ---- views -------------------------------------------------------------------------


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c if c in "[]\\^-&" else c for c in chars) + "]"


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


def _long(c: Column) -> Column:
    return F.size(c).cast("long")


def _han(c: Column) -> Column:
    return F.length(F.regexp_replace(c, X.NOT_HAN, ""))


def _total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def _mean(c: Column) -> Column:
    return F.when(F.size(c) > 0, _total(c) / F.size(c)).otherwise(0.0)


def _deviation(c: Column) -> Column:
    m = _mean(c)
    return F.when(F.size(c) > 0, F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(c))).otherwise(0.0)


def _share_of(c: Column, holds: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(c, holds)) / F.greatest(F.size(c), F.lit(1))


def _quantile(c: Column, q: float) -> Column:
    """Linear between the two nearest of a sorted array; 0 of an empty one."""
    at = (F.size(c) - 1) * F.lit(q)
    k = F.floor(at).cast("int")
    low, high = F.get(c, k), F.get(c, F.least(k + 1, F.size(c) - 1))
    return F.when(F.size(c) > 0, low + (high - low) * (at - k)).otherwise(0.0)


def _runs(c: Column, n: int) -> Column:
    """Every n consecutive elements of an array, joined by >."""
    size = F.greatest(F.size(c) - n + 1, F.lit(0))
    out = F.slice(c, 1, size)
    for k in range(1, n):
        out = F.zip_with(out, F.slice(c, k + 1, size), lambda a, b: F.concat(a, F.lit(">"), b))
    return out


def _grams(c: Column, sizes: tuple[int, ...], name: str) -> Column:
    """Runs of characters of a text, each under its size where name asks for it."""
    each = lambda n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.concat(F.lit(name.format(n)), F.substring(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))
    return F.concat(*[each(n) for n in sizes])


def _kind(p: Column) -> Column:
    said = F.substring(p, 1, 18).rlike(_class(SAYING))
    return F.when(p.rlike("^" + _class(OPENING)), "dialogue").when(p.rlike("[？?]$"), "question").when(said, "attribution_open").otherwise("narration")


def _shape(s: Column) -> Column:
    n, commas, end = _han(s), F.length(s) - F.length(F.translate(s, "，,", "")), F.substring(_bare(s), -1, 1)
    size = F.when(n <= 12, "S").when(n <= 32, "M").otherwise("L")
    return F.concat(size, F.lit("."), F.least(commas, F.lit(3)).cast("string"), F.lit("."), F.when(end.isin("？", "?"), "Q").when(end.isin("！", "!"), "E").otherwise("D"))


_t = F.col
#: View -> what makes it, in order: a view may use those before it.
VIEWS: dict[str, Callable[[], Column]] = {
    "han": lambda: _han(_t("t")),
    "lines": lambda: F.filter(F.transform(F.split("t", LINE_END), _bare), lambda x: x != ""),
    "line_han": lambda: F.transform("lines", _han),
    "piece_han": lambda: F.filter(F.transform(F.split("t", ENDS), _han), lambda n: n > 0),
    "marks": lambda: _all(_t("t"), _class(MARKS)),
    "speech": lambda: _all(_t("t"), _class(SPEECH)),
    "colons": lambda: _all(_t("t"), "[：:]"),
    "dots": lambda: _all(_t("t"), "…"),
    "spoken": lambda: F.filter("lines", lambda x: x.rlike("^" + _class(OPENING))),
    "characters": lambda: _all(_t("t"), f"[{X.FUNCTION_CHARS}]"),
    "words": lambda: _all(_t("t"), WORD_PATTERN),
    "groups": lambda: F.transform("words", lambda w: F.element_at(F.create_map(*[F.lit(x) for kv in WORD_GROUP.items() for x in kv]), w)),
    "steps": lambda: F.transform(_all(_t("t"), WORD_PATTERN + "|[。！？!?]"), lambda w: F.when(w.rlike("^[。！？!?]$"), "|").otherwise(w)),
    "close": lambda: F.regexp_replace("t", WHITE + "+", ""),
    "parts": lambda: F.filter(F.split("close", "某+"), lambda x: x != ""),
    "only_han": lambda: F.regexp_replace("t", X.NOT_HAN, ""),
    "mask_runs": lambda: F.transform(_all(_t("only_han"), "某+"), F.length),
    "mask_gaps": lambda: F.transform(F.filter(F.split("only_han", "某+"), lambda x: x != ""), F.length),
    "sentences": lambda: F.filter(_all(_t("t"), "[^。！？!?]+[。！？!?]*"), lambda s: s.rlike(X.HAN)),
    "sentence_han": lambda: F.array_sort(F.transform("sentences", _han)),
    "clause_han": lambda: F.array_sort(F.filter(F.transform(F.flatten(F.transform("sentences", lambda s: F.split(s, "[，,；;：:]"))), _han), lambda n: n > 0)),
    "shapes": lambda: F.transform("sentences", _shape),
    "kinds": lambda: F.transform("lines", _kind),
    "sized_kinds": lambda: F.zip_with("kinds", "line_han", lambda k, n: F.concat(k, F.lit("."), F.when(n <= 15, "S").when(n <= 60, "M").otherwise("L"))),
    "sorted_lines": lambda: F.array_sort("line_han"),
    "line_sentences": lambda: F.array_sort(F.transform("lines", lambda p: F.size(F.filter(F.split(p, "[。！？!?]"), lambda s: s.rlike(X.HAN))))),
    "speech_runs": lambda: F.transform(_all(F.array_join(F.transform("kinds", lambda k: F.substring(k, 1, 1)), ""), "d+"), F.length),
}


# ---- measures: what features a view gives ----------------------------------------------


@dataclass(frozen=True)
class Tokens:
    """A feature per distinct token: how often it stands, times scale over per."""

    prefix: str
    of: Callable[[], Column]
    scale: float = 1.0
    per: Callable[[], Column] = lambda: F.lit(1)

    def entries(self) -> Column:
        return F.transform(self.of(), lambda x: _entry(F.concat(F.lit(self.prefix), x), F.lit(self.scale), self.per()))


@dataclass(frozen=True)
class Bucket:
    """A feature named after the interval that a number falls into."""

    name: str
    of: Callable[[], Column]
    edges: tuple[int, ...]

    def label(self, x: Column) -> Column:
        c = None
        for e in self.edges:
            c = (F if c is None else c).when(x <= e, f"{self.name}:le_{e}")
        return c.otherwise(f"{self.name}:gt_{self.edges[-1]}")

    def entries(self) -> Column:
        x = self.of()
        return F.when(x.isNotNull(), F.array(_entry(self.label(x), F.lit(1.0), F.lit(1)))).otherwise(_none())


class Buckets(Bucket):
    """The same for every number of an array."""

    def entries(self) -> Column:
        return F.transform(self.of(), lambda x: _entry(self.label(x), F.lit(1.0), F.lit(1)))


@dataclass(frozen=True)
class Number:
    """A number as it is; null gives no feature."""

    name: str
    of: Callable[[], Column]

    def entries(self) -> Column:
        x = self.of().cast("double")
        return F.when(x.isNotNull(), F.array(_entry(F.lit(self.name), x, F.lit(1)))).otherwise(_none())


def _none() -> Column:
    return F.array().cast("array<struct<feature:string,n:double,per:double>>")


def _entry(feature: Column, n: Column, per: Column) -> Column:
    return F.struct(feature.alias("feature"), n.cast("double").alias("n"), per.cast("double").alias("per"))


def _view(name: str) -> Callable[[], Column]:
    return lambda: F.col(name)


def _count(name: str) -> Callable[[], Column]:
    return lambda: F.size(name)


def _rate(name: str, scale: int, per: Callable[[], Column]) -> Callable[[], Column]:
    return lambda: F.size(name) * float(scale) / F.greatest(per(), F.lit(1))


def _mean_or_none(name: str) -> Callable[[], Column]:
    return lambda: F.when(F.size(name) > 0, _mean(F.col(name)))


def _spread(view: str, name: str, short: int, long: int) -> list:
    """Mean, deviation, quantiles, and shares of short and long ones, of a sorted view of lengths."""
    c = lambda: F.col(view)
    return [
        Number(f"mean_{name}", lambda: _mean(c())), Number(f"sd_{name}", lambda: _deviation(c())),
        *[Number(f"p{q}_{name}", lambda q=q: _quantile(c(), q / 100)) for q in (10, 25, 50, 75, 90)],
        Number(f"short_{name}", lambda: _share_of(c(), lambda n: n <= short)), Number(f"long_{name}", lambda: _share_of(c(), lambda n: n >= long)),
    ]


def _sequence(prefix: str, view: str, n: int) -> Tokens:
    """Shares of the runs of n consecutive elements."""
    return Tokens(prefix, lambda: _runs(F.col(view), n), 1.0, lambda: F.greatest(F.size(view) - n + 1, F.lit(1)))


def _pair_share(view: str, holds: Callable[[Column, Column], Column]) -> Callable[[], Column]:
    """Share of the neighbouring elements that holds is true of."""

    def of() -> Column:
        n = F.greatest(F.size(view) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(view, 1, n), F.slice(view, 2, n), holds)
        return F.size(F.filter(pairs, lambda x: x)) / F.greatest(n, F.lit(1))

    return of


MARKS_AND_SPEECH = (
    Tokens("punc:", _view("marks")), Tokens("dialogue_mark:", _view("speech")),
    Bucket("dialogue_line_ratio", _rate("spoken", 100, _count("lines")), (5, 15, 30, 50, 75)), Bucket("quote_count", _count("speech"), (2, 6, 12, 24, 48)),
    Bucket("colon_count", _count("colons"), (1, 3, 6, 12, 24)), Bucket("ellipsis_count", _count("dots"), (1, 2, 4, 8, 16)),
)
LENGTHS = (
    Bucket("paragraph_count", _count("lines"), (1, 2, 4, 8, 16, 32)), Bucket("sentence_count", _count("piece_han"), (3, 6, 10, 16, 24, 40)),
    Bucket("avg_sentence_cjk", _mean_or_none("piece_han"), (12, 20, 32, 48, 72, 110)), Buckets("sentence_cjk", _view("piece_han"), (8, 16, 28, 45, 70, 110, 180)),
    Bucket("avg_paragraph_cjk", _mean_or_none("line_han"), (40, 80, 140, 220, 360, 600)), Buckets("paragraph_cjk", _view("line_han"), (30, 70, 120, 200, 340, 560, 900)),
)
CHARACTERS = (Tokens("function_char:", _view("characters")), Bucket("function_ratio", _rate("characters", 100, _view("han")), (20, 30, 40, 50, 60, 70)))
WORDS = (
    Tokens("function_word:", _view("words")), Tokens("function_word_group:", _view("groups")),
    Bucket("function_word_ratio", _rate("words", 1000, _view("han")), (2, 5, 10, 20, 35, 55, 80, 120)),
    Bucket("function_word_diversity", lambda: F.size(F.array_distinct("words")), (2, 4, 8, 12, 18, 26, 36, 50)),
)
TOPOLOGY = (
    Number("cjk_count", _view("han")), Number("mask_fraction", lambda: _total(F.col("mask_runs")) / F.greatest("han", F.lit(1))), Number("run_count_per_1k", _rate("mask_runs", 1000, _view("han"))),
    *[m for name in ("run", "gap") for m in (Number(f"{name}_length_mean", _mean_or_none(f"mask_{name}s")), Number(f"{name}_length_max", lambda name=name: F.array_max(f"mask_{name}s")))],
)
RHYTHM = (*_spread("sentence_han", "sentence", 12, 40), *_spread("clause_han", "clause", 6, 24), _sequence("shape:", "shapes", 1), _sequence("shapes:", "shapes", 2))
GRAMMAR = (
    Tokens("rate:", _view("words"), 1000.0, lambda: F.greatest("han", F.lit(1))), Tokens("group:", _view("groups"), 1000.0, lambda: F.greatest("han", F.lit(1))),
    _sequence("next:", "steps", 2), Number("diversity", lambda: F.size(F.array_distinct("words")) / F.greatest(F.size("words"), F.lit(1))),
)
DISCOURSE = (
    *[Number(f"{k}_paragraph", v) for k, v in (("mean", lambda: _mean(F.col("sorted_lines"))), ("sd", lambda: _deviation(F.col("sorted_lines"))))],
    *[Number(f"p{q}_paragraph", lambda q=q: _quantile(F.col("sorted_lines"), q / 100)) for q in (25, 50, 75, 90)],
    Number("short_paragraph", lambda: _share_of(F.col("line_han"), lambda n: n <= 15)), Number("long_paragraph", lambda: _share_of(F.col("line_han"), lambda n: n >= 80)),
    Number("variation_paragraph", lambda: _deviation(F.col("sorted_lines")) / F.greatest(_mean(F.col("sorted_lines")), F.lit(1.0))),
    Number("mean_sentences", lambda: _mean(F.col("line_sentences"))), Number("p90_sentences", lambda: _quantile(F.col("line_sentences"), 0.9)), Number("single_sentence", lambda: _share_of(F.col("line_sentences"), lambda n: n == 1)),
    _sequence("kind:", "kinds", 1), _sequence("kinds:", "kinds", 2), *[_sequence(f"sequence{n}:", "sized_kinds", n) for n in (1, 2, 3)],
    Number("question_response", _pair_share("kinds", lambda a, b: (a == "question") & b.isin("dialogue", "attribution_open"))),
    Number("alternation", _pair_share("kinds", lambda a, b: F.array_sort(F.array(a, b)) == F.array(F.lit("dialogue"), F.lit("narration")))),
    Number("dialogue_run_mean", lambda: _mean(F.col("speech_runs"))), Number("dialogue_run_max", lambda: F.coalesce(F.array_max("speech_runs"), F.lit(0))),
)

FAMILIES: dict[str, tuple] = {
    "char_ngrams": (Tokens("", lambda: _grams(F.col("close"), (2, 3, 4), "char{}:")),),
    "punctuation_dialogue": MARKS_AND_SPEECH,
    "length_shape": LENGTHS,
    "function_chars": CHARACTERS,
    "function_words": WORDS,
    "function_words_plus_chars": (*CHARACTERS, *WORDS),
    "combined_interpretable": (*MARKS_AND_SPEECH, *LENGTHS, *CHARACTERS),
    "combined_rich_function_words": (*MARKS_AND_SPEECH, *LENGTHS, *CHARACTERS, *WORDS),
    "mask_stripped_ngrams": (Tokens("", lambda: F.flatten(F.transform("parts", lambda x: _grams(x, (2, 3, 4), "")))),),
    "mask_topology": TOPOLOGY,
    "sentence_rhythm": RHYTHM,
    "function_grammar": GRAMMAR,
    "paragraph_discourse": DISCOURSE,
}


def feature_counts(df: DataFrame, id_col: str, text_col: str, family: str) -> DataFrame:
    """(id, feature, value) of one family, per row of df; a null text has none, repeated rows are counted each by itself."""
    views = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("_row"), F.col(text_col).alias("t"))
    for name, made in VIEWS.items():
        views = views.withColumn(name, made())
    entries = F.concat(*[m.entries() for m in FAMILIES[family]])
    each = views.select("id", "_row", F.explode(entries).alias("e"))
    return each.groupBy("id", "_row", "e.feature").agg((F.sum("e.n") / F.max("e.per")).alias("value")).select("id", "feature", "value")


def char_counts(df: DataFrame, keys: list[str], text: str, chars: str) -> DataFrame:
    """(*keys, c, n): how often each of the given characters occurs, counted in the JVM."""
    kept = F.regexp_replace(text, "[^" + "".join("\\" + c if c in "[]\\^-&" else c for c in chars) + "]", "")
    return df.select(*keys, F.explode(F.split(kept, "")).alias("c")).where("c <> ''").groupBy(*keys, "c").agg(F.count("*").alias("n"))


def _share(a: Column, b: Column, scale: float = 1.0) -> Column:
    return a * F.lit(scale) / F.greatest(b, F.lit(1))


def _times(c: str, chars: str) -> Column:
    return (F.length(c) - F.length(F.translate(F.col(c), chars, ""))).cast("long")


def flow_metrics(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Flow of a text in columns: counts, mean lengths, densities and rates per hundred Han characters.

    All Han stand in lines and sentences that count, so mean lengths need no sum over
    them. A null text has no row; a blank one has zeros."""
    base = df.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.col(text_col).alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike("[^ \\t\\n\\r\\x0B\\f\\u3000\\u00a0]"))
    counted = base.select(
        id_col, X.han_count("t").alias("han"), F.size(lines).cast("long").alias("paragraphs"), F.size(F.filter(F.split("t", ENDS), lambda x: x.rlike("[\\u4e00-\\u9fff]"))).cast("long").alias("sentences"),
        F.size(F.filter(F.split("t", "\n"), lambda x: x.rlike("^[ \\t\\n\\r\\x0B\\f\\u3000\\u00a0]*[“\"「『]"))).alias("_spoken"), F.length("t").cast("long").alias("_chars"),
        *[_times("t", chars).alias(k) for k, chars in (("_marks", MARKS), ("_speech", SPEECH), ("_function", X.FUNCTION_CHARS), ("_comma", "，"), ("_period", "。"), ("_colon", "；："), ("_dash", "…—"))],
    )
    c, n = F.col, F.col("han")
    return counted.select(
        id_col, "han", "paragraphs", "sentences", _share(n, c("paragraphs")).alias("mean_paragraph"), _share(n, c("sentences")).alias("mean_sentence"),
        _share(c("_marks"), c("_chars")).alias("mark_density"), _share(c("_speech"), c("_chars")).alias("speech_density"), _share(c("_spoken"), c("paragraphs")).alias("spoken_share"),
        *[_share(c(f"_{k}"), n, 100).alias(f"{k}_per_100") for k in ("function", "comma", "period", "colon", "dash")],
    )


def quoted_han(text: str) -> int:
    """Han characters inside quotes, which may nest; a closing quote without its opening one is passed over."""
    pairs = {"”": "“", "’": "‘", "」": "「", "』": "『"}
    stack: list[str] = []
    n = 0
    for c in text:
        if c in pairs.values():
            stack.append(c)
        elif c in pairs and stack and stack[-1] == pairs[c]:
            stack.pop()
        elif stack and "一" <= c <= "鿿":
            n += 1
    return n
