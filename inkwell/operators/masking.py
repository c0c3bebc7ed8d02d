"""Content masks: candidate terms, their selection over a corpus, and masking of text.

Candidates are counted in the JVM: text is cut at stop characters and everything
that is not Han, and the short runs left give their n-grams. Selection is a chain
of aggregations; what reaches the driver is bounded by the limits on terms."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from inkwell.functions import text as X
from inkwell.functions.arrow import arrow_schema

# Characters no masked term holds.
STOP = (
    "的一是在不了有和人这中大为上个我以要他时来用们生到作地于出就分对成会可主发年动同工也能下过子说产种面而方后多定行学法所民得经之进着等部度家"
    "电力里如水化高自理起小物现实加都两体制机当使点从业本去把性好应开它合还因由其些然前外天那与关各重新线内正心反你看又么但向道此只没给被很最才并已让"
)
# Characters that a rescued term neither begins nor ends with.
EDGE = "的地得了着过说道问答喊叫想看见听向和与在把被给从到为是有将让又也都就才还却而"
MIN_IN_BOOK, MAX_TERMS = 4, 12_000
RESCUE_IN_BOOK, RESCUE_MAX_BOOKS, RESCUE_MAX_AUTHORS, RESCUE_SHARE = 20, 4, 2, 0.80
RESCUE_HIGH_SHARE, RESCUE_HIGH_COUNT, RESCUE_PART, MAX_RESCUED = 0.95, 100, 0.5, 4_000
NESTED = 0.95


def _grams(run: Column, sizes: range) -> Column:
    def of(k: int) -> Column:
        n = F.length(run) - (k - 1)
        return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(run, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(k) for k in sizes])


def _varied(term: Column) -> Column:
    """More than one distinct character."""
    return F.size(F.array_distinct(F.split(term, ""))) > F.when(F.element_at(F.split(term, ""), -1) == "", 2).otherwise(1)


def candidates(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(*keys, term, n): n-grams of 2 to 5 Han characters, no stop character, at least two different ones."""
    runs = df.select(*keys, F.explode(F.regexp_extract_all(F.regexp_replace(text, f"[{STOP}]", " "), F.lit("[\\u4e00-\\u9fff]{2,}"), F.lit(0))).alias("run"))
    return runs.select(*keys, F.explode(_grams(F.col("run"), range(2, 6))).alias("term")).where(_varied(F.col("term"))).groupBy(*keys, "term").agg(F.count("*").alias("n"))


def rescue_candidates(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(*keys, term, n): n-grams of 2 or 3 Han characters with a stop character inside but no edge character at an end."""
    runs = df.select(*keys, F.explode(F.regexp_extract_all(text, F.lit("[\\u4e00-\\u9fff]{2,}"), F.lit(0))).alias("run"))
    t = F.col("term")
    ok = t.rlike(f"[{STOP}]") & ~t.rlike(f"^[{EDGE}]|[{EDGE}]$")
    return runs.select(*keys, F.explode(_grams(F.col("run"), range(2, 4))).alias("term")).where(ok & _varied(t)).groupBy(*keys, "term").agg(F.count("*").alias("n"))


def global_terms(books: DataFrame, limit: int = MAX_TERMS, min_in_book: int = MIN_IN_BOOK) -> DataFrame:
    """(term, freq, books, authors, rank) of the standard terms of the fit books.

    books: (author, title, text), several rows a book allowed. A term counts in a
    book from min_in_book occurrences on; terms in few books (3, or a twentieth of
    them) or of one author are kept, ranked by freq x length / authors, then
    length, then term."""
    per = candidates(books.where("author is not null and title is not null"), ["author", "title"], "text").where(F.col("n") >= min_in_book)
    total = books.where("author is not null and title is not null and text is not null").select("author", "title").distinct().agg(F.greatest(F.lit(3), F.floor(F.count("*") / 20)).alias("most"))
    g = per.groupBy("term").agg(F.sum("n").alias("freq"), F.count("*").alias("books"), F.countDistinct("author").alias("authors"))
    kept = g.crossJoin(F.broadcast(total)).where("books <= most or authors <= 1").drop("most")
    order = [F.desc(F.col("freq") * F.length("term") / F.greatest("authors", F.lit(1))), F.desc(F.length("term")), "term"]
    top = kept.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("long"))


def rescued_terms(books: DataFrame, limit: int = MAX_RESCUED, min_in_book: int = RESCUE_IN_BOOK) -> DataFrame:
    """(term, freq, top, books, authors): terms with stop characters that one book owns.

    Seeded from min_in_book occurrences in some book, then counted over all."""
    base = books.where("author is not null and title is not null")
    per = rescue_candidates(base, ["author", "title"], "text")
    seeds = per.where(F.col("n") >= min_in_book).select("term").distinct()
    g = per.join(seeds, "term", "left_semi").groupBy("term").agg(
        F.sum("n").alias("freq"), F.max("n").alias("top"), F.count("*").alias("books"), F.countDistinct("author").alias("authors"), F.max_by(F.struct("author", "title"), F.struct(F.col("n"), F.col("author"), F.col("title"))).alias("owner")
    )
    share = F.col("top") / F.col("freq")
    kept = g.where((share >= RESCUE_SHARE) & ((F.col("books") <= RESCUE_MAX_BOOKS) & (F.col("authors") <= RESCUE_MAX_AUTHORS) | (share >= RESCUE_HIGH_SHARE) & (F.col("top") >= RESCUE_HIGH_COUNT)))
    chars = base.select("author", "title", F.explode(F.split(F.regexp_replace("text", X.NOT_HAN, ""), "")).alias("c")).where("c <> ''").groupBy("author", "title", "c").agg(F.count("*").alias("m"))
    pairs = kept.where(F.length("term") == 2).select("term", "top", F.col("owner.author").alias("author"), F.col("owner.title").alias("title"), F.explode(F.split("term", "")).alias("c")).where("c <> ''")
    part = pairs.join(chars, ["author", "title", "c"]).groupBy("term").agg(F.max(F.col("top") / F.col("m")).alias("part"))
    out = kept.join(part, "term", "left").where((F.length("term") != 2) | (F.col("part") >= RESCUE_PART))
    return out.orderBy(F.desc(F.col("freq") * F.length("term")), F.desc(F.length("term")), "term").limit(limit).select("term", "freq", "top", "books", "authors")


def canonical_terms(terms: set[str], counts: Mapping[str, int], coverage: float = NESTED) -> list[str]:
    """Entity cores: longest first, a term is dropped if its commonest sub-term occurs much more often, else it drops the sub-terms it accounts for."""
    active = set(terms)
    for t in sorted(terms, key=lambda t: (-len(t), -counts.get(t, 0), t)):
        n = counts.get(t, 0)
        if t not in active or n <= 0:
            continue
        inner = {t[i : i + k] for k in range(2, len(t)) for i in range(len(t) - k + 1)}
        inner = {x for x in inner if counts.get(x, 0) > 0}
        if not inner:
            continue
        if n / max(counts[x] for x in inner) < coverage:
            active.discard(t)
        else:
            active -= {x for x in inner if n / counts[x] >= coverage}
    return sorted(active, key=lambda t: (-len(t), t))


def title_terms(title: str | None) -> set[str]:
    """All 2- to 5-grams, with two different characters, of the Han runs of a title, and the runs themselves."""
    import re

    out: set[str] = set()
    for run in re.findall("[一-鿿]+", title or ""):
        if len(run) >= 2:
            out.add(run)
        out |= {g for k in range(2, min(5, len(run)) + 1) for i in range(len(run) - k + 1) if len(set(g := run[i : i + k])) > 1}
    return out


class TermMatcher:
    """Exact leftmost-longest replacement of terms, without overlap."""

    def __init__(self, terms: list[str]) -> None:
        self.terms = sorted({t for t in terms if t})
        self._machine = None

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "_machine": None}

    def _built(self) -> ahocorasick.Automaton | None:
        if self._machine is None and self.terms:
            a = ahocorasick.Automaton()
            for t in self.terms:
                a.add_word(t, len(t))
            a.make_automaton()
            self._machine = a
        return self._machine

    def matches(self, text: str) -> list[tuple[int, int]]:
        """[start, stop) of the matches, from the left, the longest at each place."""
        machine = self._built()
        if machine is None:
            return []
        longest: dict[int, int] = {}
        for end, n in machine.iter(text):
            a = end + 1 - n
            longest[a] = max(n, longest.get(a, 0))
        out, last = [], 0
        for a in sorted(longest):
            if a >= last:
                last = a + longest[a]
                out.append((a, last))
        return out

    def substitute(self, text: str, placeholder: str, keep_length: bool) -> str:
        """Matches as the placeholder, once or once per Han character."""
        out, last = [], 0
        for a, b in self.matches(text):
            out += [text[last:a], placeholder * (sum("一" <= c <= "鿿" for c in text[a:b]) if keep_length else 1)]
            last = b
        return "".join(out) + text[last:]


class _Mask:
    def __init__(self, terms: list[str], placeholder: str, keep_length: bool, ddl: str) -> None:
        self.matcher, self.placeholder, self.keep, self.schema = TermMatcher(terms), placeholder, keep_length, arrow_schema(ddl)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [None if t is None else self.matcher.substitute(t, self.placeholder, self.keep) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.string())], schema=self.schema)


def masked(df: DataFrame, id_col: str, text: Column, terms: list[str], placeholder: str = "某", keep_length: bool = True) -> DataFrame:
    """(id, text) with every term replaced; terms are bounded by the limits of their selection."""
    ddl = f"id {df.schema[id_col].dataType.simpleString()}, text string"
    return df.select(F.col(id_col).alias("id"), X.placeholders(text).alias("text")).mapInArrow(_Mask(terms, placeholder, keep_length, ddl), ddl)


def mask_density(df: DataFrame, by: list[str], text: str) -> DataFrame:
    """Chunks, Han characters, masked ones and their share per mille, by the given columns and in all combinations of them given by a cube."""
    n, m = X.han_count(text), F.coalesce(F.regexp_count(F.col(text), F.lit("某")), F.lit(0)).cast("long")
    g = df.withColumn("_n", n).withColumn("_m", m).cube(*by).agg(F.grouping_id().alias("level"), F.count("*").alias("chunks"), F.sum("_n").alias("han"), F.sum("_m").alias("masked"))
    return g.withColumn("per_1k", X.per_1k(F.col("masked"), F.col("han")))
