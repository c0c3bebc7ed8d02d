"""Cleaning, quality flags, exact duplicates and cross-book decontamination of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from inkwell.functions import text as X
from inkwell.session import cut

#: Lines in a passage and the Han characters it must have to count.
PASSAGES = ((1, 80), (2, 100), (3, 120))
SHORT, PRIMARY = 50_000, 120_000


def quality_flags(raw: Column, clean: Column) -> Column:
    """Array of the quality flags of a text, in fixed order; a null text counts as missing."""
    n, m = X.han_count(clean), X.han_count(raw)
    hits = F.coalesce(F.regexp_count(clean, F.lit("€{2,}")), F.lit(0))
    hit_lines = F.coalesce(F.size(F.filter(F.split(clean, "\n"), lambda x: x.rlike("€{2,}"))), F.lit(0))
    note = lambda c: c.contains("作者有话要说") | c.contains("作者的话")
    tidy = X.tidy(clean)
    rules = [
        ("too_short_for_primary_benchmark", n < SHORT), ("short_text", (n >= SHORT) & (n < PRIMARY)),
        ("large_header_or_nonbody_drop", (m > 0) & (n / F.nullif(m, F.lit(0)) < 0.75)),
        ("raw_url_or_domain_text", raw.rlike(X.URL)), ("clean_url_or_domain_text", clean.rlike(X.URL)),
        ("raw_boilerplate_signal", raw.rlike(X.BOILERPLATE)), ("clean_boilerplate_signal", clean.rlike(X.BOILERPLATE)),
        ("adjacent_duplicate_lines", tidy.rlike("(?:^|\\n)([^\\n]+)\\n\\1(?:\\n|$)")),
        ("raw_author_notes_present", note(raw)), ("clean_author_notes_present", note(clean)),
        ("long_latin_span", raw.rlike("[A-Za-z]{30,}")), ("raw_unicode_replacement_char", raw.contains("�")),
        ("clean_replacement_artifacts", hits > 0), ("systemic_encoding_corruption", (hits >= 10) | (hit_lines >= 5)),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules]), lambda x: x.isNotNull())
    return F.when(raw.isNull(), F.array(F.lit("missing_txt"))).otherwise(found)


def primary_eligible(flags: Column, han: Column) -> Column:
    return (han >= SHORT) & ~F.array_contains(flags, "manifest_author_header_conflict") & ~F.array_contains(flags, "systemic_encoding_corruption")


def exact_duplicates(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(sha256, copies, first_id) of texts that occur more than once; null and empty texts are none."""
    return (
        df.where(F.col(text_col).isNotNull() & (F.col(text_col) != "")).groupBy(F.sha2(text_col, 256).alias("sha256"))
        .agg(F.count("*").alias("copies"), F.min(id_col).alias("first_id")).where("copies > 1")
    )


def passages(lines: DataFrame, rules: tuple[tuple[int, int], ...] = PASSAGES) -> DataFrame:
    """Windows of consecutive non-blank lines of a book with enough Han characters: (book, pos, size, fp).

    lines: (book, pos, line), pos counting the non-blank lines of the book. Windows
    are built by one sort per book; a hot book is one ordered partition of short rows."""
    w = W.partitionBy("book").orderBy("pos")
    base = lines.select("book", "pos", F.sha2(X.without_space("line"), 256).alias("h"), X.han_count("line").alias("n"))
    size = max(k for k, _ in rules)
    ahead = base.select("book", "pos", *[F.lead("h", k).over(w).alias(f"h{k}") for k in range(size)], *[F.lead("n", k).over(w).alias(f"n{k}") for k in range(size)])
    made = []
    for k, least in rules:
        total = sum((F.col(f"n{i}") for i in range(k)), F.lit(0))
        made.append(F.when(F.col(f"h{k - 1}").isNotNull() & (total >= least), F.struct(F.lit(k).alias("size"), F.sha2(F.concat_ws("\n", *[F.col(f"h{i}") for i in range(k)]), 256).alias("fp"), total.cast("long").alias("han"))))
    return ahead.select("book", "pos", F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("w")).select("book", "pos", "w.size", "w.fp", "w.han")


def shared_passages(windows: DataFrame) -> DataFrame:
    """(fp, size, occurrences, books) of passages that at least two books hold."""
    g = windows.groupBy("fp", "size").agg(F.count("*").alias("occurrences"), F.min("book").alias("a"), F.max("book").alias("b"))
    shared = g.where("a < b").select("fp", "size")
    books = windows.join(shared, ["fp", "size"], "left_semi").groupBy("fp", "size").agg(F.count("*").alias("occurrences"), F.countDistinct("book").alias("books"))
    return books


def marked_lines(lines: DataFrame, rules: tuple[tuple[int, int], ...] = PASSAGES) -> DataFrame:
    """(book, pos) of every line that a passage shared between books covers. Copies inside one book are kept."""
    w = cut(passages(lines, rules))
    shared = w.groupBy("fp", "size").agg(F.min("book").alias("a"), F.max("book").alias("b")).where("a < b").select("fp", "size")
    hit = w.join(shared, ["fp", "size"], "left_semi")
    return hit.select("book", F.explode(F.sequence("pos", F.col("pos") + F.col("size") - 1)).alias("pos")).distinct()


def decontaminated(lines: DataFrame, rules: tuple[tuple[int, int], ...] = PASSAGES) -> DataFrame:
    """lines without those that passages shared between books cover."""
    return lines.join(marked_lines(lines, rules), ["book", "pos"], "left_anti")


def adjacent_duplicates(lines: DataFrame) -> DataFrame:
    """Per book how many lines equal the one before; blank lines are none but do break a run."""
    w = W.partitionBy("book").orderBy("pos")
    same = (F.col("line") == F.lag("line").over(w)) & (F.col("line") != "")
    return lines.withColumn("same", same).groupBy("book").agg(F.sum(F.coalesce(F.col("same").cast("long"), F.lit(0))).alias("duplicates"))


def book_lines(chapters: DataFrame) -> DataFrame:
    """(book, pos, line) of the non-blank paragraphs of every book, in the order of chapters and paragraphs.

    Positions come from a running count over chapters plus the place inside the
    chapter, so that only one short row per chapter is sorted within a book."""
    kept = F.filter(F.transform("paragraphs", X.strip), lambda x: x.isNotNull() & (x != ""))
    base = chapters.select("book_id", "chapter_id", kept.alias("p")).where(F.col("book_id").isNotNull() & (F.size("p") > 0))
    w = W.partitionBy("book_id").orderBy("chapter_id").rowsBetween(W.unboundedPreceding, -1)
    placed = base.withColumn("before", F.coalesce(F.sum(F.size("p")).over(w), F.lit(0)))
    return placed.select(F.col("book_id").alias("book"), F.posexplode("p").alias("k", "line"), "before").select("book", (F.col("before") + F.col("k")).cast("long").alias("pos"), "line")
