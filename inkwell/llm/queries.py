"""Queries of the text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.llm import bilingual, encoding, grouped_split, lookalike, mixing, packing, reading_level, residue, shared_spans, site_lines
from inkwell.plans.registry import Registry, table

R = Registry()


@R.query("p1_found")
def p1_found(spark, d):
    """Every two rows of chapters that share a run of at least 200 code points."""
    return shared_spans.shared_pairs(table(spark, d, "chapters")).select(F.col("a").alias("chapter_a"), F.col("b").alias("chapter_b"))


@R.query("p1_spans")
def p1_spans(spark, d):
    """Per chapter the maximal stretches that other chapters hold, as [start, stop) in its text."""
    return shared_spans.shared_intervals(table(spark, d, "chapters")).select(F.col("id").alias("chapter_id"), "start", "stop")


@R.query("p1_shares")
def p1_shares(spark, d):
    """Per chapter its length, the code points shared elsewhere and their share."""
    return shared_spans.shared_shares(table(spark, d, "chapters"))


@R.query("p1_deduped")
def p1_deduped(spark, d):
    """The chapters' texts without the sentences that a non-first repeated span covers."""
    return shared_spans.drop_repeats(table(spark, d, "chapters"))


@R.query("p7_found")
def p7_found(spark, d):
    """Every two stored author values of records that must be in one split."""
    return grouped_split.tied_authors(table(spark, d, "records"))


@R.query("p7_groups")
def p7_groups(spark, d):
    """One row per stored author value: the group of records that must be in one split."""
    return grouped_split.author_groups(table(spark, d, "records"))


@R.query("p7_splits")
def p7_splits(spark, d):
    """One split per row of records."""
    return grouped_split.split_records(table(spark, d, "records")).select("chunk_id", "author", "title", "group", "split")


@R.query("p7_shares")
def p7_shares(spark, d):
    """The shares of records reached by each split."""
    return grouped_split.shares_reached(grouped_split.split_records(table(spark, d, "records")))


@R.query("p6_found")
def p6_found(spark, d):
    """Every paragraph whose line is repeated excessively within its site."""
    return site_lines.site_lines(table(spark, d, "chapters")).select(F.col("id").alias("chapter_id"), F.col("para_no").cast("int").alias("para_no"))


@R.query("p6_lines")
def p6_lines(spark, d):
    """The frequent lines per site."""
    return site_lines.frequent_lines(table(spark, d, "chapters"))


@R.query("p6_cleaned")
def p6_cleaned(spark, d):
    """The chapters without their site's lines."""
    chapters = table(spark, d, "chapters")
    return site_lines.without_paragraphs(chapters, site_lines.site_lines(chapters))


@R.query("p2_found")
def p2_found(spark, d):
    """Every paragraph that holds text decoded with a wrong encoding."""
    return encoding.garbled_paragraphs(table(spark, d, "chapters")).select(F.col("id").alias("chapter_id"), "para_no")


@R.query("p2_restored")
def p2_restored(spark, d):
    """Those paragraphs with their original text, where nothing was lost."""
    return encoding.garbled_paragraphs(table(spark, d, "chapters")).withColumnRenamed("id", "chapter_id")


@R.query("p4_found")
def p4_found(spark, d):
    """Every title or paragraph that is not in the consistent form."""
    return lookalike.variants(table(spark, d, "chapters")).select(F.col("id").alias("chapter_id"), "para_no")


@R.query("p4_forms")
def p4_forms(spark, d):
    """Those titles and paragraphs with their consistent form."""
    return lookalike.variants(table(spark, d, "chapters")).withColumnRenamed("id", "chapter_id")


@R.query("p5_found")
def p5_found(spark, d):
    """Every paragraph that a template or a failing site left."""
    return residue.residue(table(spark, d, "chapters")).select(F.col("id").alias("chapter_id"), "para_no")


@R.query("p5_kinds")
def p5_kinds(spark, d):
    """Those paragraphs by kind."""
    return residue.residue(table(spark, d, "chapters")).withColumnRenamed("id", "chapter_id")


@R.query("p5_cleaned")
def p5_cleaned(spark, d):
    """The chapters without residue."""
    chapters = table(spark, d, "chapters")
    return site_lines.without_paragraphs(chapters, residue.residue(chapters))


@R.query("p8_containers")
def p8_containers(spark, d):
    """The container of every document, or of its pieces, for every capacity."""
    return packing.packed(table(spark, d, "documents"), table(spark, d, "bin_sizes")).withColumnRenamed("id", "doc_id")


@R.query("p8_unused")
def p8_unused(spark, d):
    """Per capacity how many containers there are and how much of them is unused."""
    bins = table(spark, d, "bin_sizes")
    return packing.unused(packing.packed(table(spark, d, "documents"), bins), bins)


@R.query("p9_draws")
def p9_draws(spark, d):
    """How often each document is taken."""
    return mixing.drawn(table(spark, d, "documents"), table(spark, d, "mix_targets")).withColumnRenamed("id", "doc_id")


@R.query("p9_shares")
def p9_shares(spark, d):
    """Per source the share reached."""
    targets = table(spark, d, "mix_targets")
    return mixing.shares_reached(mixing.drawn(table(spark, d, "documents"), targets), targets)


@R.query("p9_mixture")
def p9_mixture(spark, d):
    """The mixture, one row per copy, in a global random order."""
    return mixing.mixture(mixing.drawn(table(spark, d, "documents"), table(spark, d, "mix_targets"))).withColumnRenamed("id", "doc_id")


@R.query("p10_levels")
def p10_levels(spark, d):
    """The reading level of every document."""
    return reading_level.levels(table(spark, d, "documents"), table(spark, d, "graded_samples")).withColumnRenamed("id", "doc_id")


@R.query("p10_profile")
def p10_profile(spark, d):
    """The distribution of levels by source."""
    return reading_level.profile(reading_level.levels(table(spark, d, "documents"), table(spark, d, "graded_samples")))


@R.query("p3_found")
def p3_found(spark, d):
    """Every pair of elements of source and zh in one entry that translate each other or a part of each other."""
    return bilingual.aligned(table(spark, d, "sentence_translations")).select(F.col("id").alias("entry_id"), "source_no", "zh_no").distinct()


@R.query("p3_scores")
def p3_scores(spark, d):
    """Those pairs with their scores."""
    return bilingual.aligned(table(spark, d, "sentence_translations")).withColumnRenamed("id", "entry_id")
